"""Evidence ledgers: bounded logs of weighted events, and what they say at a given time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import DAY_MS, clamp, half_up
from .prefixes import running_sum

#: Value of a reaction (fixed values).
REACTIONS = {"like": 0.55, "skip": -0.65, "dance": 0.8, "leave": -0.9, "request": 1.0, "neutral": 0.0}


def in_window(at_ms: str, now_ms: int, days: int) -> Column:
    """Both ends of the window count."""
    return F.col(at_ms).between(now_ms - max(1, min(365, days)) * DAY_MS, now_ms)


def summary(df: DataFrame, now_ms: int, accepted: Sequence[str], undone: Sequence[str], voluntary: Sequence[str], days: int = 90, trust: float = 0.5) -> DataFrame:
    """One row: events, accepted, undone, voluntary (sums of weights), evidence (count) and trust, which moves by a tenth
    towards what was observed once there are ten rows of evidence. Of kind, weight, at_ms."""
    weight = lambda kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("weight"))), F.lit(0.0))
    g = df.where(in_window("at_ms", now_ms, days)).agg(
        F.count(F.lit(1)).alias("events"), weight(accepted).alias("accepted"), weight(undone).alias("undone"), weight(voluntary).alias("voluntary"),
        F.count_if(F.col("kind").isin(*accepted, *undone)).alias("evidence"),
    )
    seen = F.when(F.col("accepted") + F.col("undone") > 0, F.col("accepted") / (F.col("accepted") + F.col("undone"))).otherwise(trust)
    moved = F.when(F.col("evidence") < 10, clamp(F.lit(trust))).otherwise(clamp(trust * 0.9 + seen * 0.1))
    return g.select("events", half_up("accepted").alias("accepted"), half_up("undone").alias("undone"), half_up("voluntary").alias("voluntary"), "evidence", half_up(moved).alias("trust"))


def reaction_feedback(df: DataFrame, item: str, now_ms: int, half_minutes: float) -> DataFrame:
    """(item, adjustment, evidence): sum of decayed reactions within [-1, 1], each rounded first. Of reaction, confidence,
    at_ms; an unknown reaction is neutral."""
    value = F.coalesce(*(F.when(F.col("reaction") == r, v) for r, v in REACTIONS.items()), F.lit(0.0))
    age = F.greatest(F.lit(0), now_ms - F.col("at_ms")) / 60_000
    term = half_up(value * clamp("confidence") * F.pow(F.lit(2.0), -age / half_minutes))
    return df.groupBy(item).agg(half_up(clamp(F.sum(term), -1.0, 1.0)).alias("adjustment"), F.count(F.lit(1)).alias("evidence"))


def newest(df: DataFrame, keep: int, order: Sequence[str]) -> DataFrame:
    """The newest rows by order, as a bounded log keeps them."""
    return df.orderBy(*(F.desc(c) for c in order)).limit(keep)


def evicted(df: DataFrame, scope: str, at: str, size: str, item: str, room: int) -> DataFrame:
    """Rows that a cache limited to room (for each scope) drops: the oldest, until the rest fits."""
    newer = running_sum(df, [scope], [F.desc(at), F.desc(item)], F.col(size), "held")
    return newer.where(F.col("held") > room).select(*df.columns)


def fresh(cache: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """wanted with hit: whether the cache holds that key made by the same version with the same parameters."""
    return wanted.join(cache.select(*keys).distinct().withColumn("hit", F.lit(True)), list(keys), "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)
