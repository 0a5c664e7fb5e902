"""Bucketed statistics over scored event rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp, half_up, nearest_rank, ratio

GRADES = ("A", "B", "C", "D", "F")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 78, "B").when(score >= 65, "C").when(score >= 50, "D").otherwise("F")


def stats() -> list[Column]:
    """Aggregates of the columns score, grade, timing_ms, fallback and negative (booleans), cache_hit (null: unknown) and
    render_ms (zero and less: none)."""
    count = F.count(F.lit(1))
    rendered = F.when(F.col("render_ms") > 0, F.col("render_ms"))
    return [
        count.alias("n"),
        half_up(F.avg("score"), 1).alias("avg_score"),
        half_up(F.min("score"), 1).alias("min_score"),
        half_up(F.max("score"), 1).alias("max_score"),
        *(F.count_if(F.col("grade") == g).alias(f"grade_{g.lower()}") for g in GRADES),
        half_up(F.avg("timing_ms"), 1).alias("avg_timing_ms"),
        half_up(nearest_rank("abs_timing_ms", 0.5), 1).alias("p50_abs_timing_ms"),
        half_up(nearest_rank("abs_timing_ms", 0.95), 1).alias("p95_abs_timing_ms"),
        ratio(F.count_if("fallback"), count).alias("fallback_rate"),
        ratio(F.count_if("negative"), count).alias("negative_rate"),
        ratio(F.count_if("cache_hit"), F.count("cache_hit")).alias("cache_hit_rate"),
        half_up(F.avg(rendered), 1).alias("avg_render_ms"),
    ]


def prepared(df: DataFrame) -> DataFrame:
    return df.withColumns({"abs_timing_ms": F.abs("timing_ms"), "grade": grade(F.col("score"))})


def bucket_stats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return prepared(df).groupBy(*keys).agg(*stats())


def pattern_stats(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """One scan for several groupings: each row counts once in the bucket of every named key."""
    spread = prepared(df).withColumn("k", F.explode(F.array(*(F.struct(F.lit(n).alias("pattern"), x.alias("bucket")) for n, x in keys.items()))))
    return spread.groupBy("k.pattern", "k.bucket").agg(*stats())


def findings(buckets: DataFrame, least: int, below: float = 78, most: int = 8) -> DataFrame:
    """The worst buckets with enough rows."""
    return buckets.where((F.col("n") >= least) & (F.col("avg_score") < below)).orderBy("avg_score", F.desc("n"), "pattern", "bucket").limit(most)


def feedback_bias(buckets: DataFrame, least: int = 4) -> DataFrame:
    """A bounded score correction from what buckets have shown, by the confidence that their number of rows gives."""
    confidence = half_up(clamp(F.col("n") / least))
    raw = (F.col("avg_score") - 82) * 0.45 - F.col("fallback_rate") * 18 - F.col("negative_rate") * 28
    return buckets.withColumns({"confidence": confidence, "bias": half_up(clamp(raw, -24.0, 12.0) * clamp(F.col("n") / least))})


def failure_rates(events: DataFrame, kind: str, kinds: DataFrame) -> DataFrame:
    """(kind, n, rate) for every kind of the enumeration, those without an event too."""
    counts = events.groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    joined = kinds.join(counts, "kind", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = events.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("total"))  # one row
    return joined.join(F.broadcast(total)).select("kind", "n", half_up(F.col("n") / F.col("total"), 6).alias("rate"))
