"""Operators over ordered rows: trends, trailing frames, runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import clamp, half_up


def trend(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, n, velocity, acceleration, direction, confidence): means of first and second differences."""
    w = Window.partitionBy(key).orderBy(order)
    step = df.withColumn("d", F.col(value) - F.lag(value).over(w)).withColumn("dd", F.col("d") - F.lag("d").over(w))
    g = step.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("d"), F.lit(0.0)).alias("v"), F.coalesce(F.avg("dd"), F.lit(0.0)).alias("a"))
    direction = F.when(F.col("v") > 0.15, "rising").when(F.col("v") < -0.15, "falling").otherwise("stable")
    confidence = F.when(F.col("n") < 2, 0.15).otherwise(clamp(0.25 + F.col("n") * 0.12))
    return g.select(key, "n", half_up("v").alias("velocity"), half_up("a").alias("acceleration"), direction.alias("direction"), half_up(confidence).alias("confidence"))


def last_rows(df: DataFrame, key: Sequence[str], order: Sequence[str], last: int) -> DataFrame:
    """The last rows of each key, with pos (1 for the earliest of them) and size (how many there are)."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order)))
    kept = df.withColumn("nth", nth).where(F.col("nth") <= last)
    return kept.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(*key))).withColumn("pos", F.col("size") - F.col("nth") + 1)


def strategy_fatigue(df: DataFrame, key: str, order: Sequence[str], kind: str, last: int = 8) -> DataFrame:
    """(key, kind, recent, consecutive, fatigue, penalty): how worn out each kind of the last rows is."""
    recent = last_rows(df, [key], order, last)
    # the closing streak of a kind: rows after the last one of another kind
    other = F.max(F.when(F.col(kind) != F.col("final"), F.col("pos"))).over(Window.partitionBy(key))
    final = F.max_by(kind, "pos").over(Window.partitionBy(key))
    streak = recent.withColumn("final", final).withColumn("streak", F.col("size") - F.coalesce(other, F.lit(0)))
    g = streak.groupBy(key, kind).agg(
        F.count(F.lit(1)).alias("recent"), F.sum(F.col("pos") / F.col("size")).alias("weight"), F.max(F.when(F.col(kind) == F.col("final"), F.col("streak")).otherwise(0)).alias("consecutive")
    )
    fatigue = half_up(F.col("weight") / 2.6 + F.greatest(F.lit(0), F.col("consecutive") - 1) * 0.22)
    return g.select(key, kind, "recent", "consecutive", fatigue.alias("fatigue"), half_up(fatigue * 0.35).alias("penalty"))


def repetition(df: DataFrame, key: str, order: Sequence[str], value: str, last: int = 8) -> DataFrame:
    """(key, repetition): how often the most frequent of the last values repeats."""
    counts = last_rows(df, [key], order, last).groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    g = counts.groupBy(key).agg(F.max("c").alias("top"), F.sum("c").alias("n"))
    return g.select(key, half_up(F.when(F.col("n") > 1, (F.col("top") - 1) / (F.col("n") - 1)).otherwise(0.0)).alias("repetition"))


def runs(df: DataFrame, key: Sequence[str], order: Sequence[str], label: str, value: str) -> DataFrame:
    """(key, run, label, first, n, mean): maximal runs of rows with the same label, numbered from 1."""
    w = Window.partitionBy(*key).orderBy(*order)
    edge = F.when(F.lag(label).over(w) == F.col(label), 0).otherwise(1)
    numbered = df.withColumn("edge", edge).withColumn("run", F.sum("edge").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*key, "run", label).agg(F.min(order[0]).alias("first"), F.count(F.lit(1)).alias("n"), half_up(F.avg(value), 2).alias("mean"))


def sections(df: DataFrame, key: str, order: str, value: str, shortest: int) -> DataFrame:
    """Labelled sections of a level curve: runs of low (under 0.4), mid and high (over 0.72) that are long enough, named by
    their neighbours: intro, outro, break, build, drop, body."""
    level = F.when(F.col(value) < 0.4, "low").when(F.col(value) > 0.72, "high").otherwise("mid")
    found = runs(df.withColumn("level", level), [key], [order], "level", value)
    by = Window.partitionBy(key)
    kept = found.withColumn("all", F.count(F.lit(1)).over(by)).where((F.col("n") >= shortest) | (F.col("all") <= 2))
    w = by.orderBy("run")
    before, after = F.lag("level").over(w), F.lead("level").over(w)
    kind = (
        F.when((F.col("level") == "low") & before.isNull(), "intro")
        .when((F.col("level") == "low") & after.isNull(), "outro")
        .when((F.col("level") == "low") & (before == "high"), "break")
        .when((F.col("level") == "mid") & (after == "high"), "build")
        .when(F.col("level") == "high", "drop")
        .otherwise("body")
    )
    return kept.select(key, "run", kind.alias("kind"), "first", "n", "mean")


def onsets(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows of a level curve that rise by more than 0.12, over 0.2, and are not under the next."""
    w = Window.partitionBy(key).orderBy(order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    onset = (F.col(value) - before > 0.12) & (F.col(value) >= after) & (F.col(value) > 0.2)
    return df.withColumn("onset", onset).where("onset").drop("onset")


def endpoint_drift(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, n, slope): from the first to the last value, a step each; no regression."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min_by(value, order).alias("a"), F.max_by(value, order).alias("z"))
    return g.select(key, "n", half_up(F.when(F.col("n") > 1, (F.col("z") - F.col("a")) / (F.col("n") - 1)).otherwise(0.0)).alias("slope"))


def energy_pattern(df: DataFrame, key: str, order: str, value: str, tolerance: float) -> DataFrame:
    """(key, pattern, mean_step): rise, fall, arc or stable by first, last and highest value."""
    w = Window.partitionBy(key).orderBy(order)
    step = df.withColumn("d", F.abs(F.col(value) - F.lag(value).over(w)))
    g = step.groupBy(key).agg(F.min_by(value, order).alias("a"), F.max_by(value, order).alias("z"), F.max(value).alias("top"), F.avg("d").alias("d"))
    pattern = (
        F.when(F.col("top") > F.greatest("a", "z") + tolerance, "arc").when(F.col("z") > F.col("a") + tolerance, "rise").when(F.col("z") < F.col("a") - tolerance, "fall").otherwise("stable")
    )
    return g.select(key, pattern.alias("pattern"), half_up(F.coalesce("d", F.lit(0.0))).alias("mean_step"))


def phases(df: DataFrame, key: str, start: str) -> DataFrame:
    """df with ended: a phase ends where the next of its key starts; null for the open one."""
    return df.withColumn("ended", F.lead(start).over(Window.partitionBy(key).orderBy(start)))


def trailing_count(df: DataFrame, key: str, at_ms: str, span_ms: int) -> DataFrame:
    """df with recent: rows of the key in the span that ends at the row, itself and both ends included."""
    return df.withColumn("recent", F.count(F.lit(1)).over(Window.partitionBy(key).orderBy(at_ms).rangeBetween(-span_ms, 0)))


def gaps(df: DataFrame, key: str, start: str, end: str, least: float) -> DataFrame:
    """(key, gap_start, gap_end): stretches of at least so long that no interval covers, between the first and the last."""
    reach = F.max(end).over(Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("reach", reach).where(F.col(start) - F.col("reach") >= least).select(key, F.col("reach").alias("gap_start"), F.col(start).alias("gap_end"))


def sessions(df: DataFrame, key: str, at_ms: str, gap_ms: int, value: Column) -> DataFrame:
    """(key, session, started, ended, n, total): rows of a key no further apart than the gap."""
    w = Window.partitionBy(key).orderBy(at_ms)
    new = F.when(F.col(at_ms) - F.lag(at_ms).over(w) <= gap_ms, 0).otherwise(1)
    cut = df.withColumn("new", new).withColumn("session", F.sum("new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return cut.groupBy(key, "session").agg(F.min(at_ms).alias("started"), F.max(at_ms).alias("ended"), F.count(F.lit(1)).alias("n"), half_up(F.sum(value)).alias("total"))


# What kinds of sections promise and resolve, and the parts of tension; when a promise holds a cut back.
PROMISE, RESOLUTION = {"build": 0.96, "pre-chorus": 0.9, "break": 0.72, "bridge": 0.58}, {"drop": 0.94, "chorus": 0.88, "outro": 0.62}
PROMISED, RISE, FALLS, RESTS = 0.2, 0.18, 0.45, 0.12
HOLDS, RESOLVES, WAIT_S = 0.85, 0.75, 24.0


def tensions(sections: DataFrame, key: str) -> DataFrame:
    """sections (key, section, type, w_start, w_end, energy, drums) with tension, anticipation and resolution, by the section
    that follows."""
    after = F.lead("energy").over(Window.partitionBy(key).orderBy("section"))
    named = lambda table, otherwise: F.coalesce(*(F.when(F.col("type") == k, F.lit(v)) for k, v in table.items()), otherwise)
    rise = F.greatest(F.lit(0.0), F.coalesce(after - F.col("energy"), F.lit(0.0)))
    anticipation = clamp(named(PROMISE, F.lit(PROMISED)) + rise * RISE)
    resolution = clamp(named(RESOLUTION, F.when(after < F.col("energy"), FALLS).otherwise(RESTS)))
    tension = clamp(anticipation * 0.68 + rise * 0.24 + F.col("drums") * 0.08 - resolution * 0.25)
    return sections.withColumns({"tension": half_up(tension), "anticipation": half_up(anticipation), "resolution": half_up(resolution)})


def payoff_cuts(cuts: DataFrame, sections: DataFrame, item: str, key: str, at: str) -> DataFrame:
    """(item, blocked, anticipation, payoff, wait) of cuts (item, key, at): the section that a cut falls in, and the first later
    one that resolves and begins soon enough (null for none); a strong promise that it keeps holds the cut back. Only sections that resolve
    are looked at, by the number of those before a section, so a cut meets one of them."""
    told = tensions(sections, key)
    by = Window.partitionBy(key).orderBy(F.desc("section"))
    ahead = F.last(F.when(F.col("resolution") >= RESOLVES, F.struct("section", "w_start", "w_end")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    known = told.withColumn("ahead", ahead).select(F.col(key).alias("_k"), "w_start", "w_end", "anticipation", "ahead")
    met = cuts.join(known, (F.col(key) == F.col("_k")) & (F.col(at) >= F.col("w_start")) & (F.col(at) < F.col("w_end")), "left")
    near = F.when(F.col("ahead.w_start") - F.col(at) <= WAIT_S, F.col("ahead"))
    return met.select(
        item, (F.coalesce(F.col("anticipation") >= HOLDS, F.lit(False)) & near.isNotNull()).alias("blocked"), F.coalesce("anticipation", F.lit(0.0)).alias("anticipation"), near["section"].alias("payoff"),
        F.when(near.isNotNull(), half_up(F.greatest(F.lit(0.0), near["w_end"] - F.col(at)))).alias("wait"),
    )
