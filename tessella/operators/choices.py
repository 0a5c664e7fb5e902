"""Choosing one of several: filtered best, hierarchies of sources, residual states, relaxation, robustness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import clamp, half_up


def best(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], keep: Column | None = None, most: int = 1) -> DataFrame:
    """The first rows of each key by order, of those to keep."""
    rows = df if keep is None else df.where(keep)
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= most).drop("_nth")


def best_or(df: DataFrame, keys: DataFrame, key: str, order: Sequence[Column | str], keep: Column, take: dict[str, object]) -> DataFrame:
    """For every key of keys the taken columns of its best row, or the given values where it has none."""
    found = best(df, [key], order, keep).select(key, *take)
    out = keys.join(found, key, "left")
    return out.select(*keys.columns, *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in take.items()))


def by_source(df: DataFrame, key: Sequence[str], source: str, order: Sequence[str], then: Sequence[Column | str]) -> DataFrame:
    """The row of each key from the highest source of a fixed order, then by what follows; unknown sources come last."""
    place = F.coalesce(*(F.when(F.col(source) == s, k) for k, s in enumerate(order)), F.lit(len(order)))
    return best(df, key, [place, *then])


def residual_state(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, state) of residuals against a predicted grid: their range, slope from first to last, and mean decide."""
    g = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), (F.max(value) - F.min(value)).alias("spread"), F.min_by(value, order).alias("a"), F.max_by(value, order).alias("z")
    )
    slope = F.when(F.col("n") > 1, (F.col("z") - F.col("a")) / (F.col("n") - 1)).otherwise(0.0)
    state = F.when(F.col("spread") > 0.06, "REACQUIRING").when(F.abs(slope) > 0.004, "DRIFTING").when(F.abs("m") > 0.03, "UNCERTAIN").otherwise("LOCKED")
    return g.select(key, state.alias("state"))


def committee(df: DataFrame, key: str, item: str, confidence: str, tempo: str, phase: str) -> DataFrame:
    """(key, primary, tempo_spread, phase_spread, impact): the most confident hypothesis and how far all of them are apart."""
    g = df.groupBy(key).agg(
        F.min_by(item, F.struct((-F.col(confidence)).alias("c"), F.col(item).alias("i"))).alias("primary"), F.max(tempo).alias("hi"), F.min(tempo).alias("lo"), (F.max(phase) - F.min(phase)).alias("ph")
    )
    t, p = clamp((F.col("hi") - F.col("lo")) / F.greatest(F.lit(1.0), F.col("hi"))), clamp("ph")
    return g.select(key, "primary", half_up(t).alias("tempo_spread"), half_up(p).alias("phase_spread"), half_up(F.greatest(t, p)).alias("impact"))


def nearest_pulse(bpm: Column, other: Column) -> Column:
    """struct(ratio, compatible): the nearest of a tempo, its half and its double, as a ratio; compatible within 4 %."""
    options = F.array(*(F.struct(F.abs(other * m - bpm).alias("d"), F.lit(k).alias("k"), (other * m).alias("v")) for k, m in enumerate((1.0, 0.5, 2.0))))
    ratio = F.array_min(options)["v"] / bpm
    return F.struct(half_up(ratio).alias("ratio"), (F.abs(ratio - 1) <= 0.04).alias("compatible"))


def robustness(quality: Column, slope: Column, floor: float, steps: Sequence[float] = (-1.0, -0.5, 0.0, 0.5, 1.0)) -> Column:
    """Share of fixed perturbations under which a quality that falls by slope for each unit stays at the floor or over."""
    held = F.filter(F.array(*(quality - F.abs(F.lit(s)) * slope for s in steps)), lambda q: q >= floor)
    return half_up(F.size(held) / float(len(steps)))


def geometric_mean(parts: Sequence[Column]) -> Column:
    """Of layers within [0, 1]."""
    product = clamp(parts[0])
    for x in parts[1:]:
        product = product * clamp(x)
    return half_up(F.pow(product, 1.0 / len(parts)))


def weakest(parts: dict[str, Column]) -> Column:
    """The name of the smallest layer, the first of equals."""
    return F.array_min(F.array(*(F.struct(x.alias("x"), F.lit(k).alias("k"), F.lit(n).alias("n")) for k, (n, x) in enumerate(parts.items()))))["n"]


def relaxed(df: DataFrame, key: str, constraint: str, relaxability: str, importance: str, most: int) -> DataFrame:
    """(key, dropped): the soft constraints to give up first, the most relaxable and least important."""
    rows = best(df, [key], [F.desc(relaxability), F.col(importance), F.col(constraint)], most=most)
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(constraint)), ",").alias("dropped"))


def grid_search(df: DataFrame, axes: dict[str, Sequence[float]], score: Column) -> DataFrame:
    """df with the point of a small grid with the best score and that score; the smaller point of equals."""
    out = df.withColumn("_row", F.monotonically_increasing_id())
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    scored = out.withColumn("best", half_up(score, 6))
    return best(scored, ["_row"], [F.desc("best"), *axes]).drop("_row")


def criticism(df: DataFrame, stages: Sequence[tuple[str, float]]) -> DataFrame:
    """One row: how many rows are left after each of successive floors."""
    passed = F.lit(True)
    counts = []
    for name, floor in stages:
        passed = passed & (F.col(name) >= floor)
        counts.append(F.count_if(passed).alias(f"after_{name}"))
    return df.agg(*counts)


def two_hop_path(edges: DataFrame, pairs: DataFrame, least: float = 0.7) -> DataFrame:
    """pairs (src, dst) with path: direct, through the first edge out of src (by seq) alone, or empty. Of seq, a, b,
    confidence."""
    sure = edges.where(F.col("confidence") >= least)
    direct = sure.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(True).alias("direct")).distinct()
    first = best(sure, ["a"], ["seq"]).select(F.col("a").alias("src"), F.col("b").alias("via"))
    onward = sure.select(F.col("a").alias("via"), F.col("b").alias("dst"), F.lit(True).alias("onward")).distinct()
    met = pairs.join(direct, ["src", "dst"], "left").join(first, "src", "left").join(onward, ["via", "dst"], "left")
    text = lambda c: F.col(c).cast("string")
    path = F.when(F.col("direct"), F.concat_ws(">", text("src"), text("dst"))).when(F.col("onward"), F.concat_ws(">", text("src"), text("via"), text("dst"))).otherwise("")
    return met.select("src", "dst", path.alias("path"))


def affinity(edges: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(src, dst, affinity): the strongest edge by the weight of its relation; unknown relations count nothing."""
    w = F.coalesce(*(F.when(F.col("relation") == k, v) for k, v in weights.items()), F.lit(0.0))
    return edges.groupBy("src", "dst").agg(half_up(F.max(clamp("strength") * w)).alias("affinity"))


def corrected(features: DataFrame, corrections: DataFrame, item: str, value: str) -> DataFrame:
    """features with value overridden by a trusted correction (user, trust, contributors, value as fixed): trust of 0.6 on,
    made by the user or at least three contributors; the user's first, then the most trusted."""
    ok = (F.col("trust") >= 0.6) & (F.col("by_user") | (F.col("contributors") >= 3))
    one = best(corrections, [item], [F.desc("by_user"), F.desc("trust"), F.col("fixed")], ok).select(item, "fixed")
    return features.join(one, item, "left").withColumn(value, F.coalesce("fixed", value)).drop("fixed")
