"""Scores, ranking with limits for each key, staged funnels, and bounded search for routes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import clamp, half_up


def capped_chart(df: DataFrame, score: str, item: str, key: str, per_key: int, limit: int) -> DataFrame:
    """The best rows by score, then item, with at most so many of a key. Taking them one by one gives the same, since what
    a key's limit leaves out never moves the others."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), item))
    return df.withColumn("nth", nth).where(F.col("nth") <= per_key).drop("nth").orderBy(F.desc(score), item).limit(limit)


# Fixed values of momentum() and trend_class(): the weights of the sum and the steps of the ladder.


def momentum(velocity: Column, acceleration: Column, listens: Column, listeners: Column, save: Column, completion: Column, spread: Column) -> Column:
    """Trend strength of a chart signal in [0, 1]."""
    strength = clamp(F.log10(F.greatest(F.lit(1.0), listens)) / 7)
    quality = clamp(listeners / F.greatest(F.lit(1), listens) * 8)
    return clamp(0.28 + F.tanh(velocity / 100) * 0.24 + F.tanh(acceleration / 50) * 0.12 + strength * 0.1 + quality * 0.08 + clamp(save) * 0.08 + clamp(completion) * 0.05 + clamp(spread) * 0.13)


def trend_class(velocity: Column, own_velocity: Column, age_days: Column, strength: Column, spread: Column) -> Column:
    return (
        F.when((velocity < -10) | (own_velocity < -10), "falling")
        .when((age_days > 365) & (F.abs(velocity) < 5), "evergreen")
        .when((strength >= 0.82) & (spread >= 0.65), "viral")
        .when((strength >= 0.7) & (velocity >= 100), "breaking")
        .when((strength >= 0.58) & (velocity > 5), "rising")
        .otherwise("stable-hit")
    )


def weighted_score(parts: Sequence[tuple[str, float]]) -> Column:
    """Weighted mean of columns in [0, 1]."""
    return reduce(lambda a, b: a + b, (clamp(c) * w for c, w in parts)) / sum(w for _, w in parts)


def available_score(parts: Sequence[tuple[str, float]]) -> Column:
    """Sum of the rounded shares of the columns that are not null, their weights scaled to one."""
    weight = reduce(lambda a, b: a + b, (F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in parts))
    terms = (F.coalesce(half_up(clamp(c) * w / F.when(weight > 0, weight).otherwise(1.0)), F.lit(0.0)) for c, w in parts)
    return half_up(reduce(lambda a, b: a + b, terms))


def top_reasons(parts: Sequence[tuple[str, Column]], most: int = 3) -> Column:
    """Names of the largest positive contributions, largest first, earlier ones first among equals."""
    made = F.array(*(F.struct((-x).alias("o"), F.lit(k).alias("k"), F.lit(n).alias("n")) for k, (n, x) in enumerate(parts)))
    return F.transform(F.slice(F.array_sort(F.filter(made, lambda s: s["o"] < 0)), 1, most), lambda s: s["n"])


def funnel(df: DataFrame, stages: Sequence[tuple[Sequence[Column], int]]) -> DataFrame:
    """Several rounds of ordering and keeping the first rows; each keeps fewer, by an order of its own."""
    for order, keep in stages:
        df = df.orderBy(*order).limit(keep)
    return df


def with_margin(df: DataFrame, key: str, score: str, item: str, least: float) -> DataFrame:
    """(key, item, score, margin, clear): the best of each key, and whether it leads the next by enough."""
    w = Window.partitionBy(key).orderBy(F.desc(score), item)
    two = df.withColumn("nth", F.row_number().over(w)).withColumn("next", F.lead(score).over(w)).where("nth = 1")
    margin = half_up(F.col(score) - F.coalesce("next", F.lit(0.0)))
    return two.select(key, item, score, margin.alias("margin"), (margin >= least).alias("clear"))


def beam_routes(items: DataFrame, item: str, start: object, score: Column, least: float, hops: int, width: int) -> DataFrame:
    """(route, score) of the best routes without repeats of so many hops by the product of scores of at least so much; score
    uses the columns of the items as they are, and those of the tip of a route as tip_ ones.

    A hop joins the width routes that are kept with the items: no table of all pairs is made."""
    own = [c for c in items.columns if c != item]
    tips = lambda df: df.select("route", "s", *(F.col(c).alias(f"tip_{c}") for c in own))
    routes = tips(items.where(F.col(item) == start).select(F.array(item).alias("route"), F.lit(1.0).alias("s"), *own))
    for _ in range(hops):
        grown = items.join(F.broadcast(routes), ~F.array_contains("route", F.col(item))).withColumn("edge", half_up(score)).where(F.col("edge") >= least)
        grown = grown.select(F.array_append("route", F.col(item)).alias("route"), (F.col("s") * F.col("edge")).alias("s"), *own)
        routes = tips(grown.orderBy(F.desc(half_up("s", 9)), "route").limit(width))
    return routes.select("route", half_up("s", 6).alias("score"))


def softmax_choice(df: DataFrame, key: str, score: str, item: str, point: float, top: int = 3) -> DataFrame:
    """(key, item, probability): of the best few, the first whose running probability reaches the point."""
    w = Window.partitionBy(key).orderBy(F.desc(score), item)
    best = df.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= top).withColumn("e", F.exp(score))
    by = Window.partitionBy(key)
    p = best.withColumn("p", F.col("e") / F.sum("e").over(by)).withColumn("run", F.sum("p").over(by.orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)))
    first = p.where(F.col("run") >= point - 1e-9)
    return first.groupBy(key).agg(F.min_by(item, "nth").alias(item), half_up(F.min_by("p", "nth")).alias("probability"))
