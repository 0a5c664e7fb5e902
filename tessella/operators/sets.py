"""Set operations on keys, operation logs and sparse vectors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import clamp, half_up


def merge_operations(a: DataFrame, b: DataFrame, key: str, clock: str, order: Sequence[str]) -> DataFrame:
    """The union of two operation logs with one row for each key: the latest by clock, the first by order among equals."""
    both = a.unionByName(b)
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(clock), *order))
    return both.withColumn("nth", nth).where("nth = 1").drop("nth")


def merge_sources(df: DataFrame, item: str, source: str, order: str, score: str, quota: dict[str, int]) -> DataFrame:
    """(item, score, sources): the best rows of each source up to its quota, merged by item in the order of the sources;
    every further source that names an item adds min(0.15, 0.025 n) to the larger score."""
    # a literal limit for each source, so that each task sends on that many rows at most
    tops = [df.where(F.col(source) == s).orderBy(F.desc(score), item).limit(n).withColumn("place", F.lit(k)) for k, (s, n) in enumerate(quota.items())]
    kept = reduce(DataFrame.union, tops)
    rows = F.array_sort(F.collect_list(F.struct("place", (-F.col(score)).alias("o"), F.col(score).cast("double").alias("x"), F.col(source).alias("s"))))
    start = F.struct(F.lit(None).cast("double").alias("x"), F.array().cast("array<string>").alias("s"))

    def step(a: Column, r: Column) -> Column:
        names = F.when(F.array_contains(a["s"], r["s"]), a["s"]).otherwise(F.array_append(a["s"], r["s"]))
        again = half_up(F.greatest(a["x"], r["x"]) + F.least(F.lit(0.15), F.size(names) * 0.025))
        return F.struct(F.when(a["x"].isNull(), half_up(clamp(r["x"]))).otherwise(again).alias("x"), names.alias("s"))

    folded = kept.groupBy(item).agg(rows.alias("r")).select(item, F.aggregate("r", start, step).alias("a"))
    return folded.select(item, F.col("a.x").alias(score), F.array_join("a.s", ",").alias("sources"))


def merge_layers(layers: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """(key, value): weighted mean over the layers that have the key."""
    return layers.groupBy(key).agg(half_up(F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value))


def forgotten(df: DataFrame, item: str, recent: Column, liked: Column, weight: Column) -> DataFrame:
    """(item, score) of liked items without a recent row."""
    old = df.where(liked).groupBy(item).agg(half_up(F.sum(weight)).alias("score"))
    return old.join(df.where(recent).select(item).distinct(), item, "left_anti")


def adjacent_pairs_missing(recipes: DataFrame, playlist: DataFrame, key: str, order: str, item: str) -> DataFrame:
    """Recipes (key, src, dst) that are no neighbouring pair of their playlist."""
    pairs = playlist.select(key, F.col(item).alias("src"), F.lead(item).over(Window.partitionBy(key).orderBy(order)).alias("dst")).where("dst is not null")
    return recipes.join(pairs, [key, "src", "dst"], "left_anti")


def private_profile(df: DataFrame, member: str, tag: str, value: str, group: str, least: int) -> DataFrame:
    """(group, tag, mean, members): tags that enough members have, as the mean over all members of the group, who count as
    zero where they do not have the tag."""
    size = df.groupBy(group).agg(F.countDistinct(member).alias("members"))
    g = df.groupBy(group, tag).agg(F.sum(value).alias("s"), F.countDistinct(member).alias("k")).where(F.col("k") >= least)
    return g.join(size, group).select(group, tag, half_up(F.col("s") / F.col("members")).alias("mean"), "members")
