"""Running sums and places for few keys with many rows each: range partitions are summed each in its task, and start where
those before them end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import stored


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """df with the sum of value over the rows of the key up to this one, in the order (which should leave no ties)."""
    by_range = df.withColumn(name, value).repartitionByRange(*keys, *order)
    ranged = stored(by_range.withColumn("_part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy(*keys, "_part").agg(F.sum(name).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(*keys, "_part", F.coalesce(before, F.lit(0)).alias("_start"))
    local = F.sum(name).over(Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn(name, local).join(starts, [*keys, "_part"]).withColumn(name, F.col(name) + F.col("_start")).drop("_part", "_start")


def index_percentiles(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """scalars.index_percentiles() for few keys: no key is sorted in one task."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, value).withColumn("_row", F.monotonically_increasing_id())
    placed = running_sum(rows, keys, [F.col(value), F.col("_row")], F.lit(1).cast("long"), "at").withColumn("at", F.col("at") - 1)
    total = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    met = placed.join(F.broadcast(total), list(keys))  # a row for each of few keys
    return met.groupBy(*keys).agg(*(F.max(F.when(F.col("at") == k, F.col(value))).alias(name) for name, k in ranks.items()))
