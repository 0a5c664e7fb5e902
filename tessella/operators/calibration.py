"""How far stated probabilities are from what happened, and intervals for what was measured."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp, half_up, share, wilson


def calibration(df: DataFrame, key: str, p: str, outcome: str, bins: int = 10) -> DataFrame:
    """(key, ece, brier, n): expected calibration error over equal-width bins, from means that are rounded first."""
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    by_bin = df.groupBy(key, at.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        half_up(F.avg(p)).alias("predicted"),
        half_up(F.avg(F.col(outcome).cast("double"))).alias("observed"),
        F.sum(F.pow(F.col(p) - F.col(outcome), 2)).alias("squares"),
    )
    error = F.sum(F.abs(F.col("predicted") - F.col("observed")) * F.col("n")) / F.sum("n")
    return by_bin.groupBy(key).agg(half_up(error).alias("ece"), half_up(F.sum("squares") / F.sum("n")).alias("brier"), F.sum("n").alias("n"))


def reliability_bins(df: DataFrame, p: str, correct: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_confidence, accuracy, error) of every bin, empty ones too."""
    at = F.least(F.floor(clamp(p) * bins), F.lit(bins - 1)).cast("long")
    found = df.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(clamp(p)).alias("c"), F.avg(F.col(correct).cast("double")).alias("a"))
    all_ = df.sparkSession.range(bins).select(F.col("id").alias("bin")).join(found, "bin", "left")
    c, a = F.coalesce("c", F.lit(0.0)), F.coalesce("a", F.lit(0.0))
    return all_.select("bin", F.coalesce("n", F.lit(0)).alias("n"), half_up(c).alias("mean_confidence"), half_up(a).alias("accuracy"), half_up(F.abs(c - a)).alias("error"))


def absolute_calibration(df: DataFrame, key: str, p: str, outcome: str) -> DataFrame:
    """(key, mae, brier, catastrophic): no bins; catastrophic is the share of sure predictions (0.8 on) that failed."""
    sure = F.count_if(F.col(p) >= 0.8)
    return df.groupBy(key).agg(
        half_up(F.avg(F.abs(F.col(p) - F.col(outcome)))).alias("mae"),
        half_up(F.avg(F.pow(F.col(p) - F.col(outcome), 2))).alias("brier"),
        half_up(share(F.count_if((F.col(p) >= 0.8) & (F.col(outcome) == 0)), sure)).alias("catastrophic"),
    )


def rate_intervals(df: DataFrame, keys: Sequence[str], success: str) -> DataFrame:
    """(keys, n, successes, low, high): Wilson intervals."""
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(success).alias("successes"))
    return grouped.withColumn("w", wilson(F.col("successes"), F.col("n"))).select(*keys, "n", "successes", "w.low", "w.high")


def mean_intervals(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, mean, low, high): normal intervals within [0, 1]; half a unit wide each way for a single value."""
    grouped = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    margin = F.when(F.col("n") > 1, 1.96 * F.sqrt(F.col("v") / F.col("n"))).otherwise(0.5)
    return grouped.select(*keys, "n", half_up("m", 6).alias("mean"), half_up(clamp(F.col("m") - margin), 6).alias("low"), half_up(clamp(F.col("m") + margin), 6).alias("high"))
