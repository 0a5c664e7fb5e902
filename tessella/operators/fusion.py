"""Fusing evidence of several sources about one property of an entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import clamp, half_up


def valid_evidence(df: DataFrame) -> DataFrame:
    """Rows with a value, a source, and confidence and weight above zero; confidence within [0, 1], weight 1 if null."""
    return (
        df.where(F.col("value").isNotNull() & (F.trim("source") != ""))
        .withColumns({"confidence": clamp(F.nanvl(F.col("confidence"), F.lit(0.0))), "weight": F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(0.0))})
        .where("confidence > 0 and weight > 0")
    )


def fuse_categorical(df: DataFrame) -> DataFrame:
    """(entity, value, confidence, agreement, conflicted) from (entity, value, source, family, confidence, weight).

    The value with most support wins, the smaller of equals. Within a family only the strongest evidence counts;
    families are independent, and the square of the winner's share of all support discounts the result."""
    rows = valid_evidence(df).withColumn("family", F.coalesce("family", "source"))
    calibrated = clamp(F.col("confidence") * F.least(F.lit(1.0), F.col("weight")))
    families = rows.groupBy("entity", "value", "family").agg(F.sum(F.col("confidence") * F.col("weight")).alias("support"), F.max(calibrated).alias("best"))
    values = families.groupBy("entity", "value").agg(F.sum("support").alias("support"), (1 - F.product(1 - F.col("best"))).alias("union"))
    ranked = values.withColumns(
        {
            "nth": F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("support"), "value")),
            "total": F.sum("support").over(Window.partitionBy("entity")),
            "next": F.lead("support", 1, 0.0).over(Window.partitionBy("entity").orderBy(F.desc("support"), "value")),
        }
    ).where("nth = 1")
    agreement = F.col("support") / F.col("total")
    return ranked.select(
        "entity", "value", half_up(F.col("union") * agreement * agreement, 4).alias("confidence"), half_up(agreement, 4).alias("agreement"),
        ((agreement < 0.67) | (F.col("next") >= F.col("support") * 0.5)).alias("conflicted"),
    )


def fuse_numeric(df: DataFrame, tolerance: float, digits: int = 3) -> DataFrame:
    """(entity, value, support, members): the weighted mean of the strongest cluster of values within tolerance of one of
    them, from (entity, value, source, confidence, weight).

    A range frame gathers each anchor's cluster, so no pairs are made. Of equally strong clusters the lower wins."""
    rows = valid_evidence(df).withColumn("s", F.col("confidence") * F.col("weight"))
    near = lambda x: F.expr(f"{x} over (partition by entity order by value range between {float(tolerance)} preceding and {float(tolerance)} following)")
    clusters = rows.select("entity", "value", near("sum(s)").alias("support"), near("sum(s * value)").alias("moment"), near("count(1)").alias("members"))
    best = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc(half_up("support", 9)), "value"))
    won = clusters.withColumn("nth", best).where("nth = 1")
    return won.select("entity", half_up(F.col("moment") / F.col("support"), digits).alias("value"), half_up("support", 4).alias("support"), "members")


def positionwise_mean(df: DataFrame, entity: str, values: str, weight: str) -> DataFrame:
    """(entity, pos, value): weighted mean of ragged arrays, element by element over the arrays that have one there."""
    spread = df.select(entity, weight, F.posexplode(values).alias("pos", "x"))
    return spread.groupBy(entity, "pos").agg(half_up(F.sum(F.col("x") * F.col(weight)) / F.sum(weight), 4).alias("value"))
