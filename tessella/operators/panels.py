"""Ratings of variants by panels: valid and distinct ratings, preferences with intervals, cohorts, joint scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import clamp, half_up, wilson


def valid_ratings(ratings: DataFrame, cases: DataFrame) -> DataFrame:
    """Ratings (seq, case_id, rater, preferred, confidence) of a known case (case_id, variants) whose preference is one of
    its variants or null (a tie); the first of a rater on a case counts."""
    met = ratings.join(cases.select("case_id", "variants"), "case_id").where(F.col("preferred").isNull() | F.array_contains("variants", F.col("preferred")))
    nth = F.row_number().over(Window.partitionBy("case_id", "rater").orderBy("seq"))
    return met.withColumn("nth", nth).where("nth = 1").drop("nth")


def preferences(valid: DataFrame) -> DataFrame:
    """(variant, comparisons, wins, ties, rate, low, high, confidence): a tie is half a win for either side."""
    spread = valid.select(F.explode("variants").alias("variant"), "preferred", "confidence")
    g = spread.groupBy("variant").agg(
        F.count(F.lit(1)).alias("comparisons"), F.count_if(F.col("preferred") == F.col("variant")).alias("wins"), F.count_if(F.col("preferred").isNull()).alias("ties"), F.avg("confidence").alias("c")
    )
    won = F.col("wins") + F.col("ties") * 0.5
    g = g.withColumn("w", wilson(won, F.col("comparisons")))
    return g.select("variant", "comparisons", "wins", "ties", half_up(won / F.col("comparisons"), 6).alias("rate"), "w.low", "w.high", half_up("c", 6).alias("confidence"))


def cohort_winners(df: DataFrame, cohort: str, item: str, score: str) -> DataFrame:
    """(cohort, winner): the best item of each cohort, the smaller of equals."""
    nth = F.row_number().over(Window.partitionBy(cohort).orderBy(F.desc(score), item))
    return df.withColumn("nth", nth).where("nth = 1").select(cohort, F.col(item).alias("winner"))


def overall_winner(df: DataFrame, item: str, score: str, listeners: str) -> DataFrame:
    """One row: the item with the best listener-weighted mean, and that mean."""
    g = df.groupBy(item).agg(half_up(F.sum(F.col(score) * F.col(listeners)) / F.sum(listeners), 6).alias("mean"))
    return g.orderBy(F.desc("mean"), item).limit(1)


def joint_scores(variants: DataFrame, prefs: DataFrame, least: int = 5) -> DataFrame:
    """(variant, human_weight, joint): a technical score that a panel of enough answers moves by half at most."""
    strength = clamp((F.col("comparisons") - least + 1) / (least * 3.0))
    weight = F.when(F.col("comparisons") >= least, half_up(F.least(F.lit(0.5), strength * F.col("confidence") * 0.5))).otherwise(0.0)
    met = variants.join(prefs, "variant", "left").withColumn("human_weight", F.coalesce(weight, F.lit(0.0)))
    joint = F.when(F.col("human_weight") > 0, F.col("technical") * (1 - F.col("human_weight")) + F.col("rate") * 100 * F.col("human_weight")).otherwise(F.col("technical"))
    return met.select("variant", "human_weight", half_up(joint, 1).alias("joint"))


def panel_size(valid: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: ratings, raters, and the share of cases that have one."""
    rated = valid.agg(F.count(F.lit(1)).alias("ratings"), F.countDistinct("rater").alias("raters"), F.countDistinct("case_id").alias("rated"))
    total = cases.agg(F.greatest(F.countDistinct("case_id"), F.lit(1)).alias("cases"))
    return rated.join(F.broadcast(total)).select("ratings", "raters", half_up(F.col("rated") / F.col("cases"), 6).alias("coverage"))  # one row each


def promotion_gate(summary: DataFrame, ratings: int = 30, raters: int = 10, coverage: float = 0.8) -> DataFrame:
    from ..functions.scalars import all_failed

    gates = [(f"need-{ratings}-ratings", F.col("ratings") >= ratings), (f"need-{raters}-raters", F.col("raters") >= raters), ("coverage", F.col("coverage") >= coverage)]
    return summary.select("*", F.array_join(all_failed(gates), ",").alias("reasons"))


def disagreement(df: DataFrame, item: str, scores: Sequence[str], top: int) -> DataFrame:
    """(item, spread): the items on which several scores differ most."""
    spread = half_up(F.greatest(*scores) - F.least(*scores), 6)
    return df.select(item, spread.alias("spread")).orderBy(F.desc("spread"), item).limit(top)
