"""Choosing the move from one track to the next, by what is heard and what earlier moves were told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.moves import Pair, buckets, candidates
from ..functions.scalars import clamp, half_up
from ..sources.tables import spread

# What the bias of feedback is made of, how much its keys weigh, and what the base plan has ahead.
SCORE, FALLBACK, NEGATIVE, BIAS = (82.0, 0.45), 18.0, 28.0, (-24.0, 12.0)
FIRST, FURTHER = 0.4, 0.2
KEYS = 4
BASE_BONUS, MARGIN = 3.0, 4.0


def feedback_profile(records: DataFrame, move: str, gap_pct: Column, key_score: Column, stretch_pct: Column, least: int = 6) -> DataFrame:
    """(key, bias) of records with score, fallback and negative: one scan, a record counts under each of its four keys."""
    keyed = records.select("score", "fallback", "negative", F.explode(F.array(*buckets(F.col(move), gap_pct, key_score, stretch_pct))).alias("key"))
    rate = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double"))
    g = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("avg"), rate("fallback").alias("f"), rate("negative").alias("g"))
    raw = (F.col("avg") - SCORE[0]) * SCORE[1] - F.col("f") * FALLBACK - F.col("g") * NEGATIVE
    return g.select("key", half_up(clamp(raw, *BIAS) * clamp(F.col("n") / least), 1).alias("bias"))


def ranked_moves(pairs: DataFrame, key: str, pair: Pair, feedback: DataFrame) -> DataFrame:
    """(key, move, score, musical, bias, place): all moves that a pair can make, the best first. The keys of a move that are
    known bias it: the first of them most. feedback has a row for each bucket of each move, so it is sent to all tasks, and
    the pairs meet it where they are. A pair can always fade, so none is without a move. Pairs are dealt out before their moves
    are made: however few files they come in, all cores make moves, and those of a pair are ranked where they are made."""
    made = spread(pairs, key).select(key, pair.base.alias("base"), F.explode_outer(candidates(pair)).alias("c")).select(key, "base", "c.move", "c.musical", "c.keys")
    told = [f"_told_{k}" for k in range(KEYS)]
    for k, name in enumerate(told):
        known = feedback.select(F.col("key").alias(f"_key_{k}"), F.col("bias").alias(name))
        made = made.withColumn(f"_key_{k}", F.col("keys")[k]).join(F.broadcast(known), f"_key_{k}", "left").drop(f"_key_{k}")
    first = F.coalesce(*told)
    bias = half_up(sum((F.coalesce(F.col(x) * FURTHER, F.lit(0.0)) for x in told), F.lit(0.0)) + first * (FIRST - FURTHER), 1)
    made = made.withColumn("bias", bias)
    score = half_up(F.col("musical") + F.coalesce("bias", F.lit(0.0)) + F.when(F.col("move") == F.col("base"), BASE_BONUS).otherwise(0.0), 1)
    met = made.drop("keys", *told).withColumns({"score": score, "bias": F.coalesce("bias", F.lit(0.0))})
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "move"))
    return met.select(key, "move", "score", "musical", "bias", "base", place.alias("place"))


def preferred_moves(ranked: DataFrame, key: str) -> DataFrame:
    """(key, move, switched): the base plan, unless another move is better by the margin."""
    g = ranked.groupBy(key).agg(F.min_by(F.struct("move", "score"), "place").alias("best"), F.first("base").alias("base"), F.max(F.when(F.col("move") == F.col("base"), F.col("score"))).alias("own"))
    better = (F.col("best.move") != F.col("base")) & F.col("own").isNotNull() & (half_up(F.col("best.score") - F.col("own"), 6) >= MARGIN)
    return g.select(key, F.when(better, F.col("best.move")).otherwise(F.col("base")).alias("move"), F.coalesce(better, F.lit(False)).alias("switched"))
