"""Joining what is known of tracks: genres by provenance, recipes, cuts, sources, ranked candidates, profiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.knowledge import RELIABILITY
from ..functions.scalars import HALF, clamp, half_up, noisy_or
from .folds import ordered_fold, rounded
from .joins import points_in_windows
from .signals import query_blocks
from .studies import looked_up


def fused_genres(df: DataFrame, key: str) -> DataFrame:
    """(key, genre, weight) from (key, genre, confidence, source): the chance that one of the sources is right."""
    named = df.withColumn("genre", F.lower(F.trim("genre"))).where("genre <> ''")
    return named.groupBy(key, "genre").agg(half_up(noisy_or(clamp("confidence") * looked_up(F.col("source"), RELIABILITY, 0.0)), 6).alias("weight"))


def similar_recipes(vectors: DataFrame, key: str, vector: str, wanted: Column, top: int, width: int) -> DataFrame:
    """(a, b, distance): for each vector that is wanted (a condition on k, its key) the nearest others by the sum of the
    distances of their parts of a width, the smaller key first among equals. The queries go out in blocks of a bounded size to
    where the others lie, and a batch sends on top rows for each; so the table is read once a block."""
    narrow = vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))

    def run_with(held) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, own = held.value
            for pdf in batches:
                if not len(pdf) or not len(ids):
                    continue
                v, b = np.stack(pdf["v"].map(np.asarray).tolist()), pdf["k"].to_numpy()
                for a, x in zip(ids, own, strict=True):
                    apart = np.sqrt(((v - x) ** 2).reshape(len(v), -1, width).sum(axis=2)).sum(axis=1)
                    apart = np.where(b == a, np.inf, np.floor(apart * 1e6 + HALF) / 1e6)
                    best = np.lexsort((b, apart))[:top]
                    best = best[np.isfinite(apart[best])]
                    yield pd.DataFrame({"a": a, "b": b[best], "distance": apart[best]})

        return run

    found = [narrow.mapInPandas(run_with(held), "a long, b long, distance double") for held in query_blocks(narrow, wanted)]
    nth = F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))
    return reduce(DataFrame.union, found).withColumn("nth", nth).where(F.col("nth") <= top).drop("nth")


def structural_cuts(cuts: DataFrame, sections: DataFrame, depends: DataFrame, item: str, key: str, at: str, width: float) -> DataFrame:
    """(item, penalty, blocked, unresolved) of cuts (item, key, at): the strongest promise of the section that is cut to one
    that begins later. sections: (key, section, w_start, w_end); depends: (key, section, target, strength)."""
    inside = points_in_windows(cuts, sections, key, at, width).select(item, key, at, "section")
    starts = sections.select(key, F.col("section").alias("target"), F.col("w_start").alias("target_start"))
    open_ = inside.join(depends, [key, "section"]).join(starts, [key, "target"]).where(F.col("target_start") >= F.col(at))
    g = open_.groupBy(item).agg(F.max("strength").alias("p"), F.count(F.lit(1)).alias("n"))
    p = F.coalesce("p", F.lit(0.0))
    return cuts.join(g, item, "left").select(item, half_up(p).alias("penalty"), (p >= 0.8).alias("blocked"), F.coalesce("n", F.lit(0)).alias("unresolved"))


def playback_sources(wanted: DataFrame, offers: DataFrame) -> DataFrame:
    """(recording, source, reason): of the allowed offers (recording, source, lossless, allowed) of a granted recording a
    lossless one before others, the smallest first."""
    best = offers.where("allowed").groupBy("recording").agg(F.min(F.struct(F.when(F.col("lossless"), 0).otherwise(1).alias("o"), "source")).alias("b"))
    met = wanted.join(best, "recording", "left")
    source = F.when(F.col("granted"), F.col("b.source"))
    reason = F.when(~F.col("granted"), "recording-rights-denied").when(source.isNull(), "no-compatible-source").otherwise("resolved")
    return met.select("recording", source.alias("source"), reason.alias("reason"))


def ranked_candidates(own: DataFrame, routes: DataFrame, overrides: DataFrame, keys: Sequence[str], item: str, most: int) -> DataFrame:
    """(keys, item, score): the best candidates (own) by their route's score where there is one, half their own score where
    there is none, and by an override above all."""
    on = [*keys, item]
    met = own.join(routes, on, "left").join(overrides, on, "left")
    score = half_up(F.coalesce("forced", F.coalesce("route", F.col("own") * 0.5) * 0.6 + F.col("own") * 0.4))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), item))
    return met.select(*on, score.alias("score")).withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def evolving_profiles(df: DataFrame, key: str, order: Sequence[str], tastes: Sequence[str], rate: float = 0.2) -> DataFrame:
    """(key, version, tastes): a saved profile that each observation moves by a rate, the first one setting it."""

    def step(a: tuple, *x: float) -> tuple:
        n, old = a
        return n + 1, x if n == 0 else tuple(rounded(p * (1 - rate) + q * rate) for p, q in zip(old, x, strict=True))

    out = "version long, " + ", ".join(f"{t} double" for t in tastes)
    return ordered_fold(df, key, order, tastes, (0, ()), step, lambda a: (a[0], *(rounded(x) for x in a[1])), out)


def history(df: DataFrame, key: str, order: str, item: str, most: int) -> DataFrame:
    """(key, previous, back): the entries before the latest, back counting from one, so many at most."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("nth", nth).where((F.col("nth") > 1) & (F.col("nth") <= most + 1)).select(key, F.col(item).alias("previous"), (F.col("nth") - 1).alias("back"))
