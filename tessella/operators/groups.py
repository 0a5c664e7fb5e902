"""Groups of people: satisfaction, fairness, shared taste."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import clamp, half_up, share

#: Minimum satisfaction below which a member counts as miserable.
MISERY = 0.18


def polarization(value: str, key: str, df: DataFrame) -> DataFrame:
    """(key, polarization): twice the root mean square distance from the mean; zero for a single value. Values are clamped,
    the mean is that of the raw ones."""
    mean = df.groupBy(key).agg(F.avg(value).alias("m"), F.count(value).alias("n"))
    spread = df.join(mean, key).groupBy(key).agg(F.avg(F.pow(clamp(value) - F.col("m"), 2)).alias("v"), F.first("n").alias("n"))
    return spread.select(key, half_up(F.when(F.col("n") < 2, 0.0).otherwise(clamp(2 * F.sqrt("v")))).alias("polarization"))


def group_satisfaction(df: DataFrame, key: str, phase: str = "build") -> DataFrame:
    """(key, score, mean, minimum, maximum, polarization, penalty, fairness_bonus) from active members' satisfaction,
    fairness_debt and approved: six ways to aggregate, blended by weights that depend on phase, size and polarization."""
    rows = df.where("active").withColumn("v", clamp("satisfaction"))
    fair = F.avg(clamp("fairness_debt") * F.col("v")) * 0.35
    grouped = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"), F.var_pop("v").alias("var"),
        share(F.count_if("approved"), F.count(F.lit(1))).alias("approval"), F.coalesce(F.avg(F.when(F.col("v") >= MISERY, F.col("v"))), F.lit(0.0)).alias("spared"), fair.alias("bonus"),
    )
    polar = half_up(F.when(F.col("n") < 2, 0.0).otherwise(clamp(2 * F.sqrt("var"))))
    peak, calm = phase == "peak", phase in ("breather", "reset", "cooldown")
    weights: list[tuple[Column, Column]] = [
        (F.col("mean"), F.lit(0.3 if peak else 0.25)),
        (F.col("low"), F.when(F.col("polarization") > 0.55, 0.25).otherwise(0.12)),
        (F.col("high"), F.lit(0.2 if peak else 0.08)),
        (F.col("spared"), F.when(F.col("n") <= 6, 0.18).otherwise(0.1)),
        (F.col("approval"), F.when(F.col("n") >= 4, 0.12).otherwise(0.05)),
        (clamp(F.col("mean") + F.col("bonus")), F.lit(0.4 if calm else 0.1 if peak else 0.25)),
    ]
    total, weight = sum((x * w for x, w in weights), F.lit(0.0)), sum((w for _, w in weights), F.lit(0.0))
    penalty = F.when(F.col("low") < MISERY, (MISERY - F.col("low")) / MISERY * 0.35).otherwise(0.0)
    return grouped.withColumn("polarization", polar).select(
        key, half_up(clamp(total / weight - penalty)).alias("score"), half_up("mean").alias("mean"), half_up("low").alias("minimum"), half_up("high").alias("maximum"),
        "polarization", half_up(penalty).alias("penalty"), half_up("bonus").alias("fairness_bonus"),
    )


def fairness_window(df: DataFrame, now_ms: int, minutes: int = 30, tracks: int = 10) -> DataFrame:
    """(user_id, representation, debt) over the last tracks (by when they were first seen) of the last minutes, from
    (seq, at_ms, track_id, user_id, expected, observed, represented)."""
    recent = df.where(F.col("at_ms") >= now_ms - minutes * 60_000)
    first = recent.groupBy("track_id").agg(F.min("seq").alias("first")).orderBy(F.desc("first")).limit(tracks)
    rows = recent.join(first, "track_id", "left_semi")
    grouped = rows.groupBy("user_id").agg(share(F.count_if("represented"), F.count(F.lit(1))).alias("r"), F.avg(clamp("expected") - clamp("observed")).alias("gap"))
    debt = clamp((1 - F.col("r")) * 0.7 + F.greatest(F.lit(0.0), F.col("gap")) * 0.3)
    return grouped.select("user_id", half_up("r").alias("representation"), half_up(debt).alias("debt"))


def crowd_taste(df: DataFrame) -> DataFrame:
    """(genre, consensus, mean, minimum, maximum, variance, shared, contested) from (user_id, genre, affinity): a genre a
    member does not name counts as zero, without making those rows."""
    members = df.agg(F.countDistinct("user_id").alias("members"))  # one row
    v = clamp("affinity")
    per = df.groupBy("genre").agg(F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(F.lit(1)).alias("n"))
    joined = per.join(F.broadcast(members))
    mean = F.col("s") / F.col("members")
    low = F.when(F.col("n") < F.col("members"), F.lit(0.0)).otherwise(F.col("lo"))
    return joined.select(
        "genre", half_up(mean * 0.55 + low * 0.45).alias("consensus"), half_up(mean).alias("mean"), half_up(low).alias("minimum"), half_up("hi").alias("maximum"),
        half_up(F.col("q") / F.col("members") - mean * mean, 6).alias("variance"), (low >= 0.55).alias("shared"), (F.col("hi") - low >= 0.5).alias("contested"),
    )


def crowd_score(tastes: DataFrame, affinities: DataFrame, debts: DataFrame) -> DataFrame:
    """(track_id, score, average, minimum, fairness_boost, contested_penalty): what a crowd makes of each track. A member's
    score is the taste-weighted mean of the track's affinities; what is owed to members lifts what they like, genres that
    split the crowd cost. tastes: (user_id, genre, affinity); affinities: (track_id, genre, fit), a genre not named counts
    zero; debts: (user_id, debt)."""
    weight = tastes.groupBy("user_id").agg(F.sum("affinity").alias("w"))
    met = tastes.join(affinities, "genre").groupBy("track_id", "user_id").agg(F.sum(F.col("fit") * F.col("affinity")).alias("t"))
    scored = met.join(weight, "user_id").join(debts, "user_id", "left").withColumn("x", clamp(F.col("t") / F.when(F.col("w") == 0, 1.0).otherwise(F.col("w"))))
    members = tastes.agg(F.countDistinct("user_id").alias("members"))  # one row
    split = crowd_taste(tastes).where("contested").select("genre", half_up(F.col("maximum") - F.col("minimum")).alias("gap"))
    contested = affinities.join(split, "genre").groupBy("track_id").agg(F.sum(F.col("fit") * F.col("gap")).alias("c"))
    n_split = split.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n_split"))  # one row
    owed = F.sum(F.coalesce("debt", F.lit(0.0)) * F.col("x")).alias("b")
    grouped = scored.groupBy("track_id").agg(F.sum("x").alias("s"), F.min("x").alias("lo"), F.count(F.lit(1)).alias("n"), owed).join(contested, "track_id", "left")
    grouped = grouped.join(F.broadcast(members)).join(F.broadcast(n_split))
    low = F.when(F.col("n") < F.col("members"), F.lit(0.0)).otherwise(F.col("lo"))
    mean, boost, cost = F.col("s") / F.col("members"), F.col("b") / F.col("members"), F.coalesce("c", F.lit(0.0)) / F.col("n_split")
    return grouped.select(
        "track_id", half_up(clamp(mean * 0.45 + low * 0.35 + boost * 0.25 - cost * 0.15)).alias("score"), half_up(mean).alias("average"), half_up(low).alias("minimum"), half_up(boost).alias("fairness_boost"), half_up(cost).alias("contested_penalty")
    )


def fatigue(df: DataFrame, key: str, last: int = 8) -> DataFrame:
    """(key, energy_fatigue, novelty_fatigue, repetition) over the last rows of each key, from (seq, energy, novelty, genre,
    reaction): means and the share of the most frequent genre, times the drop of the reaction from first to last."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))
    recent = df.withColumn("nth", nth).where(F.col("nth") <= last)
    genres = recent.groupBy(key, "genre").agg(F.count(F.lit(1)).alias("c")).groupBy(key).agg(F.max("c").alias("top"))
    grouped = recent.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg("energy").alias("e"), F.avg("novelty").alias("v"), F.min_by("reaction", "seq").alias("a"), F.max_by("reaction", "seq").alias("z")
    )
    drop = F.when(F.col("n") > 1, clamp(F.col("a") - F.col("z") + 0.5)).otherwise(0.0)
    return grouped.join(genres, key).select(
        key, half_up(clamp(F.col("e") * drop)).alias("energy_fatigue"), half_up(clamp(F.col("v") * drop)).alias("novelty_fatigue"), half_up(clamp(F.col("top") / F.col("n") * drop)).alias("genre_fatigue")
    )


def taste_compatibility(df: DataFrame, left: str, right: str) -> DataFrame:
    """df with score (mean closeness over the keys of either sparse vector, missing as zero) and shared (keys at 0.55 or
    more in both)."""
    closeness = F.map_values(F.map_zip_with(left, right, lambda k, a, b: 1 - F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)))))
    mean = F.aggregate(closeness, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(closeness), F.lit(1))
    both = F.map_filter(F.map_zip_with(left, right, lambda k, a, b: F.least(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0)))), lambda k, x: x >= 0.55)
    return df.withColumns({"score": half_up(mean), "shared": F.array_sort(F.map_keys(both))})


def taste_drift(df: DataFrame, before: str, recent: str, threshold: float = 0.22, digits: int = 3) -> DataFrame:
    """df with drift (a map), magnitude and shifted, which goes by the rounded magnitude."""
    change = F.map_zip_with(before, recent, lambda k, a, b: half_up(F.coalesce(b, F.lit(0.0)) - F.coalesce(a, F.lit(0.0))))
    sizes = F.map_values("drift")
    magnitude = F.aggregate(sizes, F.lit(0.0), lambda s, x: s + F.abs(x)) / F.greatest(F.size(sizes), F.lit(1))
    return df.withColumn("drift", change).withColumn("magnitude", half_up(magnitude, digits)).withColumn("shifted", F.col("magnitude") >= threshold)


def rank_requests(df: DataFrame, now_ms: int) -> DataFrame:
    """Requests with fairness, recency and score, best first. Of: priority, compatibility, votes, created_ms, deadline_ms
    (null: none), host_override, debt and recent (of the requester, null: none)."""
    fairness = clamp(0.55 + F.coalesce("debt", F.lit(0.0)) * 0.55 - F.coalesce("recent", F.lit(0)) * 0.12)
    recency = clamp(1 - (now_ms - F.col("created_ms")) / (45 * 60_000))
    urgency = F.when(F.col("deadline_ms").isNull(), 0.0).otherwise(clamp(1 - (F.col("deadline_ms") - now_ms) / (30 * 60_000)))
    score = clamp(clamp("priority") * 0.22 + fairness * 0.24 + recency * 0.1 + clamp("compatibility") * 0.22 + clamp(F.col("votes") / 8) * 0.12 + urgency * 0.1)
    scored = df.withColumns({"fairness": half_up(fairness), "recency": half_up(recency), "score": half_up(F.when(F.col("host_override"), 1.0).otherwise(score))})
    return scored.orderBy(F.desc("score"), "created_ms")


def crowd_intent(df: DataFrame) -> DataFrame:
    """(cluster, members, valence, arousal, weight): wishes by quadrant, as confidence-weighted centres whose denominator is
    one at least, which draws small groups towards zero."""
    c = clamp("confidence")
    quadrant = F.concat_ws("-", F.when(F.col("valence") >= 0, "positive").otherwise("negative"), F.when(F.col("arousal") >= 0.5, "high").otherwise("low"))
    total = df.agg(F.greatest(F.sum(c), F.lit(1.0)).alias("total"))  # one row
    g = df.groupBy(quadrant.alias("cluster")).agg(F.count(F.lit(1)).alias("members"), F.sum(c).alias("w"), F.sum(F.col("valence") * c).alias("v"), F.sum(F.col("arousal") * c).alias("a"))
    low = F.greatest("w", F.lit(1.0))
    return g.join(F.broadcast(total)).select(
        "cluster", "members", half_up(F.col("v") / low).alias("valence"), half_up(clamp(F.col("a") / low)).alias("arousal"), half_up(F.col("w") / F.col("total")).alias("weight")
    )


def intent_polarization(clusters: DataFrame) -> DataFrame:
    """One row: the largest weighted distance of two cluster centres (of four at most)."""
    one = clusters.agg(F.collect_list(F.struct("valence", "arousal", "weight")).alias("c"))
    far = lambda x, y: (F.abs(x["valence"] - y["valence"]) / 2 + F.abs(x["arousal"] - y["arousal"])) / 2 * F.least(F.lit(1.0), (x["weight"] + y["weight"]) * 1.5)
    worst = F.array_max(F.flatten(F.transform("c", lambda x: F.transform("c", lambda y: far(x, y)))))
    return one.select(half_up(clamp(F.coalesce(worst, F.lit(0.0)))).alias("polarization"))


def cohesion(df: DataFrame, key: str) -> DataFrame:
    """(key, consensus, engagement, synchrony, confidence) of reactions (member, at_ms, direction, engagement)."""
    mean = df.groupBy(key).agg(F.avg("direction").alias("m"))
    g = df.join(mean, key).groupBy(key).agg(
        F.avg(F.abs(F.col("direction") - F.col("m"))).alias("d"), F.avg("engagement").alias("e"), (F.max("at_ms") - F.min("at_ms")).alias("t"), F.countDistinct("member").alias("n")
    )
    return g.select(
        key, half_up(clamp(1 - F.col("d") / 2)).alias("consensus"), half_up(clamp("e")).alias("engagement"), half_up(clamp(1 - F.col("t") / 30_000)).alias("synchrony"), half_up(clamp(F.col("n") / 6)).alias("confidence")
    )


def group_taste(df: DataFrame, key: str) -> DataFrame:
    """(key, score, minimum, fairness): average and least projected satisfaction, debts repaid, requests and hosts weighed."""
    p = clamp(F.col("satisfaction") * 0.45 + F.col("affinity") * 0.55)
    g = df.groupBy(key).agg(
        F.avg(p).alias("m"), F.min(p).alias("lo"), (F.avg(F.col("debt") * F.col("affinity")) * 0.2).alias("f"), F.avg(F.when(F.col("requested"), 0.08).otherwise(0.0)).alias("r"),
        F.avg(F.when(F.col("host") & (F.col("affinity") < 0.25), 0.2).otherwise(0.0)).alias("h"),
    )
    score = clamp(F.col("m") * 0.55 + F.col("lo") * 0.35 + F.col("f") + F.col("r") - F.col("h"))
    return g.select(key, half_up(score, 6).alias("score"), half_up("lo", 6).alias("minimum"), half_up("f", 6).alias("fairness"))
