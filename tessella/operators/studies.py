"""Group measures, state and evidence of sessions: consensus, budgets, fatigue, charts, presence, readiness."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import clamp, half_up
from ..sources.tables import stored
from .folds import ordered_fold, rounded
from .neighbours import best_partners

DAY_MS = 86_400_000
# What moves cost, signals and levels weigh, and how far a source of an analysis is trusted.
EFFECTS = {
    "fade": 0.1, "blend": 0.18, "cut": 0.35, "echo": 0.42, "filter": 0.55, "bassdrop": 0.78, "gate": 0.8, "riser": 0.82, "spinback": 0.92, "roll": 0.92, "acapella": 1.0,
}
#: In hundredths, so that sums are exact.
ARTIST_SIGNALS = {
    "passive-stream": 2, "completion": 8, "repeat": 13, "save": 18, "playlist-add": 25, "artist-page": 22, "manual-second-track": 28, "album-exploration": 30,
    "concert-merch": 35, "intentional-session": 40,
}
STAGES = ("discovered", "curious", "returning", "fan", "core-fan")
PROVENANCE = {
    "official-metadata": 0.75, "provider-analysis": 0.65, "own-model": 0.6, "user-correction": 0.95, "dj-correction": 1.0, "midi": 0.85, "official-stems": 0.9,
}
#: From the weakest on.
LEVELS = {"hypothesis": 0.25, "experimental": 0.55, "supported": 0.8, "established": 1.0}


def looked_up(key: Column, table: dict[str, float], otherwise: float) -> Column:
    return F.coalesce(*(F.when(key == k, F.lit(v)) for k, v in table.items()), F.lit(otherwise))


def leading(df: DataFrame, keys: Sequence[str], score: Column | str, tie: str, take: Sequence[str], keep: Column | None = None, digits: int = 9) -> DataFrame:
    """(keys, take, score): the row with the best score of each key, the smaller tie first among equals.

    A maximum, so partial results are combined before the shuffle, however many rows a key has."""
    rows = df if keep is None else df.where(keep)
    found = rows.groupBy(*keys).agg(F.min(F.struct((-half_up(score, digits)).alias("o"), F.col(tie).alias("t"), *(F.col(c).alias(f"c_{c}") for c in take))).alias("b"))
    return found.select(*keys, *(F.col(f"b.c_{c}").alias(c) for c in take), (-F.col("b.o")).alias("score"))


def consensus(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, consensus, mean, penalty): the mean of satisfactions less what their polarization costs."""
    g = df.groupBy(key).agg(F.avg(clamp(value)).alias("m"), F.var_pop(clamp(value)).alias("v"), F.count(value).alias("n"))
    penalty = half_up(F.when(F.col("n") < 2, 0.0).otherwise(clamp(2 * F.sqrt("v")))) * 0.45
    return g.select(key, half_up(clamp(F.col("m") - penalty)).alias("consensus"), half_up("m").alias("mean"), half_up(penalty).alias("penalty"))


def cross_dataset(df: DataFrame, pair: str, valence: str, arousal: str, error: str) -> DataFrame:
    """One row (robust, mean_valence, mean_arousal, mean_error, weakest) over results of pairs of datasets."""
    worst = F.min(F.struct(half_up(F.col(valence) + F.col(arousal) - F.col(error), 9).alias("s"), F.col(pair).alias("p")))
    g = df.agg(F.avg(valence).alias("v"), F.avg(arousal).alias("a"), F.avg(error).alias("e"), worst.alias("w"))
    robust = F.coalesce((F.col("v") >= 0.5) & (F.col("a") >= 0.65) & (F.col("e") <= 0.2), F.lit(False))
    return g.select(robust.alias("robust"), half_up("v").alias("mean_valence"), half_up("a").alias("mean_arousal"), half_up("e").alias("mean_error"), F.col("w.p").alias("weakest"))


def analyzer_routes(df: DataFrame, every: str = "any") -> DataFrame:
    """(domain, section, analyzer, reliability) from (domain, section, analyzer, success, samples): the most reliable
    analyzer of each section, those for every section included; few samples discount it."""
    rows = df.withColumn("r", F.col("success") * F.least(F.lit(1.0), F.col("samples") / 20.0))
    sections = df.where(F.col("section") != every).select("domain", F.col("section").alias("wanted")).distinct()
    reach = rows.where(F.col("section") != every).withColumn("wanted", F.col("section")).unionByName(rows.where(F.col("section") == every).join(sections, "domain"))
    won = leading(reach, ["domain", "wanted"], "r", "analyzer", ["analyzer"])
    return won.select("domain", F.col("wanted").alias("section"), "analyzer", half_up("score").alias("reliability"))


def pairwise_mixes(df: DataFrame, key: str, preferred: str, ratings: Sequence[str]) -> DataFrame:
    """(key, winner, share_a, n, means of the ratings): preferences for A or B; anything else is half for each."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(preferred) == "A").alias("a"), F.count_if(F.col(preferred) == "B").alias("b"), *(half_up(F.avg(c)).alias(c) for c in ratings))
    winner = F.when(F.col("a") == F.col("b"), "tie").when(F.col("a") > F.col("b"), "A").otherwise("B")
    share = (F.col("a") + (F.col("n") - F.col("a") - F.col("b")) * 0.5) / F.col("n")
    return g.select(key, winner.alias("winner"), half_up(share, 6).alias("share_a"), "n", *ratings)


def _recent(df: DataFrame, key: str, order: str, last: int) -> DataFrame:
    """The last rows of each key with size, their number, and pos, from 1 for the oldest."""
    w = Window.partitionBy(key)
    recent = df.withColumn("nth", F.row_number().over(w.orderBy(F.desc(order)))).where(F.col("nth") <= last)
    return recent.withColumn("size", F.count(F.lit(1)).over(w)).withColumn("pos", F.col("size") - F.col("nth") + 1)


def novelty_budget(df: DataFrame, key: str, order: str, kind: str, costs: dict[str, float], last: int = 8) -> DataFrame:
    """(key, kind, recent, consecutive, used, remaining, penalty): how much of the patience for a kind of move its uses among
    the last ones have taken; later uses and runs at the end weigh more."""
    w = Window.partitionBy(key)
    recent = _recent(df, key, order, last).withColumn("final", F.max_by(kind, "pos").over(w))
    recent = recent.withColumn("run", F.col("size") - F.coalesce(F.max(F.when(F.col(kind) != F.col("final"), F.col("pos"))).over(w), F.lit(0)))
    g = recent.groupBy(key, kind).agg(
        F.count(F.lit(1)).alias("recent"), (F.sum("pos") / F.max("size")).alias("hits"), F.max(F.when(F.col(kind) == F.col("final"), F.col("run")).otherwise(0)).alias("consecutive")
    )
    used = clamp(F.col("hits") / 2.4 + F.greatest(F.lit(0), F.col("consecutive") - 1) * 0.22)
    penalty = clamp(used * looked_up(F.col(kind), costs, 0.5))
    return g.select(key, kind, "recent", F.col("consecutive").cast("long").alias("consecutive"), half_up(used).alias("used"), half_up(1 - penalty).alias("remaining"), half_up(penalty).alias("penalty"))


#: Shares of the parts of session fatigue (fixed values), in the order in which equal parts are named.
FATIGUE = {"artist": 0.13, "genre": 0.14, "transition": 0.17, "vocal": 0.15, "energy": 0.14, "effect": 0.13, "tempo": 0.08, "key": 0.06}


def session_fatigue(df: DataFrame, key: str, order: str, costs: dict[str, float]) -> DataFrame:
    """(key, the eight parts of FATIGUE, total, dominant) from (order, artist, genre, transition, musical_key, vocal, energy,
    bpm): repetition of names, flatness of numbers, and the load of vocals and effects over the last rows of each key."""
    w = Window.partitionBy(key)
    rows = _recent(df, key, order, 8)
    near = lambda n: F.col("nth") <= n
    times = rows
    for c, n in (("artist", 8), ("genre", 8), ("musical_key", 8), ("transition", 6)):
        times = times.withColumn(f"n_{c}", F.count(F.when(near(n), 1)).over(Window.partitionBy(key, c)))
    times = times.withColumn("calm", F.min(F.when(near(6) & (F.col("vocal") < 0.6), F.col("nth"))).over(w))
    g = times.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(near(6)).alias("n6"),
        *(F.max(f"n_{c}").alias(f"n_{c}") for c in ("artist", "genre", "musical_key", "transition")),
        F.avg(F.when(near(6), F.col("vocal"))).alias("vocals"), F.max("calm").alias("calm"),
        (F.max("energy") - F.min("energy")).alias("energy_range"), (F.max("bpm") - F.min("bpm")).alias("bpm_range"),
        F.avg(F.when(near(6), looked_up(F.col("transition"), costs, 0.5))).alias("effects"),
    )
    repeated = lambda top, n: F.when(n < 2, 0.0).otherwise(clamp((top - 1) / F.greatest(F.lit(1), n - 1)))
    flat = lambda span, tolerance: F.when(F.col("n") < 3, 0.0).otherwise(clamp((1 - span / tolerance) * clamp((F.col("n") - 2) / 4.0)))
    streak = F.coalesce(F.col("calm") - 1, F.col("n6"))
    moves = repeated(F.col("n_transition"), F.col("n6"))
    parts = {
        "artist": repeated(F.col("n_artist"), F.col("n")),
        "genre": repeated(F.col("n_genre"), F.col("n")),
        "transition": moves,
        "vocal": clamp(F.greatest(F.lit(0.0), (F.col("vocals") - 0.48) / 0.42) * 0.7 + streak / 6.0 * 0.3),
        "energy": flat(F.col("energy_range"), 0.28),
        "effect": clamp(F.col("effects") * 0.7 + moves * 0.3),
        "tempo": flat(F.col("bpm_range"), 14.0),
        "key": repeated(F.col("n_musical_key"), F.col("n")),
    }
    g = g.withColumns({f"p_{n}": x for n, x in parts.items()})
    total = reduce(lambda a, b: a + b, (F.col(f"p_{n}") * share for n, share in FATIGUE.items()))
    top = F.array_min(F.array(*(F.struct((-half_up(f"p_{n}", 9)).alias("o"), F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in enumerate(FATIGUE))))
    return g.select(key, *(half_up(f"p_{n}").alias(n) for n in FATIGUE), half_up(total).alias("total"), top["n"].alias("dominant"))


def artist_stages(df: DataFrame, key: str, signal: str, stages: DataFrame) -> DataFrame:
    """(key, stage, affinity, repeats, confidence, relationship): how signals move a relationship on; stages: (key, stage,
    affinity, confidence) as it was."""
    weights = {k: v for k, v in ARTIST_SIGNALS.items()}
    g = df.groupBy(key).agg(F.sum(looked_up(F.col(signal), weights, 0).cast("long")).alias("w"), F.count_if(F.col(signal).isin("repeat", "intentional-session")).alias("again"), F.count(F.lit(1)).alias("n"))
    value = clamp(F.coalesce("w", F.lit(0)) / 100.0)
    at = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")) - 1
    step = F.when(value >= 0.6, 2).when(value >= 0.2, 1).otherwise(0)
    stage = F.element_at(F.array(*map(F.lit, STAGES)), (F.least(F.lit(len(STAGES) - 1), at + step) + 1).cast("int"))
    return stages.join(g, key, "left").select(
        key, stage.alias("stage"), half_up(clamp(F.col("affinity") + value * 0.2)).alias("affinity"), half_up(clamp(F.coalesce("again", F.lit(0)) * 0.1)).alias("repeats"),
        half_up(clamp(F.col("confidence") + F.coalesce("n", F.lit(0)) * 0.03)).alias("confidence"), half_up(value).alias("relationship"),
    )


def group_utility(df: DataFrame, key: str) -> DataFrame:
    """(key, least_misery, most_pleasure, approval, fair_share, consensus, average) of (utility, approved, debt, weight): the
    utility of a group by each way to aggregate."""
    u, debt, w = clamp("utility"), clamp(F.coalesce("debt", F.lit(0.0))), F.greatest(F.lit(0.0), F.coalesce("weight", F.lit(1.0)))
    return df.groupBy(key).agg(
        half_up(F.min(u)).alias("least_misery"), half_up(F.max(u)).alias("most_pleasure"), half_up(F.count_if("approved") / F.count(F.lit(1))).alias("approval"),
        half_up(F.sum(u * (1 + debt)) / F.sum(1 + debt)).alias("fair_share"), half_up(F.sum(u * w) / F.greatest(F.lit(1.0), F.sum(w))).alias("consensus"), half_up(F.avg(u)).alias("average"),
    )


def fairness_gap(df: DataFrame, key: str, balance: str, report: str) -> DataFrame:
    """(key, computed, perceived, gap): what a group reports against what was computed; null without reports."""
    g = df.groupBy(key).agg(F.avg(balance).alias("b"), F.avg(clamp(report)).alias("p"))
    return g.select(key, half_up(clamp("b")).alias("computed"), half_up("p").alias("perceived"), half_up(F.abs(F.col("b") - F.col("p"))).alias("gap"))


def genre_bias(df: DataFrame, genre: str, sample: str, valence_error: str, arousal_error: str) -> DataFrame:
    """(genre, multiplier, dominance, cross_validate): what the errors of a genre and the share of the largest one leave of
    the confidence."""
    sums = df.agg(F.sum(sample).alias("total"), F.max(sample).alias("top"))  # one row
    share, error = F.when(F.col("total") > 0, F.col("top") / F.col("total")).otherwise(1.0), (F.col(valence_error) + F.col(arousal_error)) / 2
    return df.join(F.broadcast(sums)).select(
        genre, half_up(clamp((1 - error) * (1 - F.greatest(F.lit(0.0), share - 0.5) * 0.6))).alias("multiplier"), half_up(clamp(share)).alias("dominance"), ((share > 0.65) | (error > 0.3)).alias("cross_validate")
    )


def milestones(wanted: DataFrame, done: DataFrame, key: str, item: str) -> DataFrame:
    """(key, complete, total, ratio, missing): how much of what is wanted for each key is done."""
    met = wanted.distinct().join(done.select(item).distinct().withColumn("ok", F.lit(1)), item, "left")
    g = met.groupBy(key).agg(F.count("ok").alias("complete"), F.count(F.lit(1)).alias("total"))
    return g.select(key, "complete", "total", half_up(F.col("complete") / F.col("total"), 6).alias("ratio"), (F.col("total") - F.col("complete")).alias("missing"))


def discovery_personality(df: DataFrame, key: str, slider: str, accepted: str) -> DataFrame:
    """(key, familiarity, diversity, tolerance, confidence): what was set on a slider and what novelty was accepted; either
    may be null, and stands for the other then (a half, if nothing was set)."""
    g = df.groupBy(key).agg(F.avg(clamp(slider)).alias("s"), F.avg(clamp(accepted)).alias("a"), (F.count(slider) + F.count(accepted)).alias("n"))
    s = F.coalesce("s", F.lit(0.5))
    a = F.coalesce("a", s)
    target = s * 0.55 + a * 0.45
    return g.select(key, half_up(1 - target).alias("familiarity"), half_up(target).alias("diversity"), half_up(a).alias("tolerance"), half_up(clamp(F.col("n") / 12.0)).alias("confidence"))


def energy_zones(df: DataFrame, key: str, energy: str, engagement: str, confidence: str, tie: str) -> DataFrame:
    """(key, low, high, peak, confidence): around the energy with the best engagement; a usual zone where no sample is sure."""
    sure = F.col(confidence) >= 0.3
    best = F.min(F.when(sure, F.struct((-half_up(F.col(engagement) * F.col(confidence), 9)).alias("o"), F.col(tie).alias("t"), clamp(energy).alias("e"))))
    g = df.groupBy(key).agg(best.alias("b"), F.count_if(sure).alias("n"), F.avg(F.when(sure, F.col(confidence))).alias("c"))
    peak, known = F.col("b.e"), F.col("n") > 0
    return g.select(
        key, F.when(known, half_up(clamp(peak - 0.12))).otherwise(0.55).alias("low"), F.when(known, half_up(clamp(peak + 0.12))).otherwise(0.78).alias("high"),
        F.when(known, half_up(peak)).otherwise(0.68).alias("peak"), F.when(known, half_up(clamp(F.col("n") / 12.0 * F.col("c")))).otherwise(0.15).alias("confidence"),
    )


def bridge_genres(df: DataFrame, key: str, member: str, genre: str, value: str) -> DataFrame:
    """(key, genre): genres that every member of a group likes somewhat (0.35) and one a lot (0.65); a genre a member does
    not name is zero, without making those rows."""
    members = df.groupBy(key).agg(F.countDistinct(member).alias("members"))
    g = df.groupBy(key, genre).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.countDistinct(member).alias("n"))
    return g.join(members, key).where((F.col("n") == F.col("members")) & (F.col("lo") >= 0.35) & (F.col("hi") >= 0.65)).select(key, genre)


def readiness(df: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, status, progress, remaining_ms, confidence) of preparations (status, progress, remaining_ms, confidence): ready
    if all are, else the first that failed, else the slowest."""
    ready = F.col("status").isin("ready", "not-required")
    failed = F.when(F.col("status") == "failed", F.struct("progress", "remaining_ms", "confidence"))
    g = df.groupBy(key).agg(
        F.bool_and(ready).alias("all"), F.min_by(failed, F.when(F.col("status") == "failed", F.col(seq))).alias("f"), F.bool_or(F.col("status") == "running").alias("runs"),
        F.min(clamp("progress")).alias("p"), F.max("remaining_ms").alias("r"), F.min(clamp("confidence")).alias("c"),
    )
    fails = F.col("f").isNotNull()
    pick = lambda done, bad, other: F.when(F.col("all"), done).when(fails, bad).otherwise(other)
    return g.select(
        key, pick(F.lit("ready"), F.lit("failed"), F.when(F.col("runs"), "running").otherwise("not-started")).alias("status"), half_up(pick(F.lit(1.0), F.col("f.progress"), F.col("p"))).alias("progress"),
        pick(F.lit(0), F.col("f.remaining_ms"), F.col("r")).cast("long").alias("remaining_ms"), half_up(pick(F.lit(1.0), F.col("f.confidence"), F.col("c"))).alias("confidence"),
    )


def top_personal(df: DataFrame, keys: Sequence[str], item: str, completed: str, most: int) -> DataFrame:
    """(keys, item, plays, place): the most played of each key, a broken-off play as half a one."""
    plays = df.groupBy(*keys, item).agg((F.sum(F.when(F.col(completed), 2).otherwise(1)) / 2).alias("plays"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("plays"), item))
    return plays.withColumn("place", place).where(F.col("place") <= most)


def growth(df: DataFrame, keys: Sequence[str], item: str, at: str, now_ms: int, recent_days: int = 30, before_days: int = 180) -> DataFrame:
    """(keys, item, recent, before, growth): the share of an item in the last days, and in those before."""
    age = now_ms - F.col(at)
    new, old = age <= recent_days * DAY_MS, (age > recent_days * DAY_MS) & (age <= before_days * DAY_MS)
    per = df.groupBy(*keys, item).agg(F.count_if(new).alias("n"), F.count_if(old).alias("o"))
    total = per.groupBy(*keys).agg(F.greatest(F.sum("n"), F.lit(1)).alias("nn"), F.greatest(F.sum("o"), F.lit(1)).alias("oo"))
    met, a, b = per.join(total, list(keys)), F.col("n") / F.col("nn"), F.col("o") / F.col("oo")
    return met.select(*keys, item, half_up(a).alias("recent"), half_up(b).alias("before"), half_up(a - b).alias("growth"))


def new_discoveries(df: DataFrame, keys: Sequence[str], item: str, at: str, discovery: str, now_ms: int, recent_days: int = 30) -> DataFrame:
    """(keys, item, place): discoveries of the last days, the latest first, each once."""
    rows = df.where(F.col(discovery) & (now_ms - F.col(at) <= recent_days * DAY_MS)).groupBy(*keys, item).agg(F.max(at).alias("last"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("last"), item))
    return rows.select(*keys, item, place.alias("place"))


def presence(df: DataFrame, key: str, order: Sequence[str], event: str, at: str, ramp_ms: int = 300_000) -> DataFrame:
    """(key, weight, present, joined_ms, active_ms) after joined, active, inactive and left: a newcomer counts little and
    ramps up while active; one who goes quiet fades."""

    def step(a: tuple | None, what: str, now: int) -> tuple:
        if a is None or what == "joined":
            return 0.15 if what == "joined" else 1.0, what != "left", now, now
        weight, here, joined, active = a
        if what == "left":
            return 0.0, False, joined, now
        if what == "inactive":
            return rounded(max(0.1, weight * 0.65)), here, joined, active
        return rounded(max(weight, 0.15 + min(1.0, max(0.0, (now - joined) / ramp_ms)) * 0.85)), True, joined, now

    return ordered_fold(df, key, order, [event, at], None, step, lambda a: a, "weight double, present boolean, joined_ms long, active_ms long")


def evidence_confidence(requests: DataFrame, registry: DataFrame, key: str, item: str) -> DataFrame:
    """(key, confidence, kinds, weakest) of the requested items that the registry (item, confidence, kind, level) knows."""
    place = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    met = requests.select(key, item).distinct().join(registry, item)
    g = met.groupBy(key).agg(F.avg(clamp("confidence") * looked_up(F.col("level"), LEVELS, 0.25)).alias("c"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.min(place).alias("w"))
    return g.select(key, half_up("c").alias("confidence"), F.array_join("kinds", ",").alias("kinds"), F.element_at(F.array(*map(F.lit, LEVELS)), F.col("w").cast("int")).alias("weakest"))


def karaoke_queue(df: DataFrame, key: str, seq: str, track: str, singer: str, prepared: str, recent: DataFrame) -> DataFrame:
    """(key, seq, place): requests with the first for each track alone; singers who have not sung lately first, then what
    is prepared. recent: (singer)."""
    first = df.groupBy(key, track).agg(F.min_by(F.struct(seq, singer, prepared), seq).alias("r")).select(key, "r.*")
    met = first.join(recent.select(singer).distinct().withColumn("sang", F.lit(1)), singer, "left")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce("sang", F.lit(0)), F.desc(prepared), seq))
    return met.select(key, seq, place.alias("place"))


def coherence(df: DataFrame, seed: DataFrame, key: str, genre: str, duration: str, tempo: Column) -> DataFrame:
    """df with its score against the seed of its key: same known genre, a compatible tempo (tempo: struct with compatible and
    plausibility), a like duration. seed: (key, seed_genre, seed_duration, seed_bpm)."""
    met = df.join(seed, key)
    longer, shorter = F.greatest(duration, "seed_duration"), F.least(duration, "seed_duration")
    alike = F.when((F.col("seed_duration") > 0) & (F.col(duration) > 0), F.when(longer / shorter <= 1.5, 1.0).when(longer / shorter >= 3, -0.5).otherwise(0.0)).otherwise(0.0)
    same = F.when((F.col("seed_genre") != "unknown") & (F.col(genre) == F.col("seed_genre")), 0.65).otherwise(0.0)
    t = met.withColumn("t", tempo)
    return t.withColumn("score", half_up(same + F.when(F.col("t.compatible"), F.col("t.plausibility")).otherwise(0.0) + alike)).drop("t", "seed_genre", "seed_duration", "seed_bpm")


def compatibility_routes(items: DataFrame, item: str, start: object, score: Column, depth: int = 3, branches: int = 6, decay: float = 0.72) -> DataFrame:
    """(first, route, score): for every first hop from the start its best continuation of at most so many hops, by the mean of
    the scores with weights that decay. score uses the columns of the items and those of the tip as tip_ ones.

    The first hop may be any item; from there on each route grows to its best few next items only, so a hop joins the
    routes with the items and keeps branches rows of a route. Items are a candidate list and are checked to be few."""
    own = [c for c in items.columns if c != item]
    tips = [F.col(c).alias(f"tip_{c}") for c in own]
    start_row = F.broadcast(items.where(F.col(item) == start).select(F.array(item).alias("route"), F.lit(0.0).alias("s"), F.lit(0.0).alias("w"), *tips))
    grown, out = start_row, None
    few = F.broadcast(items) if items.count() <= 100_000 else items
    for hop in range(depth):
        met = grown.join(few, ~F.array_contains("route", F.col(item))).withColumn("edge", half_up(score))
        if hop:
            nth = F.row_number().over(Window.partitionBy("route").orderBy(F.desc("edge"), F.col(item)))
            met = met.withColumn("nth", nth).where(F.col("nth") <= branches)
        weight = decay**hop
        grown = met.select(F.array_append("route", F.col(item)).alias("route"), (F.col("s") + F.col("edge") * weight).alias("s"), (F.col("w") + weight).alias("w"), *tips)
        some = grown.select(F.get("route", F.lit(1)).alias("first"), "route", half_up(F.col("s") / F.col("w")).alias("score"))
        out = some if out is None else out.union(some)
    best = F.min(F.struct((-F.col("score")).alias("o"), F.array_join("route", "/").alias("r"))).alias("b")
    return out.groupBy("first").agg(best).select("first", F.col("b.r").alias("route"), (-F.col("b.o")).alias("score"))


def neighbour_routes(items: DataFrame, item: str, start: object, value: str, group: str, score: Callable[[Column, Column], Column], depth: int = 3, branches: int = 6, decay: float = 0.72) -> DataFrame:
    """compatibility_routes() of any number of items, for scores of their values and groups: score(distance, same), see
    best_partners().

    The first hop may be any item; from there on each route grows to its best few next items only. Of an item's best
    partners a route may have been at depth at most, so a table of branches + depth partners is joined by the tip."""
    partners = stored(best_partners(items, item, value, group, score, branches + depth), "partners").withColumnsRenamed({item: "tip"})
    begin = items.where(F.col(item) == start).select(F.col(value).alias("v"), F.col(group).alias("g"))  # one row
    edge = half_up(score(F.abs(F.col(value) - F.col("v")), F.col(group).eqNullSafe(F.col("g"))))
    grown = items.where(F.col(item) != start).join(F.broadcast(begin)).select(F.array(F.lit(start).cast(items.schema[item].dataType), F.col(item)).alias("route"), edge.alias("s"), F.lit(1.0).alias("w"))
    out = grown
    for hop in range(1, depth):
        met = grown.withColumn("tip", F.element_at("route", -1)).join(partners, "tip").where(~F.array_contains("route", F.col("other")))
        nth = F.row_number().over(Window.partitionBy("route").orderBy(F.desc("edge"), "other"))
        met = met.withColumn("nth", nth).where(F.col("nth") <= branches)
        weight = decay**hop
        grown = met.select(F.array_append("route", F.col("other")).alias("route"), (F.col("s") + F.col("edge") * weight).alias("s"), (F.col("w") + weight).alias("w"))
        out = out.union(grown)
    told = out.select(F.element_at("route", 2).alias("first"), "route", half_up(F.col("s") / F.col("w")).alias("score"))
    best = F.min(F.struct((-F.col("score")).alias("o"), F.array_join("route", "/").alias("r"))).alias("b")
    return told.groupBy("first").agg(best).select("first", F.col("b.r").alias("route"), (-F.col("b.o")).alias("score"))
