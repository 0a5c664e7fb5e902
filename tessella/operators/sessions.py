"""Plans and their checks for sessions: queues, overlaps, intents, regions in time, readiness of signals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import clamp, half_up
from .folds import ordered_fold, rounded
from .studies import leading

# How much of a song an occasion keeps, and which version of a song it prefers.
PRESERVATION = {"chill": 0.25, "love": 0.3, "energy": 0.12, "party": 0.05}
PREFERRED = {
    "party": ["extended-version", "remix", "radio-edit"], "energy": ["remix", "extended-version", "radio-edit"],
    "chill": ["acoustic-version", "original-version", "live-version"], "love": ["original-version", "acoustic-version", "live-version"],
}


def harmonic_overlap(df: DataFrame, key: str, side: str, centre: str, activity: str, item: str) -> DataFrame:
    """(key, a, b, risk): the pair of a segment of side a and one of side b with the least risk: another tonal centre costs
    0.6, their activity a fifth each.

    Of the segments of a side and centre only the calmest can win, so the few centres meet and not the segments."""
    calm = df.groupBy(key, side, centre).agg(F.min(F.struct(half_up(activity, 9).alias("x"), F.col(item).alias("i"))).alias("s"))
    a = calm.where(F.col(side) == "a").select(key, F.col(centre).alias("ca"), F.col("s").alias("sa"))
    b = calm.where(F.col(side) == "b").select(key, F.col(centre).alias("cb"), F.col("s").alias("sb"))
    risk = half_up(F.when(F.col("ca") == F.col("cb"), 0.0).otherwise(0.6) + (F.col("sa.x") + F.col("sb.x")) * 0.2)
    best = F.min(F.struct(risk.alias("r"), F.col("sa.i").alias("a"), F.col("sb.i").alias("b"))).alias("m")
    return a.join(b, key).groupBy(key).agg(best).select(key, "m.a", "m.b", F.col("m.r").alias("risk"))


def crowd_intents(df: DataFrame, key: str) -> DataFrame:
    """(key, energy, familiarity, genres, conflicts) of wishes (energy, familiarity, host, genre, excluded): hosts count half
    as much again; what anyone excludes is not wished for."""
    w = F.when(F.col("host"), 1.5).otherwise(1.0)
    g = df.groupBy(key).agg(
        (F.sum(clamp("energy") * w) / F.sum(w)).alias("e"), (F.sum(clamp("familiarity") * w) / F.sum(w)).alias("f"), F.collect_set(F.lower("genre")).alias("wished"), F.collect_set(F.lower("excluded")).alias("out")
    )
    joined = lambda x: F.array_join(F.array_sort(x), ",")
    return g.select(key, half_up("e").alias("energy"), half_up("f").alias("familiarity"), joined(F.array_except("wished", "out")).alias("genres"), joined(F.array_intersect("wished", "out")).alias("conflicts"))


def golden_benchmark(df: DataFrame, least_pass: float = 1.0, most_forbidden: float = 0.0, least_natural: float = 65.0, most_artifact: float = 40.0) -> DataFrame:
    """One row (cases, pass_rate, forbidden_rate, naturalness, artifact_risk, panel, faults) of cases (passed, offered,
    forbidden, naturalness, artifact_risk, panel)."""
    g = df.agg(
        F.count(F.lit(1)).alias("cases"), (F.count_if("passed") / F.count(F.lit(1))).alias("p"), (F.sum("forbidden") / F.greatest(F.lit(1), F.sum("offered"))).alias("f"),
        F.avg("naturalness").alias("n"), F.avg("artifact_risk").alias("a"), F.avg("panel").alias("s"),
    )
    faults = [("pass-rate", F.col("p") < least_pass), ("forbidden", F.col("f") > most_forbidden), ("naturalness", F.col("n") < least_natural), ("artifacts", F.col("a") > most_artifact)]
    return g.select(
        "cases", half_up("p").alias("pass_rate"), half_up("f").alias("forbidden_rate"), half_up("n", 1).alias("naturalness"), half_up("a", 1).alias("artifact_risk"), half_up("s", 2).alias("panel"),
        F.concat_ws(",", *(F.when(bad, name) for name, bad in faults)).alias("faults"),
    )


def with_switch_margin(df: DataFrame, key: str, kind: str, score: str, base: str, margin: float = 4.0) -> DataFrame:
    """(key, kind, score): the best kind of each key if it beats the base kind by the margin, else the base (the best, where
    the base has no score)."""
    own = df.where(F.col(kind) == base).select(key, F.col(score).alias("base_score"))
    met = leading(df, [key], score, kind, [kind]).join(own, key, "left")
    stays = F.col("base_score").isNotNull() & (F.col("score") < F.col("base_score") + margin)
    return met.select(key, F.when(stays, F.lit(base)).otherwise(F.col(kind)).alias(kind), half_up(F.when(stays, F.col("base_score")).otherwise(F.col("score"))).alias("score"))


def moment_familiarity(df: DataFrame, key: str, order: Sequence[str], reaction: str, start: float = 0.5) -> DataFrame:
    """(key, familiarity, evidence): a fifth of each reaction, and how many there were."""
    step = lambda a, x: (min(1.0, max(0.0, a[0] * 0.8 + x * 0.2)), a[1] + 1)
    return ordered_fold(df, key, order, [reaction], (start, 0), step, lambda a: (rounded(a[0], 6), a[1]), "familiarity double, evidence long")


def grid_failures(df: DataFrame, key: str, order: str, expected: str, actual: str, bpm: str) -> DataFrame:
    """(key, drift_ms, periodic_ms, discontinuity, action): mean offset of onsets from a grid, how far the last third is from
    the first, and the jump of local tempi."""
    w = Window.partitionBy(key)
    rows = df.withColumns({"off": F.col(actual) - F.col(expected), "pos": F.row_number().over(w.orderBy(order)), "n": F.count(F.lit(1)).over(w)})
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    g = rows.groupBy(key).agg(
        F.avg("off").alias("m"), F.avg(F.when(F.col("pos") <= third, F.col("off"))).alias("a"), F.avg(F.when(F.col("pos") > F.col("n") - third, F.col("off"))).alias("z"),
        F.when(F.count(F.lit(1)) > 1, clamp(F.max(bpm) / F.greatest(F.lit(1.0), F.min(bpm)) - 1)).otherwise(0.0).alias("jump"),
    )
    drift, periodic = half_up(F.col("m") * 1000), half_up(F.abs(F.col("z") - F.col("a")) * 1000)
    issue = (F.abs(drift) >= 35) | (periodic >= 25) | (F.col("jump") > 0.08)
    action = F.when((periodic >= 80) | (F.col("jump") > 0.2), "safe-transition").when(issue, "dynamic-grid").otherwise("constant-grid")
    return g.select(key, drift.alias("drift_ms"), periodic.alias("periodic_ms"), half_up("jump").alias("discontinuity"), action.alias("action"))


def detected_experience(df: DataFrame, key: str) -> DataFrame:
    """(key, experience, confidence) of tracks (energy, dance, acoustic, valence, vocal, genre, confidence): the occasion that
    their means speak for; chill where nothing is sure."""
    sure = F.col("confidence") > 0.15
    mean = lambda c: F.avg(F.when(sure, F.col(c)))
    share = lambda g: F.count_if(sure & (F.col("genre") == g)) / F.greatest(F.lit(1), F.count_if(sure))
    g = df.groupBy(key).agg(F.count_if(sure).alias("n"), *(mean(c).alias(c) for c in ("energy", "dance", "acoustic", "valence", "vocal")), share("edm").alias("edm"), share("chill").alias("calm"))
    c = F.col
    raw = {
        "chill": clamp((1 - c("energy")) * 0.65 + c("acoustic") * 0.25 + c("calm") * 0.45),
        "love": clamp((1 - F.abs(c("valence") - 0.58)) * 0.45 + c("vocal") * 0.25 + c("acoustic") * 0.18),
        "energy": clamp(c("energy") * 0.72 + (1 - c("dance")) * 0.1),
        "party": clamp(c("energy") * 0.45 + c("dance") * 0.45 + c("edm") * 0.35),
    }
    g = g.withColumns({f"r_{n}": x for n, x in raw.items()})
    total = reduce(lambda a, b: a + b, (F.col(f"r_{n}") for n in raw))
    order = F.array_sort(F.array(*(F.struct((-half_up(F.col(f"r_{n}") / F.greatest(total, F.lit(1e-9)), 9)).alias("o"), F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in enumerate(raw))))
    known = F.col("n") > 0
    confidence = clamp(0.45 + order[1]["o"] - order[0]["o"] + F.col("n") * 0.04)
    return g.select(key, F.when(known, order[0]["n"]).otherwise("chill").alias("experience"), F.when(known, half_up(confidence)).otherwise(0.2).alias("confidence"))


def signal_coverage(df: DataFrame, key: str, signals: Sequence[str]) -> DataFrame:
    """(signal, available, total, status): how many rows have each of the boolean signals."""
    g = df.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(s).alias(s) for s in signals))
    spread = g.select("total", F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).alias("available")) for s in signals))).alias("s"))
    status = F.when(F.col("s.available") == F.col("total"), "complete").when(F.col("s.available") > 0, "partial").otherwise("missing")
    return spread.select("s.signal", "s.available", "total", status.alias("status"))


def masking_matrix(df: DataFrame, role: str, band: str, energy: str, n_bands: int) -> DataFrame:
    """(masker, masked, masking) for each ordered pair of roles: the mean over the bands of the lesser energy. df: (role, band,
    energy), a band not named is zero. Roles meet by band, so no row is made for what does not overlap."""
    per = df.groupBy(role, band).agg(F.sum(energy).alias("x"))
    a, b = per.select(F.col(role).alias("masker"), band, F.col("x").alias("xa")), per.select(F.col(role).alias("masked"), band, F.col("x").alias("xb"))
    met = a.join(b, band).where("masker <> masked").groupBy("masker", "masked").agg(F.sum(F.least("xa", "xb")).alias("s"))
    return met.select("masker", "masked", half_up(clamp(F.col("s") / n_bands)).alias("masking"))


def planning_loops(df: DataFrame, key: str, order: str, accepted: str, repair: str, most: int = 3) -> DataFrame:
    """(key, plan, iterations, committed): repairs are added until a critique accepts, in so many rounds at most."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    rows = df.withColumn("nth", nth).where(F.col("nth") <= most)
    g = rows.groupBy(key).agg(F.min(F.when(F.col(accepted), F.col("nth"))).alias("ok"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("nth", F.col(repair).alias("r")))).alias("l"))
    last = F.coalesce(F.col("ok") - 1, F.col("n"))
    plan = F.concat_ws("+", F.lit("plan"), F.transform(F.filter("l", lambda x: (x["nth"] <= last) & x["r"].isNotNull()), lambda x: x["r"]))
    return g.select(key, plan.alias("plan"), F.coalesce("ok", "n").cast("long").alias("iterations"), F.col("ok").isNotNull().alias("committed"))


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text of single code units, in eight hexadecimal digits."""
    units = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, c: (h.bitwiseXOR(c) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.lower(F.lpad(F.hex(F.aggregate(units, F.lit(0x811C9DC5).cast("long"), step)), 8, "0"))
