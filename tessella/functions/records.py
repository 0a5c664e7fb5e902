"""Records that come as JSON text: what is wrong with them first, or what they say, and plans cut down to what a player can."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .evidence import first_fault
from .moves import MOVES
from .scalars import clamp, once

# Moods and parts of a mix with what they are if nothing is said; what overrides may name; moves that are effects.
MOODS = ("chill", "love", "energy", "party")
MIX = {"transitionIntensity": (0.5, 1.0), "originalPreservation": (0.65, 1.0), "bassTransitionBias": (0.5, 1.0), "vocalOverlap": (0.12, 1.0), "tempoTolerance": (0.08, 0.25), "energyVariance": (0.5, 1.0)}
ALIGNMENTS, DIRECTIONS, STEMS, SCOPES = ("exact", "beat", "bar", "phrase"), ("up", "down", "hold"), ("auto", "forbid", "prefer"), ("next", "session")
REGIONS_MOST, DAY_S, NAME_MOST, ENTRIES_MOST, CURVE_MOST = 32, 86_400.0, 200, 64, 64
EFFECTS = ("filter", "echo", "bassdrop", "spinback", "gate", "roll", "riser")
#: Versions of fingerprints: where each keeps its moods, its curve and its mix. A later one may move or rename them.
VERSIONS = {1: ("experienceDNA", "energyCurve", "mixPersonality"), 2: ("experience", "curve", "mix"), 3: ("moods", "curve", "personality")}
KNOWN = ("version", "createdAtMs", "genreDistribution", "transitionDistribution", "familiarityTarget", "confidence", "sampleSize")


def number(top: Column, name: str, otherwise: float, most: float = 1.0) -> Column:
    """A number of a map of JSON texts, within 0 and most; otherwise where it is none."""
    return F.coalesce(clamp(top[name].try_cast("double"), 0.0, most), F.lit(otherwise))


def shares(body: Column, allowed: Sequence[str] | None = None) -> Column:
    """map of the shares of a JSON object's positive numbers; names that are not allowed and what is no number are left out."""
    given = F.coalesce(F.from_json(body, "map<string,string>"), F.create_map().cast("map<string,string>"))
    positive = F.filter(F.map_entries(F.transform_values(given, lambda k, v: v.try_cast("double"))), lambda e: (e["value"] > 0) & (e["value"] < float("inf")) & (F.lit(True) if allowed is None else e["key"].isin(*allowed)))
    return once(F.slice(positive, 1, ENTRIES_MOST), lambda es: F.map_from_entries(once(F.aggregate(es, F.lit(0.0), lambda a, e: a + e["value"]), lambda total: F.transform(es, lambda e: F.struct(e["key"], (e["value"] / total).alias("value"))))))


def fingerprint(body: Column) -> Column:
    """struct(fault, version, moods, intensity, target, curve, genres, mix, confidence, samples, others) of a session's
    fingerprint of any known version. fault names the first thing that keeps it from being used: json, version, moods or
    curve; others has the fields, as JSON, that no version knows."""

    def read(top: Column) -> Column:
        version = top["version"].try_cast("int")
        at = lambda k: F.coalesce(*(F.when(version == v, top[names[k]]) for v, names in VERSIONS.items()))
        inner = lambda k: F.coalesce(F.from_json(at(k), "map<string,string>"), F.create_map().cast("map<string,string>"))
        curve = F.transform(F.filter(F.coalesce(F.from_json(at(1), "array<double>"), F.array().cast("array<double>")), lambda x: x.isNotNull() & ~F.isnan(x)), lambda x: clamp(x))
        names = [*KNOWN, *(n for parts in VERSIONS.values() for n in parts)]
        return F.struct(top.alias("top"), version.alias("version"), inner(0).alias("dna"), curve.alias("curve"), inner(2).alias("mix"), F.map_filter(top, lambda k, v: ~k.isin(*names)).alias("others"))

    def told(r: Column) -> Column:
        top, moods = r["top"], shares(r["dna"]["weights"], MOODS)
        n = F.size(r["curve"])
        kept = F.slice(r["curve"], F.greatest(n - CURVE_MOST, F.lit(0)) + 1, CURVE_MOST)
        fault = first_fault([("json", top.isNotNull()), ("version", r["version"].isin(*VERSIONS)), ("moods", F.size(moods) > 0), ("curve", n > 0)])
        mix = F.struct(*(number(r["mix"], name, usual, most).alias(name) for name, (usual, most) in MIX.items()))
        return F.struct(
            fault.alias("fault"), r["version"].alias("version"), F.struct(*(F.coalesce(moods[m], F.lit(0.0)).alias(m) for m in MOODS)).alias("moods"), number(r["dna"], "intensity", 1.0).alias("intensity"),
            number(r["dna"], "targetEnergy", 0.55).alias("target"), kept.alias("curve"), shares(top["genreDistribution"]).alias("genres"), mix.alias("mix"), number(top, "confidence", 0.0).alias("confidence"),
            F.coalesce(F.floor(clamp(top["sampleSize"].try_cast("double"), 0.0, 1e6)), n).cast("long").alias("samples"), r["others"].alias("others"),
        )

    return once(once(F.from_json(body, "map<string,string>"), read), told)


OVERRIDE = (
    "fromTrackId string, toTrackId string, transitionType string, fadeSec double, mixOutPointSec double, mixInPointSec double, scope string, alignment string, energyDirection string, stemUsage string, preserveSection string, "
    "neverMixRegions array<struct<track: string, start: double, end: double>>, expiresAtMs long"
)


def override_fault(body: Column, now: int, sections: Sequence[str]) -> Column:
    """First fault of a listener's override of a move, null for a valid one."""

    def check(o: Column) -> Column:
        named = lambda c: c.isNull() | ((F.trim(c) != "") & (F.length(c) <= NAME_MOST))
        within = lambda c, low, high: c.isNull() | c.between(low, high)
        one = lambda c, of: c.isNull() | c.isin(*of)
        region = lambda g: g["track"].isin("current", "next") & g["start"].between(0, DAY_S) & g["end"].between(0, DAY_S) & (g["end"] > g["start"])
        regions = F.coalesce(o["neverMixRegions"], F.array().cast("array<struct<track: string, start: double, end: double>>"))
        intent = F.coalesce(o["transitionType"], o["alignment"], o["energyDirection"], o["stemUsage"], o["preserveSection"]).isNotNull() | F.coalesce(o["fadeSec"], o["mixOutPointSec"], o["mixInPointSec"]).isNotNull() | (F.size(regions) > 0)
        return first_fault([
            ("object", F.startswith(F.ltrim(body), F.lit("{")) & F.try_parse_json(body).isNotNull()), ("from", named(o["fromTrackId"])), ("to", named(o["toTrackId"])), ("type", one(o["transitionType"], MOVES)), ("fade", within(o["fadeSec"], 1, 60)),
            ("out", within(o["mixOutPointSec"], 0, DAY_S)), ("in", within(o["mixInPointSec"], 0, DAY_S)), ("scope", one(o["scope"], SCOPES)), ("alignment", one(o["alignment"], ALIGNMENTS)),
            ("energy", one(o["energyDirection"], DIRECTIONS)), ("stems", one(o["stemUsage"], STEMS)), ("section", one(o["preserveSection"], sections)),
            ("conflict", F.coalesce(~((o["transitionType"] == "acapella") & (o["stemUsage"] == "forbid")), F.lit(True))), ("regions", (F.size(regions) <= REGIONS_MOST) & F.forall(regions, lambda g: F.coalesce(region(g), F.lit(False)))),
            ("intent", intent), ("expired", F.coalesce(o["expiresAtMs"] > now, F.lit(True))),
        ])

    return once(F.from_json(body, OVERRIDE), check)


def gated_plan(move: Column, fade: Column, ratio: Column, sweep: Column, can: dict[str, Column]) -> Column:
    """struct(move, fade, ratio, sweep, mode, lost): a plan with only what a player cannot do taken out. can: raw, decks,
    crossfade, effects, stems, rate, eq."""
    mixes = can["crossfade"] & can["decks"]
    mode = F.when(can["raw"] & can["decks"], "full-engine").when(can["crossfade"], "smart-crossfade").otherwise("native-ordering")
    effect, song = move.isin(*EFFECTS) & ~can["effects"], (move == "acapella") & ~can["stems"]
    stretched, flat = (ratio != 1) & ~can["rate"], sweep & ~can["eq"]
    lost = F.when(~mixes, F.array(F.lit("dual-deck-transition"))).otherwise(
        F.array_compact(F.array(F.when(effect, F.concat(F.lit("effect:"), move)), F.when(song, "stem-mix"), F.when(stretched, "tempo-sync"), F.when(flat, "eq-sweep")))
    )
    return F.struct(
        F.when(~mixes, "cut").when(effect | song, "blend").otherwise(move).alias("move"), F.when(~mixes, 0.05).otherwise(fade).alias("fade"), F.when(~mixes | stretched, 1.0).otherwise(ratio).alias("ratio"),
        (mixes & sweep & ~flat).alias("sweep"), mode.alias("mode"), lost.alias("lost"),
    )


# The order in which the parts of a mix are handed over, and what each step has to reach.
ROLES, CRITIC, SURE = ("drums", "bass", "harmony", "foreground"), 0.65, 0.55


def handover(scores: Column, confidences: Column) -> Column:
    """struct(stages, committed): roles are handed over one after the other as long as the mix so far scores enough; a stage
    is accepted if its own confidence does too, and all four have to be."""
    reached = F.aggregate(
        F.slice(scores, 1, len(ROLES)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda a, s: F.struct((a["n"] + a["on"].cast("int")).alias("n"), (a["on"] & (s >= CRITIC)).alias("on")), lambda a: a["n"],
    )
    names = F.array(*map(F.lit, ROLES))
    stage = lambda s, k: F.struct(F.get(names, k).alias("role"), s.alias("score"), ((s >= CRITIC) & (F.get(confidences, k) >= SURE)).alias("accepted"))
    stages = once(reached, lambda n: F.transform(F.slice(scores, 1, n), stage))
    return once(stages, lambda x: F.struct(x.alias("stages"), ((F.size(x) == len(ROLES)) & F.forall(x, lambda s: s["accepted"])).alias("committed")))
