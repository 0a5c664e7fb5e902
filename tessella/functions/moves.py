"""What each kind of move from one track to the next is worth, as column functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import clamp, half_up, ladder, once

# How genres like moves, in the order of MOVES; sets of moves; points of the parts and their weights; the edges
# of the buckets that feedback is kept by.
MOVES = ("fade", "blend", "cut", "filter", "echo", "bassdrop", "spinback", "gate", "roll", "riser", "acapella")
AFFINITY = {
    "unknown": (72, 72, 72, 72, 72, 72, 72, 72, 72, 72, 72),
    "chill": (96, 68, 48, 62, 94, 42, 34, 45, 38, 48, 64),
    "hiphop": (60, 68, 94, 76, 70, 72, 92, 78, 94, 68, 82),
    "edm": (58, 92, 70, 86, 68, 94, 74, 86, 80, 94, 78),
    "pop": (74, 84, 70, 82, 78, 72, 60, 68, 62, 72, 76),
}
NEUTRAL, GENRE_WEIGHT = 72.0, 0.1
HARD, MASKED, CLOSE = ("cut", "spinback", "roll"), ("filter", "gate", "echo", "riser"), ("blend", "bassdrop", "filter", "gate", "riser", "acapella")
PUNCHY, LIFTED, EXPOSED, SOFT = ("bassdrop", "riser", "gate", "spinback", "roll"), ("bassdrop", "riser", "spinback"), ("blend", "acapella"), ("fade", "echo")
WEIGHTS = {"tempo": 0.2, "key": 0.16, "energy": 0.14, "beat": 0.1, "downbeat": 0.08, "phrase": 0.08, "vocals": 0.08, "structure": 0.06}
FAR, MIDDLE, KEY_OK, KEY_SURE, ENTRY = 0.18, 0.12, 0.5, 0.7, 2.0
TEMPO_BUCKETS = ((2, "tempo:0-2"), (6, "tempo:2-6"), (8, "tempo:6-8"), (12, "tempo:8-12"), (18, "tempo:12-18"))
STRETCH_BUCKETS = ((2, "stretch:0-2"), (5, "stretch:2-5"), (8, "stretch:5-8"), (12, "stretch:8-12"))


@dataclass(frozen=True)
class Pair:
    """What is known of two tracks. gap: relative distance of their tempi (null: unknown); close: whether they go together;
    stem: quality of the outgoing stem (null: unknown); risk, vocal_score, vocal_safe: of voices that clash."""

    analysed: Column
    gap: Column
    close: Column
    plausibility: Column
    ratio: Column
    key_score: Column
    high_energy: Column
    outro: Column
    intro: Column
    stem_ready: Column
    stem: Column
    risk: Column
    vocal_score: Column
    vocal_safe: Column
    genres: tuple[Column, Column]
    confidences: tuple[Column, Column]
    base: Column

    def struct(self) -> Column:
        """All of it in one struct, which the scores of all moves read."""
        own = {n: getattr(self, n) for n in self.__dataclass_fields__ if n not in ("genres", "confidences")}
        a, b = self.confidences
        sure = clamp(F.least(a, b) * 0.65 + (a + b) / 2 * 0.35)
        table = F.create_map(*(x for g, row in AFFINITY.items() for x in (F.lit(g), F.array(*(F.lit(float(v)) for v in row)))))
        return F.struct(*(c.alias(n) for n, c in own.items()), sure.alias("sure"), *(F.coalesce(table[g], table[F.lit("unknown")]).alias(f"genre_{k}") for k, g in enumerate(self.genres)))


def kinds() -> Column:
    """The moves as an array of struct(move, at, and whether it is in each set)."""
    sets = {"hard": HARD, "masked": MASKED, "tight": CLOSE, "punchy": PUNCHY, "lifted": LIFTED, "exposed": EXPOSED, "soft": SOFT}
    return F.array(*(F.struct(F.lit(m).alias("move"), F.lit(k).alias("at"), *(F.lit(m in s).alias(n) for n, s in sets.items())) for k, m in enumerate(MOVES)))


def feasible(p: Column, m: Column) -> Column:
    """Whether a move can be made at all; the base plan's always can, but for an acapella without what it needs."""
    is_, near = lambda *names: m["move"].isin(*names), F.coalesce(p["gap"] <= FAR, F.lit(False))
    matched = near & p["close"] & (p["key_score"] >= KEY_OK)
    can = (
        F.when(is_("fade"), True)
        .when(~p["analysed"], is_("blend"))
        .when(is_("echo"), True)
        .when(is_("cut"), ~near | p["high_energy"])
        .when(is_("spinback"), p["high_energy"] & (~near | matched))
        .when(is_("blend", "filter"), near)
        .when(is_("gate"), near & p["high_energy"])
        .when(is_("acapella"), matched)
        .otherwise(matched & p["high_energy"])
    )
    sung = p["stem_ready"] & (p["key_score"] >= KEY_SURE) & p["vocal_safe"]
    return (can | (p["base"] == m["move"])) & (~is_("acapella") | sung)


def parts(p: Column, m: Column) -> dict[str, Column]:
    """The measured parts of a move's score."""
    near, key = F.coalesce(p["gap"] <= FAR, F.lit(False)), p["key_score"]
    beat, room = clamp(p["plausibility"] * 100, 30.0, 100.0), p["intro"] >= ENTRY
    lively = F.when(m["punchy"], 94.0).when(m["move"] == "fade", 50.0).otherwise(78.0)
    calm = F.when(m["soft"], 86.0).when(m["lifted"], 58.0).otherwise(74.0)
    return {
        "tempo": F.when(m["hard"], F.when(near, 55.0).otherwise(94.0)).when(m["soft"], 78.0).when(p["close"], 94.0).when(F.coalesce(p["gap"] <= MIDDLE, F.lit(False)), 72.0).otherwise(40.0),
        "key": F.when(m["hard"], F.greatest(F.lit(70.0), key * 100)).when(m["masked"], F.when(key >= KEY_OK, 88.0).otherwise(84.0)).otherwise(key * 100),
        "energy": F.when(p["high_energy"], lively).otherwise(calm), "beat": beat, "downbeat": clamp(48 + beat * 0.28 + F.when(p["high_energy"], 18.0).otherwise(8.0), 0.0, 100.0),
        "phrase": F.when(m["exposed"] & ~room, 54.0).when(p["outro"], 88.0).when(p["close"], 74.0).otherwise(58.0), "vocals": F.when(m["move"] == "acapella", p["vocal_score"]).otherwise(100 - p["risk"] * 45),
        "structure": F.when(m["exposed"] & ~room, 28.0).when(p["outro"], 90.0).when(m["exposed"], 68.0).otherwise(62.0),
    }


def genre_part(p: Column, m: Column) -> Column:
    liked = F.get(p["genre_0"], m["at"]) + F.get(p["genre_1"], m["at"])
    return half_up(NEUTRAL + (liked / 2 - NEUTRAL) * p["sure"], 1)


def musical(p: Column, m: Column) -> Column:
    """The score of a move by what is heard and, to a tenth, by what the genres like."""
    total = sum((x * WEIGHTS[n] for n, x in parts(p, m).items()), genre_part(p, m) * GENRE_WEIGHT)
    return half_up(total + F.when(m["move"] == "acapella", (F.coalesce(p["stem"], F.lit(78.0)) - 72) * 0.15).otherwise(0.0), 1)


def buckets(move: Column | str, gap_pct: Column, key_score: Column, stretch_pct: Column) -> list[Column]:
    """The keys that feedback on a move is kept by: the move, and the move with its tempo, key and stretch."""
    move = F.lit(move) if isinstance(move, str) else move
    tone = F.when(key_score.isNull(), "key:unknown").when(key_score >= 0.7, "key:compatible").when(key_score >= 0.4, "key:borderline").otherwise("key:clash")
    named = lambda kind, x: F.concat(F.lit(f"type-{kind}:"), move, F.lit(":"), x)
    return [F.concat(F.lit("type:"), move), named("tempo", ladder(gap_pct, TEMPO_BUCKETS, "tempo:18+", "tempo:unknown")), named("key", tone), named("stretch", ladder(stretch_pct, STRETCH_BUCKETS, "stretch:12+"))]


def candidates(pair: Pair) -> Column:
    """array of struct(move, musical, keys) of the moves that can be made, all read of one struct."""

    def scored(p: Column) -> Column:
        def entry(m: Column) -> Column:
            stretch = F.when(m["tight"], F.abs(p["ratio"] - 1) * 100).otherwise(0.0)
            return F.struct(m["move"].alias("move"), musical(p, m).alias("musical"), F.array(*buckets(m["move"], p["gap"] * 100, p["key_score"], stretch)).alias("keys"))

        return F.transform(F.filter(kinds(), lambda m: feasible(p, m)), entry)

    return once(pair.struct(), scored)
