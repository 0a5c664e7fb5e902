"""Where a session's energy is to go next, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import clamp, half_up, once

# What the phases intend; the largest step, and what listeners' displeasure takes of it; when flatness asks for a
# contrast and how large that is; the bend of the way and the lift of a peak; the parts of the confidence.
INTENTS = {"warmup": "introduce", "build": "build", "momentum": "hold", "peak": "peak", "reset": "breathe", "rebuild": "rebuild", "finale": "peak", "cooldown": "resolve"}
STEP, FRICTION = 0.13, 0.065
FLAT, SMALL, CONTRAST, MORE = 0.58, 0.055, 0.045, 0.035
BEND, LIFT = 1.4, 0.025
SURE = {"base": 0.35, "evidence": 0.38, "feedback": 0.12, "stability": 0.15, "friction": -0.12}
TURN, STABLE = 0.025, 0.28
LENGTH_LEAST, LENGTH_MOST = 2, 8


def journey(current: Column, target: Column, phase: Column, skips: Column, likes: Column, flatness: Column, recent: Column, length: Column) -> Column:
    """struct(intent, direction, next, path, roles, stability, confidence): a short way from the current to the target energy.
    Skips over likes shorten the next step; a session that has been flat gets a contrast instead of a small step. recent: the
    last energies, eight of them at most; length: steps of the way, two to eight."""
    intents = F.create_map(*(F.lit(x) for pair in INTENTS.items() for x in pair))
    given = F.struct(
        clamp(current).alias("now"), clamp(target).alias("to"), intents[phase].alias("intent"), phase.isin("reset", "cooldown").alias("falling"), clamp((skips - likes) / 5).alias("friction"),
        clamp(flatness).alias("flat"), F.transform(recent, lambda e: clamp(e.cast("double"))).alias("recent"), clamp((likes + skips) / 8).alias("feedback"),
        F.greatest(F.lit(LENGTH_LEAST), F.least(F.lit(LENGTH_MOST), F.floor(length + 0.5))).cast("int").alias("length"),
    )

    def stepped(i: Column) -> Column:
        most = STEP - i["friction"] * FRICTION
        wanted = F.greatest(-most, F.least(most, i["to"] - i["now"]))
        return F.struct(i.alias("i"), wanted.alias("wanted"), ((i["flat"] >= FLAT) & (F.abs(wanted) < SMALL)).alias("contrast"))

    def aimed(s: Column) -> Column:
        i = s["i"]
        turn = F.when(i["falling"], -1.0).otherwise(1.0) * (CONTRAST + i["flat"] * MORE)
        moves = F.transform(F.slice(i["recent"], 2, LENGTH_MOST), lambda e, k: F.abs(e - F.get(i["recent"], k)))
        mean = F.when(F.size(moves) > 0, F.aggregate(moves, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(moves), F.lit(1))).otherwise(0.0)
        return F.struct(i.alias("i"), s["contrast"].alias("contrast"), clamp(i["now"] + F.when(s["contrast"], turn).otherwise(s["wanted"])).alias("next"), clamp(1 - mean / STABLE).alias("stability"))

    def told(a: Column) -> Column:
        i, gap = a["i"], a["next"] - a["i"]["now"]
        places = F.sequence(F.lit(1), i["length"])

        def energy(k: Column) -> Column:
            progress = k / i["length"]
            lift = F.when(i["intent"] == "peak", F.sin(progress * F.lit(3.141592653589793)) * LIFT).otherwise(0.0)
            way = clamp(i["now"] + (i["to"] - i["now"]) * (1 - F.pow(1 - progress, F.lit(BEND))) + lift)
            return half_up(F.when(k == 1, a["next"]).otherwise(way))

        def role(k: Column) -> Column:
            return (
                F.when(a["contrast"] & (k == 1), "contrast")
                .when((k == i["length"]) & i["intent"].isin("breathe", "resolve"), "landing")
                .when(i["intent"].isin("build", "rebuild", "peak"), "lift")
                .when(i["intent"] == "hold", "hold")
                .otherwise("bridge")
            )

        sure = SURE["base"] + clamp(F.size(i["recent"]) / 6) * SURE["evidence"] + i["feedback"] * SURE["feedback"] + a["stability"] * SURE["stability"] + i["friction"] * SURE["friction"]
        return F.struct(
            i["intent"].alias("intent"), F.when(gap > TURN, "up").when(gap < -TURN, "down").otherwise("hold").alias("direction"), half_up(a["next"]).alias("next"),
            F.transform(places, energy).alias("path"), F.transform(places, role).alias("roles"), half_up(a["stability"]).alias("stability"), half_up(clamp(sure)).alias("confidence"),
        )

    return once(once(once(given, stepped), aimed), told)
