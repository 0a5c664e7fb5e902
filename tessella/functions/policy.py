"""Decision rules as column functions: weighted sums, thresholds, and the reasons they give."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import DAY_MS, clamp, half_life, half_up

#: Half-lives in days of what is known about a listener (fixed values).
HALF_LIVES = {"artist": 730.0, "genre": 540.0, "track": 730.0, "mood": 60.0, "session": 14.0}
#: What the outcome of a recommendation adds to its relevance (fixed values).
OUTCOMES = {"recommended": 0.0, "accepted": 0.2, "skipped": -0.18, "ignored": -0.04, "searched-later": 0.28}
#: Reach of a chart by scope (fixed values).
SCOPES = {"global": 1.0, "country": 0.95, "region": 0.85, "city": 0.72, "community": 0.68, "friend-circle": 0.58, "party": 0.48}


def _lookup(key: Column, table: dict[str, float], otherwise: float = 0.0) -> Column:
    return F.coalesce(*(F.when(key == k, v) for k, v in table.items()), F.lit(otherwise))


def aged_preference(value: Column, confidence: Column, kind: Column, last_ms: Column, now_ms: int) -> Column:
    """struct(value, confidence): halved each half-life of the kind; the confidence fades half as fast."""
    decay = F.pow(F.lit(0.5), F.greatest(F.lit(0), now_ms - last_ms) / DAY_MS / _lookup(kind, HALF_LIVES, 1e9))
    return F.struct(half_up(value * decay).alias("value"), half_up(confidence * F.sqrt(decay)).alias("confidence"))


def taste_confidence(observations: Column, consistency: Column, recency: Column) -> Column:
    return half_up(clamp((1 - F.exp(-F.greatest(F.lit(0), observations) / 12)) * 0.6 + clamp(consistency) * 0.25 + clamp(recency) * 0.15))


def skip_causes(position: Column, duration: Column, in_transition: Column, similar_before: Column, mismatch: Column) -> Column:
    """struct of how likely each cause of a skip is."""
    ratio = F.when(duration > 0, clamp(position / duration)).otherwise(0.0)
    late, early = ratio >= 0.88, ratio <= 0.08
    return F.struct(
        F.when(late, 0.05).when(early, 0.72).when(in_transition, 0.24).otherwise(0.48).alias("track"),
        F.when(in_transition, 0.75).otherwise(0.08).alias("transition"),
        half_up(clamp(F.abs(mismatch))).alias("session"),
        half_up(clamp(similar_before / 6)).alias("fatigue"),
        F.when(late, 0.75).when(in_transition, 0.45).otherwise(0.1).alias("timing"),
    )


def overplay(recent: Column, favorite: Column) -> Column:
    """struct(overplayed, penalty, recovery_days) of plays in the last week."""
    threshold = F.when(favorite, 14).otherwise(9)
    excess = F.greatest(F.lit(0), recent - threshold)
    return F.struct((excess > 0).alias("overplayed"), half_up(clamp(excess / threshold)).alias("penalty"), F.when(excess > 0, F.least(F.lit(30), 3 + excess * 2)).otherwise(0).cast("long").alias("recovery_days"))


def rediscovery(affinity: Column, last_played: Column, last_loved: Column, plays: Column, fit: Column, now_ms: int) -> Column:
    months, years = F.greatest(F.lit(0), now_ms - last_played) / (30 * DAY_MS), F.greatest(F.lit(0), now_ms - last_loved) / (365 * DAY_MS)
    return half_up(clamp(affinity * 0.32 + clamp(months / 14) * 0.3 + clamp(years / 2) * 0.12 + fit * 0.2 + clamp(plays / 20) * 0.06))


def relevance_change(outcome: Column) -> Column:
    """Aggregate: sum of what outcomes add, within half a unit."""
    return half_up(clamp(F.sum(_lookup(outcome, OUTCOMES)), -0.5, 0.5))


def chart_confidence(sample: Column, listeners: Column, agreement: Column, coverage: Column, authenticity: Column, scope: Column) -> Column:
    saturated = lambda n, digits: clamp(F.log10(F.greatest(F.lit(1.0), n)) / digits)
    total = saturated(sample, 6) * 0.24 + saturated(listeners, 5) * 0.2 + clamp(agreement) * 0.2 + clamp(coverage) * 0.14 + clamp(authenticity) * 0.22
    return half_up(clamp(total * _lookup(scope, SCOPES)))


def authenticity(listeners: Column, listens: Column, ages: Column, places: Column, saves: Column, completion: Column, spread: Column) -> Column:
    """struct(authenticity, suspicious, anomalies) of a trend."""
    repeats = F.when(listens > 0, listens / F.greatest(F.lit(1), listeners)).otherwise(0.0)
    odd = [
        ("extreme-repeat-ratio", repeats > 18),
        ("low-account-age-diversity", ages < 0.2),
        ("geographic-concentration", places < 0.12),
        ("weak-organic-engagement", (saves < 0.03) & (completion < 0.25)),
        ("low-organic-spread", spread < 0.15),
    ]
    n = reduce(lambda a, b: a + b, (F.coalesce(x, F.lit(False)).cast("int") for _, x in odd))
    positive = clamp(ages) * 0.18 + clamp(places) * 0.17 + clamp(saves * 3) * 0.16 + clamp(completion) * 0.16 + clamp(spread) * 0.2 + clamp(listeners / 1000) * 0.13
    a = clamp(positive - n * 0.1)
    return F.struct(half_up(a).alias("authenticity"), ((n >= 2) | (a < 0.35)).alias("suspicious"), F.concat_ws(",", *(F.when(x, name) for name, x in odd)).alias("anomalies"))


def chart_privacy(scope: Column, listeners: Column, private: Column) -> Column:
    """struct(publishable, threshold, exact): k-anonymity of charts; small circles need fewer but never show counts."""
    social = scope.isin("friend-circle", "party", "community", "city")
    least = F.when(social, 10).otherwise(25)
    return F.struct(((listeners >= least) & ~private).alias("publishable"), least.alias("threshold"), (~social & (listeners >= least * 5)).alias("exact"))


def surprise_budget(used: Column, cost: Column, phase: Column) -> Column:
    """struct(remaining, allowed, penalty)."""
    capacity = F.when(phase.isin("peak", "finale"), 1.0).when(phase == "warmup", 0.62).otherwise(0.78)
    left = clamp(capacity - clamp(used))
    ok = cost <= left + 0.08
    return F.struct(half_up(left).alias("remaining"), ok.alias("allowed"), half_up(F.when(ok, 0.0).otherwise(clamp((cost - left) / F.greatest(F.lit(0.1), cost)))).alias("penalty"))


def prior_update(prior: Column, prior_confidence: Column, evidence: Column, sample: Column) -> Column:
    """struct(value, weight): a prior that evidence overtakes as its sample grows."""
    sure = clamp(1 - F.exp(-F.greatest(F.lit(0), sample) / 8))
    w = clamp(prior_confidence) * (1 - sure * 0.7)
    total = F.greatest(F.lit(0.001), w + sure)
    return F.struct(half_up((prior * w + evidence * sure) / total).alias("value"), half_up(sure / total).alias("weight"))


def consumption_trend(absolute: Column, growth: Column, baseline: Column, sharing: Column, spread: Column, renewed: Column, age_days: Column) -> Column:
    """struct(trend, confidence): the best of six explanations of how a thing is consumed, and its lead over the next."""
    old = (age_days >= 365).cast("int")
    scores = {
        "popular": clamp(absolute),
        "trending": clamp(growth * 0.7 + baseline * 0.3),
        "viral": clamp(sharing * 0.55 + spread * 0.45),
        "rising": clamp(growth * 0.7 + (1 - baseline) * 0.3),
        "evergreen": clamp(old * 0.45 + absolute * 0.35 + (1 - growth) * 0.2),
        "rediscovered": clamp(old * 0.35 + renewed * 0.65),
    }
    ranked = F.array_sort(F.array(*(F.struct((-x).alias("o"), F.lit(k).alias("k"), F.lit(n).alias("n")) for k, (n, x) in enumerate(scores.items()))))
    return F.struct(ranked[0]["n"].alias("trend"), half_up(clamp(ranked[1]["o"] - ranked[0]["o"] + 0.45)).alias("confidence"))


def trend_signal(value: Column, hours: Column, half_hours: float) -> Column:
    return half_up(half_life(clamp(value), hours, half_hours))


def hyperbolic_distance(a: Column, b: Column) -> Column:
    """Distance in the Poincaré ball; norms are held under 0.999."""
    squared = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    gap = squared(F.zip_with(a, b, lambda x, y: x - y))
    room = lambda v: 1 - F.least(squared(v), F.lit(0.999 * 0.999))
    return half_up(F.acosh(1 + 2 * gap / (room(a) * room(b))), 6)


def clock_confidence(confidence: Column, drift_ppm: Column, jitter_ns: Column, remote_audio: Column) -> Column:
    penalty = F.least(F.lit(0.6), F.abs(drift_ppm) / 200 + jitter_ns / 100_000_000)
    return half_up(clamp(confidence - penalty - F.when(remote_audio, 0.2).otherwise(0.0)))


def jitter_buffer_ms(jitter: Column, latency: Column) -> Column:
    return F.greatest(F.lit(20), F.ceil(jitter * 3 + latency)).cast("long")
