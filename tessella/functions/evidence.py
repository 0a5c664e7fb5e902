"""Scores of tracks, moves and their evidence as column functions, and validators that name the first fault."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import camelot_score, clamp, cosine01, half_up, once, tempo_relation

# Sets of moves, weights of sums and steps of ladders, which the results depend on.
COMPLEX = ("bassdrop", "gate", "riser", "spinback", "roll", "acapella")
HARD = ("cut", "spinback", "roll")
MASKING = ("filter", "gate", "echo", "riser")
GENOME_WEIGHTS = (1.0, 1.4, 1.3, 1.1, 1.0, 0.7, 0.8, 0.7, 0.9, 0.9, 0.6, 0.9, 1.1)
QUALITY = {"timing": 0.24, "harmonic": 0.15, "tempo": 0.17, "energy": 0.1, "execution": 0.18, "stretch": 0.06, "feedback": 0.1}
SEMANTIC = {
    "audio": 0.19, "genre": 0.12, "artist": 0.08, "lyrics": 0.07, "mood": 0.1, "tempo": 0.08, "key": 0.08, "structure": 0.09, "listening": 0.1, "playlists": 0.09,
}
CODEC = {"delay": 0.15, "padding": 0.1, "loudness": 0.15, "peak": 0.2, "transient": 0.2, "spectral": 0.2}


def steps(x: Column, table: Sequence[tuple[float, float]], otherwise: Column | float) -> Column:
    """The value of the first step that x does not exceed."""
    out = reduce(lambda c, s: c.when(x <= s[0], F.lit(s[1])), table, F.when(F.lit(False), F.lit(0.0)))
    return out.otherwise(otherwise)


def _ranked(parts: dict[str, Column], digits: int = 9) -> Column:
    """array of struct(o, k, n) by value, the largest first, earlier names first among equals."""
    return F.array_sort(F.array(*(F.struct((-half_up(x, digits)).alias("o"), F.lit(k).alias("k"), F.lit(n).alias("n")) for k, (n, x) in enumerate(parts.items()))))


def largest(parts: dict[str, Column]) -> Column:
    """The name of the largest part, the earlier one first among equals."""
    return _ranked(parts)[0]["n"]


def feedback_causes(after_ms: Column, ratio: Column, move: Column, dislike: Column, energy_delta: Column, repeats: Column) -> Column:
    """struct(track, transition, session, repetition, confidence, dominant, learn_track, learn_transition): how likely each
    cause of a piece of feedback is; nulls are what is not known."""
    known = lambda c, x: F.when(c, x).otherwise(0.0)

    def parts(i: Column) -> Column:
        early, heard, kind, delta, times = (i[n] for n in ("after_ms", "ratio", "move", "energy_delta", "repeats"))
        transition = F.when(early.isNull(), 0.06).otherwise(steps(early, ((4000, 0.9), (12_000, 0.68), (30_000, 0.35)), 0.05)) + F.when(kind.isin(*COMPLEX), 0.18).otherwise(0.0)
        liked = F.when(heard.isNull(), 0.28).when(heard < 0.04, 0.16).when(heard < 0.15, 0.46).when(heard < 0.5, 0.74).otherwise(0.9)
        session = F.when(delta.isNull(), 0.2).otherwise(0.22 + F.abs(delta) * 2)
        repetition = F.least(F.lit(0.9), F.greatest(F.lit(0), F.coalesce(times, F.lit(0))) * 0.24)
        sure = 0.28 + known(early.isNotNull(), 0.2) + known(heard.isNotNull(), 0.2) + known(kind.isNotNull(), 0.12) + known(delta.isNotNull(), 0.1) + known(times > 0, 0.06)
        return F.struct(F.when(i["dislike"], 1.4).otherwise(liked).alias("track"), transition.alias("transition"), session.alias("session"), repetition.alias("repetition"), half_up(clamp(sure)).alias("sure"))

    def shares(p: Column) -> Column:
        names = ("track", "transition", "session", "repetition")
        total = p["transition"] + p["track"] + p["session"] + p["repetition"]
        return F.struct(*(half_up(p[n] / total).alias(n) for n in names), p["sure"].alias("confidence"))

    def ranked(s: Column) -> Column:
        order = _ranked({n: s[n] for n in ("track", "transition", "session", "repetition")})
        first = once(order, lambda o: F.when(half_up(o[1]["o"] - o[0]["o"], 6) >= 0.08, o[0]["n"]).otherwise("uncertain"))
        return F.struct(s.alias("s"), first.alias("dominant"))

    def told(r: Column) -> Column:
        s, learns = r["s"], lambda n: (r["s"]["confidence"] >= 0.6) & (r["dominant"] == n) & (r["s"][n] >= 0.45)
        own = [s[n].alias(n) for n in ("track", "transition", "session", "repetition", "confidence")]
        return F.struct(*own, r["dominant"].alias("dominant"), learns("track").alias("learn_track"), learns("transition").alias("learn_transition"))

    given = {"after_ms": after_ms, "ratio": ratio, "move": move, "dislike": dislike, "energy_delta": energy_delta, "repeats": repeats}
    return once(once(once(once(F.struct(*(x.alias(n) for n, x in given.items())), parts), shares), ranked), told)


def track_vector(bpm: Column, energy: Column, dance: Column, punch: Column, centroid: Column, rolloff: Column, flatness: Column, flux: Column, genre: Column, swing: Column) -> Column:
    """Thirteen features in [0, 1]; genre becomes four of them."""
    within = lambda x, low, high: clamp((x - low) / (high - low))
    hot = [F.when(genre == g, 1.0).otherwise(0.0) for g in ("edm", "hiphop", "pop", "chill")]
    dance = F.least(F.lit(1.0), F.coalesce(dance, F.lit(1.5)) / 3)
    parts = [within(bpm, 70, 140), clamp(energy), dance, clamp(punch), within(centroid, 800, 5000), within(rolloff, 1000, 12_000), F.least(F.lit(1.0), flatness * 5), within(flux, 0, 0.4)]
    return F.array(*parts, *hot, clamp((F.coalesce(swing, F.lit(0.5)) - 0.5) / 0.2))


def genome_similarity(a: Column, b: Column) -> Column:
    """One less the weighted root mean square distance; a half for vectors that are missing or of different lengths."""
    weight = F.transform(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1))), lambda i: F.coalesce(F.get(F.array(*map(F.lit, GENOME_WEIGHTS)), i - 1), F.lit(1.0)))
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
    total = F.aggregate(F.zip_with(squares, weight, lambda s, w: s * w), F.lit(0.0), lambda s, x: s + x)
    rms = F.sqrt(total / F.aggregate(weight, F.lit(0.0), lambda s, x: s + x))
    return F.when(F.size(a) == F.size(b), clamp(1 - rms)).otherwise(F.lit(0.5))


def serendipity(unexpected: Column, relevance: Column, fit: Column) -> Column:
    return half_up(clamp(unexpected) * clamp(relevance) * clamp(fit))


def genre_by_sound(centroid: Column, flatness: Column, punch: Column, energy: Column, dance: Column) -> Column:
    """Family of genres by brightness, noise and drive; energy and dance may be null."""
    driving = (F.coalesce(energy, F.lit(0.6)) >= 0.6) | (F.coalesce(dance, F.lit(1.5)) >= 2) | (punch >= 0.45)
    return (
        F.when((punch < 0.3) & (centroid < 2900), "chill")
        .when((energy < 0.32) & (punch < 0.42), "chill")
        .when((punch >= 0.42) & (centroid < 2700) & (flatness < 0.09), "hiphop")
        .when(((centroid >= 3100) | (flatness >= 0.14)) & driving, "edm")
        .when((centroid >= 3400) | (flatness >= 0.18), "edm")
        .when(punch >= 0.3, "pop")
        .otherwise("chill")
    )


def genre_evidence(told: Column, heard: Column) -> Column:
    """struct(genre, confidence, conflicted) of what the title says and what the sound says, unknown for nothing."""
    has_told, has_heard = told != "unknown", heard != "unknown"
    conflict = has_told & has_heard & (told != heard)
    confidence = F.when(has_told & (told == heard), 0.92).when(conflict, 0.42).when(has_heard, 0.7).when(has_told, 0.58).otherwise(0.2)
    return F.struct(F.when(has_told, told).otherwise(heard).alias("genre"), confidence.alias("confidence"), conflict.alias("conflicted"))


def reconciled_tempo(bpm: Column, hint: Column, phase: Column) -> Column:
    """struct(bpm, factor, phase): a tempo that was taken for its half or double, by a hint (null: none)."""
    ratio = hint / bpm
    usable = (hint >= 40) & (hint <= 260) & (bpm > 0)
    factor = F.when(usable & (ratio > 1.75) & (ratio < 2.25), 2.0).when(usable & (ratio > 0.44) & (ratio < 0.57), 0.5).otherwise(1.0)
    moved = F.when(factor == 2.0, phase * 2 % 4).when(factor == 0.5, F.floor(phase / 2)).otherwise(phase)
    return F.struct(F.when(usable, half_up(bpm * factor, 1)).otherwise(bpm).alias("bpm"), factor.alias("factor"), moved.cast("long").alias("phase"))


def band_gains(t: Column) -> Column:
    """struct(low, mid, high): the gains of the incoming side at a place in a blend; the outgoing side has the rest."""

    def ramp(start: float, end: float) -> Column:
        x = clamp((t - start) / (end - start))
        return x * x * (3 - 2 * x)

    return F.struct(ramp(0.46, 0.58).alias("low"), ramp(0.25, 0.7).alias("mid"), ramp(0.0, 0.45).alias("high"))


def loudness_windows(samples: Column, width: int) -> Column:
    """Root mean square of each whole window of so many samples."""
    n = F.floor(F.size(samples) / width).cast("int")
    squares = lambda k: F.aggregate(F.slice(samples, k * width + 1, width), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.sqrt(squares(k) / width))).otherwise(F.array().cast("array<double>"))


def envelope(rms: Column) -> Column:
    """struct(energy, punch, musical_end, intro) of the loudness of windows: level and crest, and the windows after which it
    has faded for good and in which it first is up."""
    n, ordered = F.size(rms), F.array_sort(rms)
    mean = F.aggregate(rms, F.lit(0.0), lambda s, x: s + x) / F.greatest(n, F.lit(1))
    at = lambda p: F.get(ordered, F.floor(n * p).cast("int"))
    crest = F.when(mean > 1e-6, F.coalesce(at(0.95), mean) / mean).otherwise(1.0)
    level = at(0.8)
    heard = (n >= 4) & (level > 1e-4)
    spots = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    last = F.greatest(F.coalesce(F.array_max(F.filter(spots, lambda k: F.get(rms, k) >= level * 0.45)), F.lit(0)), F.lit(0))
    first = F.coalesce(F.array_min(F.filter(spots, lambda k: F.get(rms, k) >= level * 0.5)), n - 1)
    end = F.when(~heard | (last >= n - 2), n).otherwise(last + 1)
    intro = F.when(~heard | (first <= 1), 0.0).otherwise(F.least(first.cast("double"), n / 3))
    return F.struct(
        half_up(F.when(n > 0, F.least(F.lit(1.0), mean / 0.2)).otherwise(0.0), 6).alias("energy"), half_up(F.when(n > 0, clamp((crest - 1) / 2)).otherwise(0.0), 6).alias("punch"),
        end.cast("long").alias("musical_end"), half_up(intro, 6).alias("intro"),
    )


def tempo_family(detected: Column, prior: Column, strength: Column) -> Column:
    """struct(canonical, alternatives): of a tempo, its double and its half within [45, 220] the nearest to a prior (null:
    none) by its strength, and the others."""
    made = F.filter(F.array(detected, detected * 2, detected / 2), lambda x: (x >= 45) & (x <= 220))
    kept = F.array_distinct(F.transform(made, lambda x: half_up(x)))
    near = lambda x: half_up(F.abs(x - prior) * clamp(strength) + F.abs(x - detected) * (1 - clamp(strength)), 9)
    best = F.array_min(F.transform(kept, lambda x, k: F.struct(near(x).alias("d"), k.alias("k"), x.alias("x"))))["x"]
    canonical = half_up(F.when(prior.isNull(), detected).otherwise(best))
    return F.struct(canonical.alias("canonical"), F.filter(kept, lambda x: x != canonical).alias("alternatives"))


def codec_risk(delay: Column, padding: Column, loudness: Column, peak: Column, transient: Column, spectral: Column) -> Column:
    """What a round trip through a codec risks, in [0, 1]."""
    parts = {"delay": F.abs(delay) / 1024, "padding": F.abs(padding) / 1024, "loudness": F.abs(loudness), "peak": F.abs(peak), "transient": transient, "spectral": spectral}
    return half_up(reduce(lambda a, b: a + b, (clamp(x) * CODEC[n] for n, x in parts.items())))


def sync_quality(parts: dict[str, Column]) -> Column:
    """struct(weakest, blend_ready)."""
    ready = reduce(lambda a, b: a & b, (x >= 0.7 for x in parts.values()))
    return F.struct(largest({n: -x for n, x in parts.items()}).alias("weakest"), ready.alias("blend_ready"))


def semantic_similarity(parts: dict[str, Column]) -> Column:
    """struct(total, strongest): the weighted sum of ten signals, and the names of the three that give most."""
    terms = {n: clamp(parts[n]) * w for n, w in SEMANTIC.items()}
    return F.struct(half_up(reduce(lambda a, b: a + b, terms.values())).alias("total"), F.transform(F.slice(_ranked(terms), 1, 3), lambda x: x["n"]).alias("strongest"))


def layered_vector(layers: Sequence[tuple[Column, float]]) -> Column:
    """Mean of vectors by weight over their shortest length; a null vector is left out."""
    n = F.least(*(F.size(v) for v, _ in layers))
    weight = reduce(lambda a, b: a + b, (F.when(v.isNotNull(), F.lit(float(w))).otherwise(0.0) for v, w in layers))
    zero = F.transform(F.sequence(F.lit(1), n), lambda i: F.lit(0.0))
    total = reduce(lambda acc, layer: F.when(layer[0].isNull(), acc).otherwise(F.zip_with(acc, F.slice(layer[0], 1, n), lambda x, y: x + y.cast("double") * layer[1])), layers, zero)
    return F.transform(total, lambda x: x / F.when(weight > 0, weight).otherwise(1.0))


def embedding_affinity(user: Column, context: Column, track: Column) -> Column:
    """How near a track is to a listener (0.6) in a context (0.4)."""
    blend = F.zip_with(user, context, lambda x, y: x.cast("double") * 0.6 + y.cast("double") * 0.4)
    return half_up(cosine01(blend, track), 6)


def timbral_continuity(a: Column, b: Column) -> Column:
    """struct(continuity, shock, compensated): mean difference of two profiles, the shorter one filled up with zeros."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(F.coalesce(x.cast("double"), F.lit(0.0)) - F.coalesce(y.cast("double"), F.lit(0.0))))
    shock = clamp(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(gaps), F.lit(1)))
    return F.struct(half_up(1 - shock).alias("continuity"), half_up(shock).alias("shock"), (shock > 0.35).alias("compensated"))


def reasons(parts: dict[str, Column], most: int = 3) -> Column:
    """Names of the largest positive parts, joined."""
    positive = F.filter(_ranked(parts), lambda x: x["o"] < 0)
    return F.array_join(F.transform(F.slice(positive, 1, most), lambda x: x["n"]), ", ")


def grounded_reasons(parts: dict[str, tuple[Column, Column, Column]]) -> Column:
    """Names of the parts (score, confidence, grounded) that are grounded, sure and high, by their product."""
    made = [F.when(g & (c >= 0.6) & (s >= 0.6), F.struct((-half_up(s * c, 9)).alias("o"), F.lit(k).alias("k"), F.lit(n).alias("n"))) for k, (n, (s, c, g)) in enumerate(parts.items())]
    return F.array_join(F.transform(F.array_sort(F.array_compact(F.array(*made))), lambda x: x["n"]), ",")


def loudness_of(energy: Column, punch: Column, dance: Column) -> Column:
    """How intense a track is, of what is known of energy, punch and danceability (to 3); null if nothing is."""
    level = (F.coalesce(energy, punch, F.lit(0.5)) + F.coalesce(punch, energy, F.lit(0.5))) / 2
    whole = level * 0.55 + F.when(dance.isNull(), level).otherwise(clamp(dance / 3)) * 0.45
    return F.when(energy.isNotNull() | punch.isNotNull() | dance.isNotNull(), whole)


def transition_quality(
    move: Column, timing_ms: Column, bpm: tuple[Column, Column], key: tuple[Column, Column, Column], intensity: tuple[Column, Column], execution: tuple[Column, Column, Column], stretch: tuple[Column, Column],
    skip_weight: Column, disliked: Column,
) -> Column:
    """struct(score, grade, the seven parts of QUALITY) of a transition. key: both keys and the lesser confidence; execution:
    mode, slack in ms, reason of a fallback; skip_weight: of an early skip (null: none)."""
    mode, slack, reason = execution
    given = {
        "hard": move.isin(*HARD), "masked": move.isin(*MASKING), "gap": F.when((bpm[0] > 0) & (bpm[1] > 0), once(F.struct(bpm[0].alias("a"), bpm[1].alias("b")), lambda t: tempo_relation(t["a"], t["b"])["gap"] * 100)),
        "harmony": F.when(key[0].isNotNull() & key[1].isNotNull() & (key[2] >= 0.35), camelot_score(key[0], key[1]) * 100), "error": F.abs(timing_ms), "delta": intensity[1] - intensity[0],
        "worst": F.greatest(F.abs(stretch[0] - 1), F.abs(stretch[1] - 1)), "mode": mode, "slack": slack, "reason": reason, "skip": skip_weight, "disliked": disliked,
    }

    def parts(i: Column) -> Column:
        gap, harmony, error, delta, slack = (i[n] for n in ("gap", "harmony", "error", "delta", "slack"))
        soft = steps(gap, ((2, 100.0), (6, 92.0), (8, 84.0), (12, 68.0), (18, 48.0)), 25.0)
        made = {
            "timing": steps(error, ((30, 100.0), (80, 92.0), (150, 75.0), (300, 55.0)), clamp(35 - (error - 300) / 20, 0.0, 35.0)),
            "harmonic": F.when(harmony.isNull(), 72.0).when(i["hard"], F.greatest(F.lit(72.0), harmony)).when(i["masked"], F.greatest(F.lit(68.0), harmony)).otherwise(harmony),
            "tempo": F.when(gap.isNull(), 72.0).when(i["hard"], steps(gap, ((8, 95.0), (18, 88.0), (35, 78.0)), 62.0)).otherwise(soft),
            "energy": F.when(delta.isNull(), 72.0).otherwise(clamp(100 - F.abs(delta - 0.08) * 220, 0.0, 100.0)),
            "execution": F.when(i["mode"] == "offline-cache", 100.0)
            .when(i["mode"] == "offline-render", F.when(slack >= 500, 98.0).when(slack >= 100, 92.0).when(slack >= 0, 84.0).otherwise(70.0))
            .when(i["mode"] == "live", 86.0)
            .when(i["reason"].isin("disabled", "unsupported"), 76.0)
            .otherwise(58.0),
            "stretch": steps(i["worst"], ((0.02, 100.0), (0.05, 92.0), (0.08, 82.0), (0.12, 62.0)), 40.0),
            "feedback": F.when(i["skip"].isNotNull(), clamp(100 - i["skip"] * 100, 0.0, 100.0)).when(i["disliked"], 72.0).otherwise(100.0),
        }
        return F.struct(*(x.alias(n) for n, x in made.items()))

    def scored(p: Column) -> Column:
        total = reduce(lambda a, b: a + b, (p[n] * w for n, w in QUALITY.items()))
        return F.struct(p.alias("p"), half_up(clamp(total, 0.0, 100.0), 1).alias("score"))

    def graded(s: Column) -> Column:
        grade = F.when(s["score"] >= 90, "A").when(s["score"] >= 80, "B").when(s["score"] >= 70, "C").when(s["score"] >= 55, "D").otherwise("F")
        return F.struct(s["score"].alias("score"), grade.alias("grade"), *(half_up(s["p"][n], 1).alias(n) for n in QUALITY))

    return once(once(once(F.struct(*(x.alias(n) for n, x in given.items())), parts), scored), graded)


def first_fault(checks: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first check that fails (null fails), null for a valid row."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks))


def bounded_text(x: Column, most: int = 256) -> Column:
    return (F.length(F.trim(x)) > 0) & (F.length(x) <= most)


def case_fault(c: dict[str, Column]) -> Column:
    """First fault of a case of a listening panel: id, created_ms, from_ref, to_ref, artists, genre_pair, pair_ref, context,
    device, variants (two different ones), split (null: none)."""
    return first_fault([
        ("id", c["id"].rlike("^[a-zA-Z0-9:_-]{1,256}$")), ("created", c["created_ms"] >= 0), ("from", bounded_text(c["from_ref"])), ("to", bounded_text(c["to_ref"])),
        ("artists", (F.size(c["artists"]) <= 8) & F.forall(c["artists"], lambda x: bounded_text(x))), ("genres", bounded_text(c["genre_pair"], 128)), ("pair", bounded_text(c["pair_ref"])),
        ("context", bounded_text(c["context"], 128)), ("device", bounded_text(c["device"], 128)),
        ("variants", (F.size(c["variants"]) == 2) & F.forall(c["variants"], lambda x: bounded_text(x)) & (F.size(F.array_distinct(c["variants"])) == 2)),
        ("split", c["split"].isNull() | c["split"].isin("train", "validation", "test")),
    ])


def event_fault(kind: Column, kinds: Sequence[str], weight: Column, values: Column, most: int = 4096) -> Column:
    """First fault of a ledger event: an unknown kind, a weight out of [0, 1], too many values or one that is no number."""
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return first_fault([("kind", kind.isin(*kinds)), ("weight", weight.between(0, 1)), ("values", F.size(values) <= most), ("number", finite)])
