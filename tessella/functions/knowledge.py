"""What is known of tracks as column functions: fused embeddings, terms, stems, and checks of JSON texts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .evidence import first_fault, loudness_windows
from .scalars import clamp, dot, half_up

# How far a source of genres is believed, weights of modalities, and the words of the taxonomy.
RELIABILITY = {"audio-classifier": 0.72, "artist-metadata": 0.58, "track-metadata": 0.75, "user-tag": 0.62, "community-tag": 0.55, "editorial": 0.9}
MODALITIES = {"audio": 0.3, "lyrics": 0.18, "artist": 0.14, "album": 0.08, "tags": 0.14, "playlists": 0.16}
TAXONOMY = {
    "activity": ["driving", "gaming", "working", "workout", "dinner", "sleeping"],
    "social": ["alone", "couple", "friends", "family", "party"],
    "environment": ["night", "rain", "summer", "beach", "city"],
    "function": ["background", "singalong", "dance", "focus", "emotional"],
}


def fused_embedding(parts: dict[str, tuple[Column, Column]], dims: int) -> Column:
    """struct(embedding, confidence) of vectors by modality with their confidence: the weighted mean of those that are there,
    shorter ones filled up with zeros, and the share of all weights that they have."""
    weights = {n: F.when(v.isNotNull(), clamp(c) * MODALITIES[n]).otherwise(0.0) for n, (v, c) in parts.items()}
    total = reduce(lambda a, b: a + b, weights.values())
    zero = F.array_repeat(F.lit(0.0), dims)

    def added(acc: Column, name: str) -> Column:
        v = parts[name][0]
        return F.when(v.isNull(), acc).otherwise(F.zip_with(acc, v, lambda a, x: a + F.coalesce(x, F.lit(0.0)) * weights[name]))

    sums = reduce(added, parts, zero)
    mean = F.transform(sums, lambda x: F.when(total > 0, half_up(x / total)).otherwise(0.0))
    return F.struct(mean.alias("embedding"), half_up(clamp(total / sum(MODALITIES.values()))).alias("confidence"))


def semantic_terms(text: Column) -> Column:
    """array of struct(category, tag) of the taxonomy that the text holds."""
    entries = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(t).alias("tag")) for c, tags in TAXONOMY.items() for t in tags))
    low = F.lower(text)
    return F.filter(entries, lambda e: F.contains(low, e["tag"]))


def response_fault(body: Column) -> Column:
    """First fault of a listening response as JSON: its choice, its two lists of ratings from 1 to 5, its confidence."""
    x = F.from_json(body, "choice string, a array<int>, b array<int>, confidence double")
    rated = lambda c: (F.size(c) > 0) & F.forall(c, lambda v: F.coalesce(v.between(1, 5), F.lit(False)))
    return first_fault([("choice", x["choice"].isin("A", "B", "no-preference")), ("ratings", rated(x["a"]) & rated(x["b"])), ("confidence", x["confidence"].between(0, 1))])


def bundle(body: Column, now: int) -> Column:
    """struct(fault, tracks) of a bundle as JSON (version, expires, tracks): distinct ids in order, and its first fault."""
    x = F.from_json(body, "version int, expires long, tracks array<long>")
    fault = first_fault([("version", x["version"] == 1), ("tracks", F.size(x["tracks"]) > 0), ("expired", x["expires"] > now)])
    return F.struct(fault.alias("fault"), F.array_distinct(x["tracks"]).alias("tracks"))


def _at(ordered: Column, p: float) -> Column:
    """The value at index floor((n - 1) p) of a sorted array."""
    return F.get(ordered, F.floor((F.size(ordered) - 1) * p).cast("int"))


def stem_component(samples: Column, width: int, click: float) -> Column:
    """struct(level, density, dynamic_range, artifact_risk) of a stem: loudness, the share of its windows that are active, how
    far its peaks are over the middle, and what clipping and clicks make likely."""
    n = F.greatest(F.size(samples), F.lit(1))
    ordered = F.array_sort(loudness_windows(samples, width))
    threshold = F.greatest(F.lit(0.004), _at(ordered, 0.1) * 2.5, _at(ordered, 0.5) * 1.25)
    active = F.size(F.filter(ordered, lambda x: x >= threshold)) / F.greatest(F.size(ordered), F.lit(1))
    loud = _at(ordered, 1.0) / F.greatest(F.lit(1e-9), _at(ordered, 0.5))
    clipped = F.size(F.filter(samples, lambda x: F.abs(x) >= 0.995)) / n
    jumps = F.size(F.filter(F.zip_with(samples, F.slice(samples, 2, n), lambda x, y: F.abs(y - x) > click), lambda b: b)) / n
    return F.struct(half_up(F.sqrt(dot(samples, samples) / n), 6).alias("level"), half_up(active).alias("density"), half_up(loud).alias("dynamic_range"), half_up(clamp(clipped * 12 + jumps * 18)).alias("artifact_risk"))


def bleed(stems: Sequence[Column]) -> Column:
    """The largest absolute correlation of two stems."""
    pairs = [(a, b) for i, a in enumerate(stems) for b in stems[i + 1 :]]
    return F.greatest(*(F.abs(dot(a, b)) / F.greatest(F.lit(1e-9), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))) for a, b in pairs))


def vocal_segments(samples: Column, width: int, per_segment: int, least: float) -> Column:
    """array of struct(segment, density, peak, active): the windows of each segment over a threshold that follows the quiet
    and the middle ones."""
    rms = loudness_windows(samples, width)
    ordered = F.array_sort(rms)
    threshold = F.greatest(F.lit(0.004), _at(ordered, 0.1) * 2.5, _at(ordered, 0.5) * 1.3)
    count = F.ceil(F.size(rms) / per_segment).cast("int")

    def segment(k: Column) -> Column:
        own = F.slice(rms, k * per_segment + 1, per_segment)
        density = F.size(F.filter(own, lambda x: x >= threshold)) / F.greatest(F.size(own), F.lit(1))
        return F.struct(k.cast("long").alias("segment"), half_up(density).alias("density"), half_up(F.array_max(own), 6).alias("peak"), (density >= least).alias("active"))

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), segment))
