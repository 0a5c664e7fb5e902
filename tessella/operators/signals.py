"""Signal kernels over arrays of samples, vectorised over Arrow batches where no built-in function says it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import HALF, half_up, index_percentiles

#: Key profiles of Krumhansl, major and minor (fixed values).
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.6, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)


def rms_curve(samples: Column, hop: int) -> Column:
    """Root mean square of each whole hop, divided by the largest."""
    n = F.floor(F.size(samples) / hop).cast("int")
    part = lambda k: F.slice(samples, k * hop + 1, hop)
    energy = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    raw = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.sqrt(energy(part(k)) / hop))
    return F.when(n > 0, F.transform(raw, lambda x: x / F.greatest(F.lit(1e-9), F.array_max(raw)))).otherwise(F.array().cast("array<double>"))


def health(samples: Column) -> Column:
    """struct(peak, dc, clipped): largest magnitude, mean, and share of samples at full scale."""
    n = F.greatest(F.size(samples), F.lit(1))
    as_double = F.transform(samples, lambda x: x.cast("double"))
    total = F.aggregate(as_double, F.lit(0.0), lambda s, x: s + x)
    return F.struct(
        half_up(F.coalesce(F.array_max(F.transform(as_double, F.abs)), F.lit(0.0)), 6).alias("peak"),
        half_up(total / n, 6).alias("dc"),
        half_up(F.size(F.filter(as_double, lambda x: F.abs(x) >= 0.999)) / n, 6).alias("clipped"),
    )


def null_test(a: Column, b: Column) -> Column:
    """Largest difference of two signals; infinite if their lengths differ."""
    worst = F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return F.when(F.size(a) == F.size(b), F.coalesce(worst, F.lit(0.0))).otherwise(F.lit(float("inf")))


#: Share of the magnitude under the rolloff, and the band that decides on a key (fixed values).
ROLLOFF, HEARD = 0.85, (100.0, 5000.0)
PITCHES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def key_names(best: np.ndarray) -> list[tuple[str, str] | tuple[None, None]]:
    """Name and place on the wheel of keys by number: 2 * tonic, one more for minor; below zero: none. A fifth up is one
    place on."""
    out = []
    for k in best.tolist():
        tonic, minor = divmod(k, 2)
        out.append((None, None) if k < 0 else (f"{PITCHES[tonic]} {'minor' if minor else 'major'}", f"{(7 * tonic + (4 if minor else 7)) % 12 + 1}{'A' if minor else 'B'}"))
    return out


def spectra_of(x: np.ndarray, rate: int, size: int) -> dict[str, np.ndarray]:
    """Centroid, rolloff, flatness, flux (means over the frames that are not silent), key and its fit of signals of one
    length (a row each), by the magnitudes of Hann frames that overlap by half. A shorter signal is one frame."""
    x = np.pad(x, ((0, 0), (0, max(0, size - x.shape[1]))))
    frames = np.lib.stride_tricks.sliding_window_view(x, size, axis=1)[:, :: size // 2]
    mag = np.abs(np.fft.rfft(frames * np.hanning(size + 1)[:-1], axis=2))[:, :, 1 : size // 2]
    hz, total = np.fft.rfftfreq(size, 1 / rate)[1 : size // 2], mag.sum(axis=2)
    loud = total >= 1e-9
    safe = np.where(loud, total, 1.0)[:, :, None]
    share, n = mag / safe, np.maximum(loud.sum(axis=1), 1)
    mean = lambda v: np.where(loud, v, 0.0).sum(axis=1) / n
    rolloff = hz[np.minimum((np.cumsum(share, axis=2) < ROLLOFF - 1e-12).sum(axis=2), len(hz) - 1)]
    some = mag > 1e-9
    logs = np.where(some, np.log(np.where(some, mag, 1.0)), 0.0).sum(axis=2) / np.maximum(some.sum(axis=2), 1)
    flat = np.where(total > 0, np.exp(logs) * len(hz) / safe[:, :, 0], 0.0)
    both = loud[:, 1:] & loud[:, :-1]
    rise = np.where(both, np.maximum(np.diff(share, axis=1), 0.0).sum(axis=2), 0.0).sum(axis=1) / np.maximum(both.sum(axis=1), 1)
    heard = (hz >= HEARD[0]) & (hz <= HEARD[1])
    pitch = np.round(12 * np.log2(hz[heard] / 440) + 69).astype(int) % 12
    fold = (pitch[:, None] == np.arange(12)).astype(float)
    chroma = mag.sum(axis=1)[:, heard] @ fold
    profiles = np.stack([np.roll(p, k) for k in range(12) for p in (MAJOR, MINOR)])
    norm = lambda v: (v - v.mean(axis=1, keepdims=True)) / np.maximum(np.linalg.norm(v - v.mean(axis=1, keepdims=True), axis=1, keepdims=True), 1e-12)
    fit = norm(chroma) @ norm(profiles).T
    best = np.where(chroma.max(axis=1, initial=0.0) > 1e-9, fit.argmax(axis=1), -1)
    return {"centroid": mean((share * hz).sum(axis=2)), "rolloff": mean(rolloff), "flatness": mean(flat), "flux": rise, "best": best, "fit": np.where(best >= 0, fit.max(axis=1), 0.0)}


def spectra(df: DataFrame, key: str, samples: str, rate: int, size: int = 4096) -> DataFrame:
    """(key, centroid, rolloff, flatness, flux, key_name, camelot, fit) of each signal (null: silence). The signals of a
    batch that are equally long go through one transform."""
    measures = ["centroid", "rolloff", "flatness", "flux", "fit"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            signals = [np.asarray([] if x is None else x, float) for x in pdf[samples]]
            length = np.array([len(x) for x in signals], int)
            found = {m: np.zeros(len(signals)) for m in measures}
            named = np.full(len(signals), -1)
            for n in np.unique(length):
                rows = np.nonzero(length == n)[0]
                step = max(1, (1 << 22) // max(int(n), size))
                for part in (rows[s : s + step] for s in range(0, len(rows), step)):
                    made = spectra_of(np.stack([signals[k] for k in part]), rate, size)
                    named[part] = made["best"]
                    for m in measures:
                        found[m][part] = made[m]
            names = key_names(named)
            yield pd.DataFrame({key: pdf[key].to_numpy(), **{m: found[m] for m in measures[:4]}, "key_name": [a for a, _ in names], "camelot": [b for _, b in names], "fit": found["fit"]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, samples).mapInPandas(run, f"{key} {kind}, centroid double, rolloff double, flatness double, flux double, key_name string, camelot string, fit double")


#: Bytes of query vectors that go to all tasks at once.
QUERIES_BYTES = 64 << 20


def query_blocks(narrow: DataFrame, wanted: Column) -> Iterator[Broadcast]:
    """The vectors (k, v) that are wanted, as broadcast pairs of keys and a matrix of QUERIES_BYTES at most each, about."""
    queries, sc = narrow.where(wanted), narrow.sparkSession.sparkContext
    n, width = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    blocks = max(1, -(-n * width * 8 // QUERIES_BYTES))
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == block).toPandas()
        yield sc.broadcast((rows["k"].to_numpy(), np.stack(rows["v"].map(np.asarray).tolist()) if len(rows) else np.zeros((0, width))))


def nearest(vectors: DataFrame, key: str, vector: str, wanted: Column, top: int) -> DataFrame:
    """(a, b, score): for each vector that is wanted (a condition on k, its key) the top others by (cosine + 1) / 2, to six
    digits, the smaller key first among equals. The queries go out in blocks of a bounded size; a task multiplies its
    batches with a block and keeps the best of each query, so top rows per query and batch are sent on."""
    narrow = vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))
    out = None
    for held in query_blocks(narrow, wanted):

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, own = held.value
            unit = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-300)
            for pdf in batches:
                if not len(pdf) or not len(ids):
                    continue
                v = np.stack(pdf["v"].map(np.asarray).tolist())
                score = unit @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).T
                score = np.floor(np.clip((score + 1) / 2, 0, 1) * 1e6 + HALF) / 1e6
                b = pdf["k"].to_numpy()
                score[ids[:, None] == b[None, :]] = -1.0
                order = np.stack([np.lexsort((b, -row))[:top] for row in score])
                best = np.take_along_axis(score, order, axis=1).ravel()
                yield pd.DataFrame({"a": np.repeat(ids, order.shape[1]), "b": b[order].ravel(), "score": best})[best >= 0]

        some = narrow.mapInPandas(run, "a long, b long, score double")
        out = some if out is None else out.union(some)
    nth = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    return out.withColumn("nth", nth).where(F.col("nth") <= top).drop("nth")


# Fixed values of groove(): the band of the off-beat, how near a third is one, and the steps of the ladder.


def groove(phases: DataFrame, key: str, phase: str) -> DataFrame:
    """(key, groove): straight, swing, shuffle, triplet or broken, from the places of onsets within their beats (0 to 1).

    Counts and a mean of each key, and the middle one of its off-beats, which a window numbers; no key is gathered."""
    p = F.col(phase)
    inner = phases.where((p > 0.05) & (p < 0.95))
    off = F.least(*(F.abs(p - x) for x in (0.0, 0.25, 0.5, 0.75)))
    counts = inner.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(p - 1 / 3) < 0.045).alias("third"), F.sum(off.cast("decimal(20,9)")).cast("double").alias("off"))
    middle = index_percentiles(inner.where((p >= 0.35) & (p <= 0.75)), [key], phase, {"swing": F.floor(F.col("n") / 2)})
    met = phases.select(key).distinct().join(counts, key, "left").join(middle, key, "left")
    swing, n = F.coalesce("swing", F.lit(0.5)), F.col("n")
    kind = F.when(F.coalesce(n, F.lit(0)) < 8, "straight").when(F.col("third") / n > 0.18, "triplet").when(F.col("off") / n > 0.14, "broken")
    return met.select(key, kind.when(swing < 0.54, "straight").when(swing < 0.61, "swing").otherwise("shuffle").alias("groove"))
