"""Beat grids: tempo over time, and what the sound around the beats says.

Tempo: rows are beats (key, time). What depends on order is read in sorted partitions with a bounded state."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import half_up
from .folds import ordered_emit, rounded

# Intervals that count as beats; beats of a local tempo and between two looks; the least change, absolute and
# relative; what a variable tempo is; the confidence of a grid.
INTERVALS = (0.15, 2.0)
LOCAL, STRIDE = 7, 4
LEAST_CHANGE, RELATIVE_CHANGE = 0.8, 0.012
LEAST_DRIFT, RELATIVE_DRIFT = 1.5, 0.015
SURE_BEATS, SPREAD, FLOOR = 48, 0.08, 0.35


def local_tempi(beats: DataFrame, key: str, time: str) -> DataFrame:
    """(key, n, bpm, time) of the intervals that count, numbered in order: n from 0, time where the interval starts."""
    by = Window.partitionBy(key).orderBy(time)
    gaps = beats.select(key, time, (F.lead(time).over(by) - F.col(time)).alias("gap"))
    used = gaps.where((F.col("gap") > INTERVALS[0]) & (F.col("gap") < INTERVALS[1]))
    return used.select(key, (F.row_number().over(by) - 1).alias("n"), (60 / F.col("gap")).alias("bpm"), time)


def tempo_report(beats: DataFrame, key: str, time: str) -> DataFrame:
    """(key, median_bpm, min_bpm, max_bpm, drift_bpm, variable, confidence): the middle tempo (the mean of two middle ones), the
    tempi at a tenth and nine tenths, and how sure the grid is, by its length and how little its tempi stray."""
    tempi = local_tempi(beats, key, time)
    counts = beats.groupBy(key).agg(F.count(F.lit(1)).alias("beats"))
    totals = tempi.groupBy(key).agg(F.count(F.lit(1)).alias("m"))
    by = Window.partitionBy(key).orderBy("bpm", "n")
    ranked = tempi.withColumn("at", F.row_number().over(by) - 1).join(totals, key)
    at = lambda k: F.max(F.when(F.col("at") == F.floor(k), F.col("bpm")))
    m = F.col("m")
    named = ranked.groupBy(key).agg(((at((m - 1) / 2) + at(m / 2)) / 2).alias("median"), at(m * 0.1).alias("low"), at(m * 0.9).alias("high"))
    spread = tempi.join(named, key).groupBy(key).agg(F.avg(F.abs(F.col("bpm") - F.col("median"))).alias("off"))
    met = counts.join(named, key).join(spread, key)
    drift, median = F.greatest(F.lit(0.0), F.col("high") - F.col("low")), F.col("median")
    sure = F.least(F.lit(1.0), F.col("beats") / SURE_BEATS) * F.greatest(F.lit(FLOOR), 1 - F.col("off") / F.greatest(F.lit(1.0), median * SPREAD))
    return met.select(
        key, half_up(median).alias("median_bpm"), half_up("low").alias("min_bpm"), half_up("high").alias("max_bpm"), half_up(drift).alias("drift_bpm"),
        (drift >= F.greatest(F.lit(LEAST_DRIFT), median * RELATIVE_DRIFT)).alias("variable"), half_up(sure).alias("confidence"),
    )


def tempo_changes(beats: DataFrame, key: str, time: str) -> DataFrame:
    """(key, n, bpm): the first local tempo (n 0), and those at every fourth beat that differ enough from the one told last. A
    local tempo is the middle one of the seven around a beat; a key holds the last seven."""

    def middle(values: Sequence[float]) -> float:
        x = sorted(values)
        return (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2

    def step(state: tuple, bpm: float) -> tuple[tuple, list[tuple]]:
        n, held, last = state
        held = deque(held, LOCAL)
        held.append(bpm)
        n, out = n + 1, []
        if n == LOCAL:
            last = middle(held)
            out.append((0, rounded(last)))
        at = n - 1 - LOCAL // 2  # the beat that the last seven lie around
        if n >= LOCAL and at >= STRIDE and at % STRIDE == 0 and abs((local := middle(held)) - last) >= max(LEAST_CHANGE, last * RELATIVE_CHANGE):
            out.append((at, rounded(local)))
            last = local
        return (n, tuple(held), last), out

    short = lambda s: [(0, rounded(middle(s[1])))] if 0 < s[0] < LOCAL else []
    return ordered_emit(local_tempi(beats, key, time), key, ["n"], ["bpm"], (0, (), 0.0), step, short, "n long, bpm double")


class Segments:
    """The best cut of a series into pieces of one level, by squared distances and a penalty for each piece, in one pass.

    For each place at which the last piece may begin there is the cost as a parabola over its level, and the levels at which it
    is the least (functional pruning): a beginning that is nowhere least any more is dropped, so few are held however long
    the series. They share the pieces before them as linked nodes."""

    def __init__(self, penalty: float) -> None:
        self.penalty, self.n, self.total, self.squares, self.best = penalty, 0, 0.0, 0.0, -penalty
        # (n, sum, cost without the level's part, levels, node); a node is (begin, sum before, node before)
        self.open: list[tuple] = []
        self.last: tuple | None = None

    def add(self, y: float) -> None:
        node = (self.n, self.total, self.last)
        fresh = (0, 0.0, self.best + self.penalty, [(-np.inf, np.inf)], node)
        taken: list[tuple[float, float]] = []
        kept = []
        for n, s, c, levels, own in self.open:  # where an old beginning is not worse than a new one
            limit = fresh[2] - c
            inner = s * s + n * limit
            if inner < 0:
                continue
            root = inner**0.5
            low, high = (s - root) / n, (s + root) / n
            levels = [(max(a, low), min(b, high)) for a, b in levels if max(a, low) < min(b, high)]
            if levels:
                kept.append((n, s, c, levels, own))
                taken += levels
        free, at = [], -np.inf
        for a, b in sorted(taken):
            if a > at:
                free.append((at, a))
            at = max(at, b)
        if at < np.inf:
            free.append((at, np.inf))
        if free:
            kept.append((*fresh[:3], free, node))
        self.n, self.total = self.n + 1, self.total + y
        self.open = [(n + 1, s + y, c + y * y, levels, own) for n, s, c, levels, own in kept]
        costs = [(c - s * s / n, -own[0]) for n, s, c, _, own in self.open]
        k = min(range(len(costs)), key=costs.__getitem__)
        self.best, self.last = costs[k][0], self.open[k][4]

    def pieces(self) -> list[tuple[int, int, float]]:
        """(begin, n, level) of each piece."""
        out, node, end, total = [], self.last, self.n, self.total
        while node is not None:
            out.append((node[0], end - node[0], (total - node[1]) / (end - node[0])))
            end, total, node = node[0], node[1], node[2]
        return out[::-1]


def segments(df: DataFrame, key: str, order: Sequence[str | Column], value: str, penalty: float) -> DataFrame:
    """(key, piece, begin, n, level, drift, confidence): the pieces of one level that a series is cut into at least squared
    distance, each costing the penalty; rows count from 0. drift is the step from the piece before, confidence how much of a
    piece's step stands out of the penalty: step**2 * n / (step**2 * n + penalty), 1 for the first."""

    def step(state: Segments | None, y: float | None) -> tuple[Segments | None, list[tuple]]:
        state = Segments(penalty) if state is None else state
        if y is not None:
            state.add(float(y))
        return state, []

    def told(state: Segments | None) -> list[tuple]:
        rows, before = [], None
        for k, (begin, n, level) in enumerate(state.pieces() if state else []):
            drift = 0.0 if before is None else level - before
            sure = 1.0 if before is None else drift * drift * n / (drift * drift * n + penalty)
            rows.append((k, begin, n, rounded(level), rounded(drift), rounded(sure)))
            before = level
        return rows

    return ordered_emit(df, key, order, [value], None, step, told, "piece int, begin long, n long, level double, drift double, confidence double")


# The corner of the low-pass in Hz, the part of a beat and the least samples that are heard, the windows' length
# for energy and for ends, the level that counts as loud, and the shares of the reference level that tell an end and an intro.
CORNER, PART, LEAST = 150.0, 0.2, 4
WINDOW, END_WINDOW, LOUD = 0.05, 0.5, 0.2
END_SHARE, INTRO_SHARE, QUIET = 0.45, 0.5, 1e-4
BEATS_LEAST = 8


def downbeat(samples: np.ndarray, rate: float, beats: np.ndarray, interval: float) -> int:
    """Which of four beats has the most bass behind it: a one-pole low-pass runs over a part of each beat, all beats at once,
    and the levels are folded by the beat's number."""
    if len(beats) < BEATS_LEAST:
        return 0
    keep = 1 - np.exp(-2 * np.pi * CORNER / rate)
    width = max(1, int(np.floor(interval * PART * rate)))
    begin = np.maximum(0, np.floor(beats * rate + 0.5).astype(np.int64))
    size = np.minimum(len(samples), np.floor(beats * rate + 0.5).astype(np.int64) + width) - begin
    low, energy = np.zeros(len(beats)), np.zeros(len(beats))
    for k in range(width):
        inside = k < size
        x = samples[np.minimum(begin + k, len(samples) - 1)] if len(samples) else low
        low = np.where(inside, low + keep * (x - low), low)
        energy += np.where(inside, low * low, 0.0)
    heard = size >= LEAST
    levels = np.sqrt(energy / np.maximum(size, 1))
    fold = np.arange(len(beats)) % 4
    means = [levels[heard & (fold == p)].mean() if (heard & (fold == p)).any() else 0.0 for p in range(4)]
    return int(np.argmax(np.floor(np.array(means) * 1e9 + 0.5)))


def window_levels(samples: np.ndarray, width: int) -> np.ndarray:
    """Root mean square of each whole window."""
    n = len(samples) // width if width > 0 else 0
    return np.sqrt((samples[: n * width].reshape(n, width) ** 2).mean(axis=1)) if n else np.zeros(0)


def sound(samples: np.ndarray, rate: float) -> tuple[float, float, float, float]:
    """Energy, percussiveness, seconds at which it has faded for good, seconds until it is up."""
    seconds = len(samples) / rate
    levels = window_levels(samples, int(np.floor(WINDOW * rate)))
    energy = punch = 0.0
    if len(levels):
        mean, top = levels.mean(), np.sort(levels)[int(np.floor(len(levels) * 0.95))]
        energy, punch = min(1.0, mean / LOUD), min(1.0, max(0.0, ((top / mean if mean > 1e-6 else 1.0) - 1) / 2))
    levels = window_levels(samples, int(np.floor(END_WINDOW * rate)))
    end, intro = seconds, 0.0
    reference = np.sort(levels)[int(np.floor(len(levels) * 0.8))] if len(levels) >= 4 and len(samples) >= rate else 0.0
    if reference > QUIET:
        loud = np.nonzero(levels >= reference * END_SHARE)[0]
        last = max(int(loud[-1]) if len(loud) else 0, 0)
        end = seconds if last >= len(levels) - 2 else min(seconds, (last + 1) * END_WINDOW)
        up = np.nonzero(levels >= reference * INTRO_SHARE)[0]
        first = int(up[0]) if len(up) else len(levels) - 1
        intro = 0.0 if first <= 1 else min(first * END_WINDOW, seconds / 3)
    return energy, punch, end, intro


def sound_profiles(df: DataFrame, key: str, samples: str, rate: float, interval: float) -> DataFrame:
    """(key, downbeat, energy, percussiveness, ends, intro) of whole signals (binary: unsigned 8-bit samples) whose beats
    follow each other at an interval from the start. Signals are read a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column(1):
                x = (np.frombuffer(raw.as_py() or b"", np.uint8).astype(float) - 128) / 128
                beats = np.arange(int(np.floor(len(x) / rate / interval))) * interval
                rows.append((downbeat(x, rate, beats, interval), *(rounded(v, 6) for v in sound(x, rate))))
            cols = [pa.array([r[k] for r in rows], pa.int32() if k == 0 else pa.float64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[key, "downbeat", "energy", "percussiveness", "ends", "intro"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, samples).mapInArrow(run, f"{key} {kind}, downbeat int, energy double, percussiveness double, ends double, intro double")
