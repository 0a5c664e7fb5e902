"""State that depends on the order of events: saturating scores, smoothed averages, hysteresis, debts.

Each is a fold over a key's rows in a total order. A task reads its keys sorted, batch by batch, and keeps the state of the
key it is in, so a key of any number of rows needs no more memory than its state."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import HALF


def rounded(x: float | None, digits: int = 3) -> float | None:
    """scalars.half_up of a number."""
    return None if x is None else math.floor(x * 10**digits + HALF) / 10**digits


def ordered_fold(df: DataFrame, key: str, order: Sequence[str | Column], take: Sequence[str], start: object, step: Callable, ended: Callable, out: str) -> DataFrame:
    """(key, out): for each key ended(state), a tuple, where state is folded by step(state, *values) from start over the
    rows in order; out is the schema of the tuple."""
    own = df.schema[key]
    schema = T.StructType([own, *T._parse_datatype_string(out).fields])
    arrow = pa.schema([pa.field(f.name, k) for f, k in zip(schema.fields, _arrow(schema), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, start, False
        for batch in batches:
            done = []
            for k, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or k != now:
                    if begun:
                        done.append((now, *ended(state)))
                    now, state, begun = k, start, True
                state = step(state, *values)
            if done:
                yield table(done)
        if begun:
            yield table([(now, *ended(state))])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    ranked = df.repartition(key).sortWithinPartitions(key, *order)
    return ranked.select(key, *take).mapInArrow(run, schema)


def ordered_emit(df: DataFrame, key: str, order: Sequence[str | Column], take: Sequence[str], start: object, step: Callable, ended: Callable, out: str) -> DataFrame:
    """(key, out): the rows that a fold gives out on its way. step(state, *values) is the next state and the tuples that are
    certain by then, ended(state) those left when the key ends; so a key needs no more memory than its state."""
    own = df.schema[key]
    schema = T.StructType([own, *T._parse_datatype_string(out).fields])
    arrow = pa.schema([pa.field(f.name, k) for f, k in zip(schema.fields, _arrow(schema), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, start, False
        for batch in batches:
            done: list[tuple] = []
            for k, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or k != now:
                    if begun:
                        done += [(now, *row) for row in ended(state)]
                    now, state, begun = k, start, True
                state, rows = step(state, *values)
                done += [(now, *row) for row in rows]
            if done:
                yield table(done)
        if begun and (rows := [(now, *row) for row in ended(state)]):
            yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    ranked = df.repartition(key).sortWithinPartitions(key, *order)
    return ranked.select(key, *take).mapInArrow(run, schema)


def _arrow(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]


def saturating_step(s: float, delta: float) -> float:
    """s + delta (1 - |s|), within [-1, 1]."""
    return max(-1.0, min(1.0, s + delta * (1 - abs(s))))


def saturating(df: DataFrame, key: str, order: Sequence[str], delta: str) -> DataFrame:
    """(key, score, n): s <- s + delta (1 - |s|), within [-1, 1]; a null delta changes nothing."""
    step = lambda a, x: (a[0] if x is None else saturating_step(a[0], x), a[1] + 1)
    return ordered_fold(df, key, order, [delta], (0.0, 0), step, lambda a: (rounded(a[0], 6), a[1]), "score double, n long")


def smoothed(df: DataFrame, key: str, order: Sequence[str], value: str, alpha: float) -> DataFrame:
    """(key, level): exponentially weighted average, from the first value on; nulls are passed over."""
    step = lambda a, x: a if x is None else x if a is None else a * (1 - alpha) + x * alpha
    return ordered_fold(df, key, order, [value], None, step, lambda a: (rounded(a, 6),), "level double")


def hysteresis(df: DataFrame, key: str, order: Sequence[str], values: Sequence[str], alpha: float, margin: float) -> DataFrame:
    """(key, state, switches): the name of the value that leads after smoothing; it changes only for a lead by the margin."""

    def step(a: tuple, *x: float) -> tuple:
        levels, state, switches = a
        levels = tuple(old * (1 - alpha) + new * alpha for old, new in zip(levels, x, strict=True))
        best = max(range(len(values)), key=lambda k: (levels[k], -k))
        moves = best != state and levels[best] - levels[state] >= margin
        return levels, best if moves else state, switches + moves

    start = ((0.0,) * len(values), 0, 0)
    return ordered_fold(df, key, order, values, start, step, lambda a: (values[a[1]], int(a[2])), "state string, switches long")


def budget(df: DataFrame, key: str, order: Sequence[str], spent: str, capacity: float, cost: float, recovery: float) -> DataFrame:
    """(key, left, longest): a bucket that spending empties and anything else refills; longest run of spending."""

    def step(a: tuple, spends: bool) -> tuple:
        left, run, longest = a
        left = max(0.0, min(capacity, left - cost if spends else left + recovery))
        run = run + 1 if spends else 0
        return left, run, max(longest, run)

    return ordered_fold(df, key, order, [spent], (capacity, 0, 0), step, lambda a: (rounded(a[0], 6), a[2]), "left double, longest long")


def violation_debt(df: DataFrame, key: str, order: Sequence[str], ok: str) -> DataFrame:
    """(key, open, worst): violations in a row at the end, and the longest such row."""

    def step(a: tuple, fine: bool) -> tuple:
        n = 0 if fine else a[0] + 1
        return n, max(a[1], n)

    return ordered_fold(df, key, order, [ok], (0, 0), step, lambda a: a, "open long, worst long")


def change_points(df: DataFrame, key: str, order: Sequence[str], value: str, least: float, relative: float) -> DataFrame:
    """(key, changes, last): how many values differ from the last one reported by at least the larger of both thresholds,
    and the last of them. Nulls are passed over."""

    def step(a: tuple, x: float | None) -> tuple:
        n, last = a
        new = x is not None and (last is None or abs(x - last) >= max(least, abs(last) * relative))
        return (n + 1, x) if new else a

    return ordered_fold(df, key, order, [value], (0, None), step, lambda a: (a[0], rounded(a[1], 6)), "changes long, last double")


def greedy_fill(df: DataFrame, key: str, score: str, size: str, item: str, room: float, slack: float) -> DataFrame:
    """(key, items, filled): items by score into room, skipping what overshoots by more than the slack, until it is full.
    The state is what has been taken, which the room bounds."""

    def step(a: tuple, x: int, s: float) -> tuple:
        filled, items = a
        return (filled + s, (*items, x)) if filled < room and filled + s <= room + slack else a

    rows = df.withColumn(size, F.col(size).cast("double"))
    return ordered_fold(rows, key, [F.desc(score), F.col(item)], [item, size], (0.0, ()), step, lambda a: (list(a[1]), rounded(a[0])), "items array<bigint>, filled double")
