"""Orders of play: queues whose open places are dealt out step by step."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .folds import ordered_emit, rounded


def ordered_queue(df: DataFrame, key: str, order: Sequence[str | Column], item: str, pinned: str, take: Sequence[str], fit: Callable[[tuple | None, tuple], float], window: int = 3) -> DataFrame:
    """(key, place, item) of queues: pinned items stay where they are, the others are taken in windows of at most so many that
    follow each other, each time the one that fits the item before best. fit(before, next) gets the columns take of both (None
    at the start); it is compared to six digits. Among equals the one that fitted the item before that better comes first,
    and so on back to the window's start, then the earlier one.

    A queue is read in order; its window is a heap by those fits, so a key of any length holds one window."""
    own = df.schema[item].dataType.simpleString()

    def drained(place: int, before: tuple | None, held: list[tuple]) -> tuple[int, tuple | None, list[tuple]]:
        """All of a window, one after the other: what it is worth now goes before what it was worth."""
        heap, out = [((), k, row, values) for k, (row, values) in enumerate(held)], []
        while heap:
            heap = [((-rounded(fit(before, values), 6), *old), k, row, values) for old, k, row, values in heap]
            heapq.heapify(heap)
            _, _, row, before = heapq.heappop(heap)
            out.append((place, row))
            place += 1
        return place, before, out

    def step(state: tuple, row: object, fixed: bool, *values: object) -> tuple[tuple, list[tuple]]:
        place, before, held = state
        out: list[tuple] = []
        if fixed:
            place, before, out = drained(place, before, held)
            return (place + 1, values, ()), [*out, (place, row)]
        held = (*held, (row, values))
        if len(held) == window:
            place, before, out = drained(place, before, held)
            held = ()
        return (place, before, held), out

    return ordered_emit(df, key, order, [item, pinned, *take], (0, None, ()), step, lambda s: drained(*s)[2], f"place long, {item} {own}")


def places(df: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """df with at, the place in its key's queue from 0, and n, the queue's length: what the edits below take."""
    by = Window.partitionBy(key)
    return df.withColumns({"at": F.row_number().over(by.orderBy(*order)) - 1, "n": F.count(F.lit(1)).over(by)})


def without(at: Column, place: int) -> Column:
    """The place after an entry has been taken out; null for that entry."""
    return F.when(at < place, at).when(at > place, at - 1)


def jumped(at: Column, place: int) -> Column:
    """The place after a jump to an entry; null for those before it."""
    return F.when(at >= place, at - place)


def moved(at: Column, n: Column, start: int, to: int) -> Column:
    """The place after an entry has been moved to another place, or to the end of a shorter queue."""
    end = F.least(F.lit(to), n - 1)
    if start <= to:
        return F.when(at == start, end).when((at > start) & (at <= to), at - 1).otherwise(at)
    return F.when(at == start, end).when((at >= to) & (at < start), at + 1).otherwise(at)
