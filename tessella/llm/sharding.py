"""Sharding by best-fit-decreasing bin packing.

The indivisible groups (equal texts) are summed up first, map side. All of them are packed, sorted by size: each enters the
tightest bin that still takes it, found in a balanced tree of remaining capacities. Groups of one size are a run, and a run
is packed at once, since after a group has entered the tightest bin that bin is the tightest still: so only the table of
sizes (size, groups) reaches the driver. Sizes over EXACT bytes count as the next number of 16 leading bits, by which a bin
holds 1/32768 less at most, so that table is bounded (a million rows for sizes up to a terabyte) however large the input.
The groups of a run are numbered and take the bins in that order.

Groups that exceed what the others leave to each other bin get bins of their own, and the fair share is what is left. A group
of several rows over the fair share of all can't stay whole; its rows are dealt in turn into PIECES pieces for each bin it
would fill (one row a piece at least), which are packed like any group.

Nulls: a null text has no bytes (size is the overhead alone) and forms a group with other nulls and empty texts. Null
doc_ids and rows that repeat a doc_id are told apart by their place in the table of sizes. Ties: equal groups of a run are
taken in the order of their hash. A very long text is a group as any other. Empty input gives an empty result; further
columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small, stored

OVERHEAD = 16
PIECES = 16
#: Up to this size of a group the packer knows it to the byte.
EXACT = 1 << 16
#: Rows that one task numbers, about, up to 4096 tasks for one value.
NUMBERED = 250_000
#: Rows of a group from which on it is sent to the rows.
OFTEN = 10_000


class Treap:
    """A balanced tree of (remaining capacity, bin), with the seeded priorities of a treap."""

    def __init__(self, seed: int = 7) -> None:
        self._root: list | None = None
        self._rng = random.Random(seed)

    def add(self, key: tuple[int, int]) -> None:
        low, high = self._split(self._root, key)
        self._root = self._join(self._join(low, [key, self._rng.random(), None, None]), high)

    def take_at_least(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the smallest key whose capacity is at least size."""
        low, high = self._split(self._root, (size, -1))
        if high is None:
            self._root = low
            return None
        first = high
        while first[2] is not None:
            first = first[2]
        _, rest = self._split(high, (first[0][0], first[0][1] + 1))
        self._root = self._join(low, rest)
        return first[0]

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        """Trees of the keys below key, and of the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _join(self, low: list | None, high: list | None) -> list | None:
        if low is None or high is None:
            return high if low is None else low
        if low[1] < high[1]:
            low[3] = self._join(low[3], high)
            return low
        high[2] = self._join(low, high[2])
        return high


def best_fit_decreasing(runs: list[tuple[int, int]], capacity: int) -> list[list[tuple[int, int]]]:
    """For each run (size, items) the bins (bin, items) that its items enter one after the other; opens a bin when none takes
    an item. An item over the capacity gets a bin of its own."""
    out, free, opened = [[] for _ in runs], Treap(), 0
    for k in sorted(range(len(runs)), key=lambda k: (-runs[k][0], k)):
        size, left = runs[k]
        while left:
            found = free.take_at_least(size)
            room, at = found if found else (max(capacity, size), opened)
            opened += found is None
            n = min(left, room // size) if size else left
            out[k].append((at, n))
            left -= n
            free.add((room - n * size, at))
    return out


def fair_share(sizes: list[int], total: int, n_bins: int) -> tuple[int, float]:
    """Of the largest sizes, from the largest on: how many items exceed what the others leave to each other bin, and that."""
    alone = 0
    for size in sizes[: n_bins - 1]:
        if size * (n_bins - alone) <= total:
            break
        alone, total = alone + 1, total - size
    return alone, total / (n_bins - alone)


def pack_into(runs: list[tuple[int, int]], n_bins: int) -> list[list[tuple[int, int]]]:
    """Best fit into n_bins bins. Items over the fair share of the others get bins of their own; the rest is packed at the least
    capacity, up to one part in 2**12, for which the other bins suffice."""
    if not runs:
        return []
    order = sorted(range(len(runs)), key=lambda k: (-runs[k][0], k))
    largest = [runs[k][0] for k in order for _ in range(min(runs[k][1], n_bins))][:n_bins]
    alone, fair = fair_share(largest, sum(s * n for s, n in runs), n_bins)
    out, rest, at = [[] for _ in runs], list(runs), 0
    for k in order:
        n = min(alone - at, runs[k][1])
        out[k] += [(at + i, 1) for i in range(n)]
        rest[k] = (runs[k][0], runs[k][1] - n)
        at += n
    least = max(math.ceil(fair), max((s for s, n in rest if n), default=0))
    step, low, best = 0, -1, None
    while best is None or step - low > max(1, least >> 12):
        tried = best_fit_decreasing(rest, least + (step if best is None else (low + step) // 2))
        fits = max((b for run in tried for b, _ in run), default=0) < n_bins - alone
        if best is None:
            best, low, step = (tried, low, step) if fits else (None, step, max(1, 2 * step, least >> 12))
        elif fits:
            best, step = tried, (low + step) // 2
        else:
            low = (low + step) // 2
    for k, run in enumerate(best):
        out[k] += [(alone + b, n) for b, n in run]
    return out


def size_class(size: Column) -> Column:
    """The size itself up to EXACT, beyond it the next number with 16 leading bits."""
    unit = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.floor(F.log2(size.cast("double"))) - 15))
    return F.when(size <= EXACT, size).otherwise((F.ceil(size / unit) * unit).cast("long"))


def shard(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), one row for each row of docs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    rows = stored(rows, "sizes")
    group = ["h", "text_crc32", "size"]
    groups = stored(rows.groupBy(*group).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("copies")), "groups")
    total, n_rows, n_groups = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("copies"), F.lit(0)), F.count(F.lit(1))).first()
    if not n_rows:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    fair = -(-total // n_shards)

    # groups over the fair share, fewer than shards, are cut into pieces of some rows each; a row stays whole
    huge = groups.where((F.col("bytes") > fair) & (F.col("copies") > 1)).select(*group, F.least("copies", F.ceil(F.col("bytes") * PIECES / fair)).alias("n"))
    units = groups.select(*group, F.lit(0).alias("piece"), "bytes", "copies")
    if huge.limit(1).count():
        apart = stored(numbered(rows.join(F.broadcast(huge), group), group, n_rows, ["row"]).withColumn("piece", (F.col("slot") % F.col("n")).cast("int")).drop("n", "slot"), "apart")
        pieces = apart.groupBy(*group, "piece").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("copies"))
        units = units.join(F.broadcast(huge.drop("n")), group, "left_anti").union(pieces)
        rows = rows.join(F.broadcast(huge.drop("n")), group, "left_anti").withColumn("piece", F.lit(0)).unionByName(apart)
    else:
        rows = rows.withColumn("piece", F.lit(0))
    units = stored(units.withColumn("run", size_class(F.col("bytes"))), "units")

    runs = sorted((r.run, r.n) for r in units.groupBy("run").agg(F.count(F.lit(1)).alias("n")).collect())  # bounded, see above
    spans = []
    for (size, _), bins in zip(runs, pack_into(runs, n_shards), strict=True):
        at = 0
        for own, n in bins:
            spans.append((size, at, at + n, own))
            at += n
    n_spans = len(spans)
    spans = spark.createDataFrame(spans, "run long, first long, next long, shard int").withColumnRenamed("run", "span_run")
    placed = numbered(units, ["run"], n_groups, [*group, "piece"])
    place = (F.col("run") == F.col("span_run")) & (F.col("slot") >= F.col("first")) & (F.col("slot") < F.col("next"))
    placed = stored(placed.join(small(spans, n_spans), place).select(*group, "piece", "copies", "shard"), "placed")

    # groups of many rows are sent to the rows, the others meet them by a shuffle
    key = [*group, "piece"]
    often = placed.where(F.col("copies") > OFTEN)
    seldom = rows.join(small(placed.where(F.col("copies") <= OFTEN), n_groups), key).select("doc_id", "row", "size", "text_crc32", "shard")
    if often.limit(1).count():
        hot = F.broadcast(often)  # n_rows / OFTEN rows at most
        # rows of often repeated texts leave before the shuffle
        rest = rows.join(hot, key, "left_anti").join(small(placed.where(F.col("copies") <= OFTEN), n_groups), key)
        seldom = rest.select("doc_id", "row", "size", "text_crc32", "shard").union(rows.join(hot, key).select("doc_id", "row", "size", "text_crc32", "shard"))
    slots = numbered(stored(seldom, "sharded"), ["shard"], n_rows, ["doc_id", "row"])
    return slots.select("doc_id", "size", "text_crc32", "shard", "slot")


def numbered(placed: DataFrame, by: list[str], n_rows: int, order: list[str]) -> DataFrame:
    """Adds slot, gapless from 0 in each value of by. Parts of a value are numbered each in its task, and start where the
    parts before them, whose counts are summed up first, end."""
    parts = max(1, min(4096, n_rows // NUMBERED), min(16, n_rows // 40))
    cut = placed.withColumn("part", F.pmod(F.xxhash64(*order, F.lit(3)), F.lit(parts)).cast("int"))
    counts = cut.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*by, "part", F.coalesce(before, F.lit(0)).alias("start"))
    at = F.row_number().over(Window.partitionBy(*by, "part").orderBy(*order))
    return cut.withColumn("at", at).join(starts, [*by, "part"]).withColumn("slot", F.col("start") + F.col("at") - 1).drop("part", "at", "start")
