"""SimHash near-dedup.

Fingerprints are made where the texts lie; only (doc_id, fingerprint) moves. The nodes are the different fingerprints,
whoever carries them. The exact comparison runs in tiles: with radius r the 64 bits are cut into m > r blocks, and two
fingerprints within the radius agree in at least m - r of them, so comparing the nodes that share a choice of m - r
blocks loses no link. m grows with the number of nodes, which keeps such a bucket small. A bucket over the limit is cut
again by the bits not used yet: r + 1 parts of them, of which one must agree. One that is still over it is dealt out as
pairs of parts to many tasks. Inside a task numpy XORs tile against tile and counts bits, leaving out tile pairs whose
population counts differ by more than the radius. A task returns a spanning forest of its links, not all pairs, and the
components come from star contraction over those edges.

Nulls: a null text has no words and so the zero fingerprint; it is linked like any other, and so are the fingerprints
that only null ids carry. A null doc_id is never a component's id unless all ids of that component are null. Rows that
repeat a doc_id each get their row, with the component of their own text: different texts under one id are not linked by
it. Ties: equal fingerprints are one node. Very long texts are counted in slices of bounded memory. An empty table gives
an empty result. Further columns of docs, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import star_components as components
from .common import slices, stored

TILE = 512
#: Nodes of a bucket that one task compares; larger buckets are cut again, and then dealt out as pairs of parts.
BUCKET = 8192
#: Large buckets that are sent to all tasks (16 bytes each); more of them are joined by a shuffle.
BROADCAST = 200_000


def fingerprint(text: str | None, n_words: int = 4) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [x - 1 for x in accumulate(len(w) + 1 for w in words)]
    k = min(n_words, len(words))
    starts = [0, *(e + 1 for e in ends[: len(words) - k])]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :], strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, n_words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                fps = np.array([fingerprint(x, n_words) for x in batch.column("text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(make, "doc_id long, fp long")


def blocks_for(n_nodes: int, radius: int) -> list[int]:
    """Widths of the blocks: the fewest for which a bucket is expected to hold 64 nodes at most."""
    for m in range(radius + 1, radius + 5):
        bits = 64 * (m - radius) // m
        if n_nodes <= 64 << bits:
            break
    return [64 // m + (k < 64 % m) for k in range(m)]


def _bucket_keys(fp: F.Column, widths: list[int], radius: int) -> F.Column:
    """array of struct(key, rest): for each choice of blocks its number and their bits, and the bits of the others."""
    at = [0, *accumulate(widths)]
    part = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << w) - 1)) for a, w in zip(at, widths, strict=False)]

    def joined(start: int, blocks: tuple[int, ...]) -> F.Column:
        out = F.lit(start).cast("long")
        for j in blocks:
            out = F.shiftleft(out, widths[j]).bitwiseOR(part[j])
        return out

    every = range(len(widths))
    keys = []
    for k, chosen in enumerate(combinations(every, len(widths) - radius)):
        others = tuple(j for j in every if j not in chosen)
        keys.append(F.struct(joined(k, chosen).alias("key"), joined(0, others).alias("rest")))
    return F.array(*keys)


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (child, root) that join the same fingerprints as all links within the radius do."""
    order = np.argsort(np.bitwise_count(fps), kind="stable")
    x, label = fps[order], np.arange(len(fps))
    count = np.bitwise_count(x).astype(np.int16)
    for a in range(0, len(x), TILE):
        left = x[a : a + TILE]
        for b in range(a, len(x), TILE):
            if count[b] - count[min(a + TILE, len(x)) - 1] > radius:
                break
            near = np.bitwise_count(left[:, None] ^ x[None, b : b + TILE]) <= radius
            u, v = np.nonzero(near)
            u, v = u + a, v + b
            u, v = u[u < v], v[u < v]
            while True:
                p, q = label[u], label[v]
                open_ = p != q
                if not open_.any():
                    break
                np.minimum.at(label, np.maximum(p, q)[open_], np.minimum(p, q)[open_])
                while not np.array_equal(up := label[label], label):
                    label = up
    child = np.nonzero(label != np.arange(len(x)))[0]
    return order[child], order[label[child]]


def _compared(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (key, lo, hi); a group may go over the edge of a batch."""
        held: list[np.ndarray] = []
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            rows = np.stack([c.astype(np.int64) for c in cols])
            rows = np.concatenate([*held, rows], axis=1) if held else rows
            cut = np.nonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0))[0] + 1
            yield from links(rows[:, : cut[-1]], cut[:-1]) if len(cut) else ()
            held = [rows[:, cut[-1] if len(cut) else 0 :]]
        if held:
            yield from links(held[0], np.empty(0, np.int64))

    def links(rows: np.ndarray, cut: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.concatenate(([0], cut, [rows.shape[1]]))
        out = []
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            if e - s > 1:
                fps, ids = rows[3, s:e].view(np.uint64), rows[4, s:e]
                if e - s == 2:
                    if int(fps[0] ^ fps[1]).bit_count() <= radius:
                        out.append(ids[None, :])
                    continue
                child, root = forest(np.ascontiguousarray(fps), radius)
                if len(child):
                    out.append(np.stack([ids[child], ids[root]], axis=1))
        if out:
            both = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return run


def _large(dealt: DataFrame) -> DataFrame:
    """(key, parts) of the buckets over the limit, sent to all tasks if they are few."""
    large = dealt.groupBy("key").count().where(F.col("count") > BUCKET)
    large = stored(large.select("key", F.ceil(F.col("count") / (BUCKET // 2)).cast("int").alias("parts")), "large")
    return F.broadcast(large) if large.count() <= BROADCAST else large


def paired(dealt: DataFrame, large: DataFrame, by: str) -> DataFrame:
    """The columns of dealt (with key) and lo and hi: a bucket that large lists is dealt out as all pairs of its parts."""
    own = F.pmod(F.xxhash64(by), F.col("n")).cast("int")
    split = dealt.join(large, "key", "left").withColumn("n", F.coalesce("parts", F.lit(1))).withColumn("own", own)
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return split.select(*dealt.columns, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


def links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b) over nodes: edges that connect the same nodes as all pairs within the radius. nodes: (fp, node), fp unique."""
    widths = blocks_for(nodes.count(), radius)
    dealt = nodes.select("fp", "node", F.explode(_bucket_keys(F.col("fp"), widths, radius)).alias("b")).select("fp", "node", "b.key", "b.rest")
    large = _large(dealt)
    sub = -(-radius * max(widths) // (radius + 1))
    pieces = [F.shiftrightunsigned(F.col("rest"), j * sub).bitwiseAND(F.lit((1 << sub) - 1)) for j in range(radius + 1)]
    again = F.explode(F.array(*(F.xxhash64("key", F.lit(j), x) for j, x in enumerate(pieces))))
    again = dealt.join(large, "key").select("fp", "node", again.alias("key"))
    small = dealt.join(large, "key", "left_anti").select("fp", "node", "key")
    order = ["key", "lo", "hi"]
    ready = small.withColumns({"lo": F.lit(0), "hi": F.lit(0)}).union(paired(again, _large(again), "fp")).select(*order, "fp", "node")
    return ready.repartition(*order).sortWithinPartitions(*order).mapInArrow(_compared(radius), "a long, b long")


def near_duplicates(docs: DataFrame, n_words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    fps = stored(fingerprints(docs, n_words), "fingerprints")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    joined = components(links(nodes.select("fp", F.col("fp").alias("node")), radius))
    named = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    named = stored(named, "named")
    ids = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return fps.join(named.join(ids, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def expected_bucket(n_nodes: int, radius: int = 4) -> float:
    """How many nodes a bucket holds if bits are even; for plans and tests."""
    m = len(blocks_for(n_nodes, radius))
    return n_nodes / 2 ** math.floor(64 * (m - radius) / m)
