"""Near-copies by word shingles with SimHash tiles and an exact test of the Jaccard similarity, for the pipeline.

op2 links fingerprints within a small radius, which bit blocks can find. Similarity 0.8 of shingle sets is far beyond such
a radius (about 10 of 64 bits), so here other buckets bring texts together: two sets with similarity >= 4/5 share a
shingle among the first n - ceil(4n/5) + 1 of each, in any order that is the same for all sets. Common shingles are put
last in that order, so that a common line does not bring texts together. Texts that only chance has given a shingle leave
at once, by 64 bits that travel with it. In a bucket, the texts of one such shingle, numpy
XORs and counts the bits of tiles of SimHash fingerprints (128 bits) and of parity sketches, and skips tile pairs whose
sizes or population counts can't belong to similar sets. What is left are candidates: the spanning forests of the buckets
make components of them, and inside these the sets themselves decide at >= 4/5.

The bounds: similar sets differ in at most (n + m) / 9 elements, and so in no more parity bits and no more in their
counts. From LONG shingles on the fingerprints must be within RADIUS of 128 bits, about six standard deviations over what
similarity 0.8 leads to expect: a pair is missed by chance in one of some 10**8 cases.

A large component is decided in three steps that end when it is one: inside its parts; between representatives of what
has been joined; and between what is still apart. For the last the sketches are compared again, between texts that have not
been joined alone, and what they connect is dealt out as pairs of parts: no task holds more than two parts, whatever the size
of a component; where thousands of texts could be similar by all bounds, and are not, each meets each (in rows n * n / PART),
which an exact test needs. Sets are of 64-bit hashes; texts of equal words are one node from the start, so copies cost their
signature alone.

Nulls: a null text has no words and is like the empty text. Repeated rows are copies; of ties the smallest id is the first.
Very long texts are cut to slices of a batch, one text at least. An empty table gives an empty result; further columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import star_components as components
from .common import mix64, slices, small, stored, words_of
from .simhash import TILE, paired
from .substrings import word_hashes

WORDS = 5
#: Rows that are folded or counted at once.
FLUSH = 1 << 20
#: Common shingles known to each task. Only the cost depends on which they are, not the result.
COMMON = 100_000
#: Texts, and bytes of text, of a component that meet in one task; larger components are cut into parts.
PART, PART_BYTES = 1024, 8 << 20
#: Nodes of a bucket that one task compares; larger buckets are dealt out as pairs of parts.
BUCKET = 8192
#: Large buckets that are sent to all tasks; more of them are joined by a shuffle.
BROADCAST = 200_000
#: Bits of 128, and of the first 64, in which fingerprints of similar sets may differ, and the size from which this is asked.
RADIUS, FIRST_RADIUS, LONG = 44, 27, 100
#: Texts of a shingle that are compared where they are counted; larger groups go on as they are.
FEW = 64
_SHIFT = 1000


def shingle_sets(texts: pa.Array, n_words: int = WORDS) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """All sets' hashes, sorted in each set; where each set starts, and the end; and the texts' signatures.

    A shorter text is one shingle, a text without words the empty set."""
    words, at = words_of(pc.ascii_lower(pc.fill_null(texts, "")))
    h, n = word_hashes(words), np.diff(at)
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), words), " ") if len(n) else pa.array([], pa.string())
    sig = [xxhash.xxh64_intdigest(x, 7) for x in lines.to_pylist()]
    made = np.maximum(n - n_words + 1, np.minimum(n, 1))
    own = np.repeat(np.arange(len(n)), made)
    first = np.arange(len(own)) - np.repeat(np.cumsum(made) - made, made) + np.repeat(at[:-1], made)
    rolled = np.zeros(len(own), np.uint64)
    for k in range(n_words):
        has = np.minimum(first + k, len(h) - 1) if len(h) else first
        step = mix64(rolled * np.uint64(31) + h[has] + np.uint64(k)) if len(h) else rolled
        rolled = np.where(k < n[own], step, rolled)
    order = np.lexsort((rolled, own))
    rolled, own = rolled[order], own[order]
    new = np.ones(len(own), bool)
    new[1:] = (rolled[1:] != rolled[:-1]) | (own[1:] != own[:-1])
    rolled, own = rolled[new], own[new]
    return rolled, np.searchsorted(own, np.arange(len(n) + 1)), sig


def sketches(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set 128 bits of SimHash and 128 parity bits, as two columns of words."""
    n = len(at) - 1
    ones, odd = np.zeros((n, 128), np.int64), np.zeros((n, 2), np.uint64)
    own = np.repeat(np.arange(n), np.diff(at))
    for s in range(0, len(h), 1 << 16):
        part, to = h[s : s + (1 << 16)], own[s : s + (1 << 16)]
        run = np.nonzero(np.append(True, to[1:] != to[:-1]))[0]
        place = part >> np.uint64(57)
        single = np.uint64(1) << (place & np.uint64(63))
        for k in range(2):
            odd[to[run], k] ^= np.bitwise_xor.reduceat(np.where(place >> np.uint64(6) == k, single, np.uint64(0)), run)
        # bits are counted eight at once, as bytes of a word: so at most 255 rows in a sum
        inside = np.arange(len(to)) - np.repeat(run, np.diff(np.append(run, len(to))))
        cut = np.nonzero(inside % 255 == 0)[0]
        wide = np.stack([part, mix64(part ^ np.uint64(0x51ED270B35A4C8E1))], axis=1)
        bits = np.unpackbits(wide.view(np.uint8).reshape(-1, 16), axis=1).view(np.uint64)
        counts = np.add.reduceat(bits, cut, axis=0).view(np.uint8).astype(np.int32)
        ones[to[run]] += np.add.reduceat(counts, np.searchsorted(cut, run), axis=0)
    sim = np.packbits(2 * ones > np.diff(at)[:, None], axis=1).view(np.uint64).reshape(-1, 2)
    return sim, odd


def _per_slice(docs: DataFrame, make, schema: str, *columns: str) -> DataFrame:
    """make(batch) over slices of the columns of docs, with the batches of a task held apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield from make(batch)

    return docs.select(*columns).mapInArrow(run, schema)


def described(docs: DataFrame, n_words: int) -> DataFrame:
    """(doc_id, sig, n, s0, s1, p0, p1) for every row of docs (doc_id, text)."""
    names = ["doc_id", "sig", "n", "s0", "s1", "p0", "p1"]

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        h, at, sig = shingle_sets(batch.column("text"), n_words)
        sim, odd = (x.view(np.int64) for x in sketches(h, at))
        own = pa.array(np.array(sig, np.uint64).view(np.int64))
        cols = [batch.column("doc_id"), own, pa.array(np.diff(at).astype(np.int32)), *(pa.array(np.ascontiguousarray(x[:, k])) for x in (sim, odd) for k in range(2))]
        yield pa.RecordBatch.from_arrays(cols, names=names)

    return _per_slice(docs, make, "doc_id long, sig long, n int, s0 long, s1 long, p0 long, p1 long", "doc_id", "text")


def _common(docs: DataFrame, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of shingles that many texts have."""

    def often(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h[n > 3].view(np.int64)), pa.array(n[n > 3])], names=["h", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for batch in slices(whole, "text"):
                held.append(shingle_sets(batch.column("text"), n_words)[0])
                size += len(held[-1])
                if size >= FLUSH:
                    yield often(held)
                    held, size = [], 0
        if held:
            yield often(held)

    found = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 16")
    rows = found.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = rows.column("h").to_numpy().astype(np.int64).view(np.uint64), rows.column("n").to_numpy().astype(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _first(docs: DataFrame, n_words: int) -> DataFrame:
    """(h, n, sig, s): the first shingles of each text, rare ones before common ones; equal rows of a batch once. s: 64 bits
    of SimHash from LONG shingles on, of parity below."""
    common, counts = _common(docs, n_words)

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        h, at, sig = shingle_sets(batch.column("text"), n_words)
        size = np.diff(at)
        sig = np.array(sig, np.uint64)
        once = np.zeros(len(size), bool)
        once[np.unique(sig, return_index=True)[1]] = True
        own = np.repeat(np.arange(len(size)), size)
        rank = np.zeros(len(h), np.int64)
        if len(common):
            place = np.minimum(np.searchsorted(common, h), len(common) - 1)
            rank = np.where(common[place] == h, counts[place], 0)
        order = np.lexsort((h, rank, own))
        want = size - (4 * size + 4) // 5 + 1
        taken = (np.arange(len(h)) - np.repeat(at[:-1], size) < np.repeat(want, size)) & once[own]
        sim, odd = sketches(h, at)
        bits = np.where(size >= LONG, sim[:, 0], odd[:, 0] ^ odd[:, 1]).view(np.int64)
        h, own = h[order][taken].view(np.int64), own[taken]
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(size[own].astype(np.int32)), pa.array(sig[own].view(np.int64)), pa.array(bits[own])], names=["h", "n", "sig", "s"])

    return _per_slice(docs, make, "h long, n int, sig long, s long", "text")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, n, sig) in; (g, sig) out for the members of each chain of rows of one h in which every size
    allows the similarity with the one before, if they may be similar to another member. g is made of the members, so that
    the same bucket is found again under another shingle; a chain that is longer than a batch goes by its h."""
    held, begun = np.empty((4, 0), np.int64), False  # begun: rows of the chain in held have gone out by its h
    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])
        rows = np.concatenate([held, rows], axis=1)
        new = np.ones(rows.shape[1], bool)
        new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
        rows = rows[:, new]
        h, n = rows[:2]
        start = np.nonzero(np.append(True, (h[1:] != h[:-1]) | (5 * n[:-1] < 4 * n[1:])))[0][: rows.shape[1]]
        if len(start) < 2:
            if rows.shape[1] > FLUSH:  # one chain, too long to wait for its end
                yield _bucketed(rows[:, :-1], np.zeros(1, np.int64), by_h=True)
                rows, begun = rows[:, -1:], True
            held = rows
            continue
        if begun:
            yield _bucketed(rows[:, : start[1]], np.zeros(1, np.int64), by_h=True)
            rows, start, begun = rows[:, start[1] :], start[1:] - start[1], False
        if len(start) > 1:
            yield _bucketed(rows[:, : start[-1]], start[:-1])
        held = rows[:, start[-1] :]
    if held.shape[1]:
        yield _bucketed(held, np.zeros(1, np.int64), by_h=begun)


def _bucketed(rows: np.ndarray, start: np.ndarray, *, by_h: bool = False) -> pa.RecordBatch:
    h, sig = np.ascontiguousarray(rows[0]), np.ascontiguousarray(rows[2])
    if by_h:
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(sig)], names=["g", "sig"])
    count = np.diff(np.append(start, len(sig)))
    chain, size = np.repeat(np.arange(len(start)), count), np.repeat(count, count)
    n, s = rows[1], rows[3].view(np.uint64)
    near = size > FEW
    some = np.nonzero((size > 1) & ~near)[0]  # pairs of a chain, by their distance in it
    for lag in range(1, FEW):
        some = some[some + lag < len(sig)]
        some = some[chain[some + lag] == chain[some]]
        if not len(some):
            break
        a, b = some, some + lag
        apart = np.bitwise_count(s[a] ^ s[b]).astype(np.int64)
        both = np.where(n[a] >= LONG, apart <= FIRST_RADIUS, (n[b] >= LONG) | (9 * apart <= n[a] + n[b])) & (5 * n[a] >= 4 * n[b])
        near[a[both]] = near[b[both]] = True
    g = np.zeros(len(start), np.uint64)
    np.add.at(g, chain[near], mix64(sig[near].view(np.uint64)))
    return pa.RecordBatch.from_arrays([pa.array(mix64(g)[chain[near]].view(np.int64)), pa.array(sig[near])], names=["g", "sig"])


def tile_forest(n: np.ndarray, sim: np.ndarray, odd: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (child, root) that connect the same sets as all pairs within the bounds do (those of different labels, if own
    has them). n: sizes."""
    order = np.argsort(n, kind="stable")
    n, sim, odd = n[order], sim[order], odd[order]
    own = None if own is None else own[order]
    bits = np.bitwise_count(sim).sum(axis=1, dtype=np.int64)
    label = np.arange(len(n))
    for a in range(0, len(n), TILE):
        left = slice(a, min(a + TILE, len(n)))
        for b in range(a, len(n), TILE):
            right = slice(b, min(b + TILE, len(n)))
            if 5 * n[left.stop - 1] < 4 * n[b]:
                break
            if n[a] >= LONG and max(bits[right].min() - bits[left].max(), bits[left].min() - bits[right].max()) > RADIUS:
                continue
            total = n[left, None] + n[None, right]
            near = 9 * np.bitwise_count(odd[left, None] ^ odd[None, right]).sum(axis=2, dtype=np.int64) <= total
            near &= 5 * n[left, None] >= 4 * n[None, right]
            apart = np.bitwise_count(sim[left, None] ^ sim[None, right]).sum(axis=2, dtype=np.int64)
            near &= (apart <= RADIUS) | (n[left, None] < LONG)
            if own is not None:
                near &= own[left, None] != own[None, right]
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
    child = np.nonzero(label != np.arange(len(n)))[0]
    return order[child], order[label[child]]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by the first three columns, group by group; a group may go over the edge of a batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
        edge = [0, *(np.nonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))[0] + 1).tolist(), batch.num_rows]
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            key = tuple(keys[:, s].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate links of buckets, as forests."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for rows in _groups(batches):
        if rows.num_rows < 2:
            continue
        cols = [rows.column(k).to_numpy() for k in ("sig", "n", "s0", "s1", "p0", "p1")]
        sim, odd = (np.stack(x, axis=1).view(np.uint64) for x in (cols[2:4], cols[4:6]))
        own = rows.column("label").to_numpy() if "label" in rows.column_names else None
        child, root = tile_forest(cols[1].astype(np.int64), sim, odd, own)
        a.append(cols[0][child])
        b.append(cols[0][root])
        if len(a) >= _SHIFT:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
            a, b = [], []
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def bucketed(docs: DataFrame, nodes: DataFrame, n_words: int) -> DataFrame:
    """(key, lo, hi, sig, n, s0, s1, p0, p1): buckets in which any two texts meet whose similarity can be 4/5. nodes: (sig, n,
    s0, s1, p0, p1)."""
    order = ["h", "n", "sig"]
    first = _first(docs, n_words).repartition("h").sortWithinPartitions(*order)
    buckets = first.mapInArrow(_shared, "g long, sig long").groupBy("sig").agg(F.collect_set("g").alias("g"))  # a text's first shingles at most
    dealt = buckets.join(nodes, "sig").select(F.explode("g").alias("key"), "sig", "n", "s0", "s1", "p0", "p1")
    dealt = stored(dealt, "buckets")
    large = dealt.groupBy("key").count().where(F.col("count") > BUCKET)
    large = stored(large.select("key", F.ceil(F.col("count") / (BUCKET // 2)).cast("int").alias("parts")), "large")
    some = large.count()
    ready = dealt.withColumns({"lo": F.lit(0), "hi": F.lit(0)}) if not some else paired(dealt, F.broadcast(large) if some <= BROADCAST else large, "sig")
    return ready.select("key", "lo", "hi", "sig", "n", "s0", "s1", "p0", "p1")


def linked(buckets: DataFrame) -> DataFrame:
    """(a, b) over signatures: connects all texts of a bucket whose similarity can be 4/5; with a column label those alone that
    differ in it."""
    keys = ["key", "lo", "hi"]
    rows = buckets.select(*keys, *(c for c in buckets.columns if c not in keys))
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compared, "a long, b long")


def joined(sets: list[np.ndarray], label: np.ndarray) -> list[tuple[int, int]]:
    """Pairs with similarity >= 4/5 of different labels that join the same sets as all such pairs do."""
    size = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size = size[order]
    label = np.unique(label, return_inverse=True)[1][order]
    odd = np.stack([np.packbits(np.bincount((sets[k] >> np.uint64(55)).astype(np.int64), minlength=512) & 1) for k in order]).view(np.uint64)
    last = np.searchsorted(4 * size, 5 * size, "right")
    out = []
    for a in range(len(order)):
        b = np.arange(a + 1, last[a])
        b = b[label[b] != label[a]]
        if not len(b):
            continue
        b = b[9 * np.bitwise_count(odd[b] ^ odd[a]).sum(axis=1, dtype=np.int64) <= size[a] + size[b]]
        for k in b.tolist():
            if label[k] == label[a]:
                continue
            x, y = sets[order[a]], sets[order[k]]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 5 * both >= 4 * (len(x) + len(y) - both):
                out.append((int(order[a]), int(order[k])))
                label[label == label[k]] = label[a]
    return out


def _decided(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            if rows.num_rows < 2:
                continue
            h, at, _ = shingle_sets(pa.concat_arrays(rows.column("text").chunks), n_words)
            pairs = joined([h[s:e] for s, e in zip(at[:-1], at[1:], strict=True)], rows.column("label").to_numpy())
            if pairs:
                sig, where = rows.column("sig").to_numpy(), np.array(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(sig[where[:, 0]]), pa.array(sig[where[:, 1]])], names=["a", "b"])

    return run


def _meet(rows: DataFrame, n_words: int) -> DataFrame:
    """(a, b) of similar texts of different labels that stand under one (component, lo, hi)."""
    keys = ["component", "lo", "hi"]
    ready = rows.select(*keys, "sig", "label", "text").repartition(*keys).sortWithinPartitions(*keys)
    return ready.mapInArrow(_decided(n_words), "a long, b long")


def _parts(rows: DataFrame, by: str = "component") -> DataFrame:
    """(by, parts) of rows (by, text)."""
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    return sizes.select(by, F.when((F.col("n") > 2 * PART) | (F.col("bytes") > 2 * PART_BYTES), F.ceil(F.greatest(F.col("n") / PART, F.least(F.col("n"), F.col("bytes") / PART_BYTES)))).otherwise(1).cast("int").alias("parts"))


def _labelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows with label: the component that the edges put sig in."""
    found = components(edges).withColumnRenamed("component", "to")
    named = rows.join(found, rows["sig"] == found["node"], "left")
    return named.select(*[c for c in rows.columns if c != "label"], F.coalesce("to", "sig").alias("label"))


def decided(members: DataFrame, n_words: int, buckets: DataFrame) -> DataFrame:
    """(a, b): similar texts among members (component, sig, text) that connect them as all similar pairs do. buckets: see
    bucketed; all similar pairs meet there."""
    spread = members.join(_parts(members).where("parts > 1"), "component", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int")
    spread = spread.withColumns({"lo": own, "hi": own, "label": F.col("sig")})
    edges = stored(_meet(spread, n_words), "similar")
    large = spread.where("parts > 1").select("component", "sig", "text")
    if not large.limit(1).count():
        return edges
    # representatives of what is joined: one for each label of a component
    large = stored(_labelled(large, edges), "large")
    heads = large.groupBy("component", "label").agg(F.min("sig").alias("sig"))
    heads = large.drop("label").join(heads, ["component", "sig"])
    heads = stored(heads, "heads")
    spread = heads.join(_parts(heads), "component").withColumns({"lo": own, "hi": own})
    edges = edges.union(stored(_meet(spread, n_words), "similar"))
    # what is still apart: the sketches are compared once more, between different labels only, and what they connect meets
    labels = stored(_labelled(large, edges), "labels")
    open_ = labels.groupBy("component").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    apart = labels.join(open_.select("component"), "component", "left_semi").select("sig", "label")
    crossing = _members(components(linked(buckets.join(apart, "sig"))))
    rest = labels.drop("component").join(crossing, "sig")
    return edges.union(stored(_meet(_in_pairs(stored(rest, "apart")), n_words), "similar"))


def _members(found: DataFrame) -> DataFrame:
    """(sig, component) of components (node, component), in which the first node of each is not listed."""
    return found.select(F.col("node").alias("sig"), "component").union(found.select(F.col("component").alias("sig"), "component").distinct())


def _in_pairs(rows: DataFrame) -> DataFrame:
    """rows (component, sig, label, text) dealt to pairs (lo, hi) of parts of their component, so that any two texts of
    different labels meet and a task holds two parts. The texts of the largest label needn't meet each other: their parts come
    after those of the others and are paired with these alone."""
    counts = rows.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("top"))
    rows = rows.join(top, "component").withColumn("side", (F.col("label") == F.col("top")).cast("int"))
    sides = rows.groupBy("component", "side").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    parts = F.ceil(F.greatest(F.lit(1), F.col("n") / PART, F.least(F.col("n"), F.col("bytes") / PART_BYTES))).cast("int")
    of = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, parts)), F.lit(0))
    sizes = sides.groupBy("component").agg(of(0).alias("others"), of(1).alias("tops"))
    rows = rows.join(sizes, "component")
    mine = F.pmod(F.xxhash64("sig"), F.greatest(F.lit(1), F.when(F.col("side") == 1, F.col("tops")).otherwise(F.col("others")))).cast("int")
    mine = mine + F.when(F.col("side") == 1, F.col("others")).otherwise(0)
    last = F.when(F.col("side") == 1, F.col("others")).otherwise(F.col("others") + F.col("tops"))
    spread = rows.withColumn("own", mine).where(last > 0).withColumn("other", F.explode(F.sequence(F.lit(0), last - 1)))
    return spread.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})


def near_copies(docs: DataFrame, n_words: int = WORDS) -> DataFrame:
    """(doc_id, first_id) for every row of docs (doc_id, text) with unique ids: the smallest id among the texts that are
    connected by similarities >= 4/5."""
    docs = docs.select("doc_id", "text")
    rows = stored(described(docs, n_words), "described")
    nodes = rows.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n", "s0", "s1", "p0", "p1")))
    nodes = stored(nodes, "nodes")
    buckets = bucketed(docs, nodes.drop("doc_id"), n_words)
    chained = _members(components(linked(buckets)))
    wanted = stored(nodes.join(chained, "sig").select("doc_id", "component", "sig"), "wanted")
    members = stored(docs.join(small(wanted, wanted.count()), "doc_id").select("component", "sig", "text"), "members")
    found = components(decided(members, n_words, buckets))
    named = nodes.join(found.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "doc_id", F.coalesce("component", "sig").alias("component"))
    named = stored(named, "named")
    first = named.groupBy("component").agg(F.min("doc_id").alias("first_id"))
    return rows.join(named.join(first, "component").select("sig", "first_id"), "sig").select("doc_id", "first_id")
