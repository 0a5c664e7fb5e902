"""SentencePiece encoding and decoding by suffix-array matching.

A text is normalised as the model says (a space in front, spaces as the mark U+2581, nothing else changed) and cut into
chunks where no piece reaches across: before a run of spaces and around characters that no longer piece contains; a long
chunk is cut again between any two characters that are neighbours in no piece. The different chunks of a batch (those not
met lately) are laid one after the other and indexed: the suffix array of that text, in the order of the first bytes as far
as the longest piece reaches, made by doubling ranks, is searched for every piece of the vocabulary by bisection, which
gives the range of its occurrences. Those edges, start, length and rank, are sorted to their positions in a table.

Then the edges are relaxed. In a model of the BPE kind, the kind of the public model used here, the best segmentation is
not the path with the largest sum but what merging makes: again and again the two neighbouring symbols whose union is
the best-ranked piece, leftmost first, become one. So an edge is relaxed when its two halves are symbols: one merge a
round in every chunk at once, chunks without an edge left dropping out. Long chunks do the same with a heap. Characters
that no piece covers become their bytes. Ids are those of the sentencepiece library.

Models of another kind, with a normaliser, or that remove spaces are refused: their ids would be wrong.

Nulls: a null text has no ids and decodes to the empty text. The mark U+2581 in a text reads back as a space, as in the
library. Rows that repeat a doc_id each get their row. Very long texts are matched in parts of INDEXED bytes; a single
chunk of unlimited length with no cut in it (one letter, repeated) is one part. An empty table gives an empty result;
further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, slices

MARK = "▁"
#: Bytes by which suffixes are sorted first; each doubling sorts them by twice as many.
KEY = 8
#: Bytes of new chunks that are indexed at once.
INDEXED = 1 << 19
#: Chunks whose ids a task remembers, and the bytes from which a chunk is merged with a heap.
REMEMBERED = 100_000
#: Parts the chunks of a text for the column functions; texts that hold it are cut one by one.
APART = "\x1f"
LONG = 96
_NONE = np.int32(1 << 30)


def _fields(data: bytes) -> dict[int, object]:
    """The fields of a message in the protobuf encoding: numbers and bytes, the last of each (maps of no interest here)."""
    out, at = {}, 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            out[tag >> 3] = number()
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            out[tag >> 3] = data[at : at + size]
            at += size
    return out


def check_model(data: bytes) -> None:
    """Raises unless the model is of the BPE kind, leaves characters as they are and puts a space in front.

    Numbers of fields and of the kind are fixed values of the format."""
    trainer, normal = (_fields(_fields(data).get(k, b"")) for k in (2, 3))
    if trainer.get(3, 1) != 2:
        raise ValueError("not a model of the BPE kind")
    if normal.get(2) or normal.get(4, 1) or not normal.get(3, 1) or not normal.get(5, 1):
        raise ValueError("the model has a normaliser that changes the text")


class Vocabulary:
    def __init__(self, path: str) -> None:
        import sentencepiece

        with open(path, "rb") as f:
            check_model(f.read())
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(k) for k in range(n)]
        self.unknown = model.unk_id()
        self.of_byte = np.full(256, self.unknown, np.int64)
        normal = []
        for k, p in enumerate(pieces):
            if model.is_byte(k):
                self.of_byte[int(p[3:5], 16)] = k
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                normal.append(k)
        normal.sort(key=lambda k: (-model.get_score(k), k))
        self.id_of_rank = np.array(normal, np.int64)
        self.bytes_of_rank = [pieces[k].replace(MARK, " ").encode() for k in normal]
        self.longest = max(map(len, self.bytes_of_rank))
        self.spelled = [b""] * n
        for k in normal:
            self.spelled[k] = pieces[k].replace(MARK, " ").encode()
        for b, k in enumerate(self.of_byte.tolist()):
            if k != self.unknown:
                self.spelled[k] = bytes([b])
        self.spelled[self.unknown] = " ⁇ ".encode()
        many = [pieces[k].replace(MARK, " ") for k in normal if len(pieces[k]) > 1]
        if any(" " in p.lstrip(" ") for p in many):
            raise ValueError("a piece goes on after a space within: chunks cannot end before spaces")
        alone = "".join(sorted({"\n", "\t", "\r"} - set("".join(many))))
        alone = "".join(f"\\x{ord(c):02x}" for c in alone)
        self.chunks = re.compile(f" *[^ {alone}]+| +|[{alone}]" if alone else " *[^ ]+| +")
        self.pairs = frozenset(p[k : k + 2] for p in many for k in range(len(p) - 1))
        self.length = np.array([len(p) for p in self.bytes_of_rank])
        self.width = KEY
        while self.width < self.longest:
            self.width *= 2
        padded = np.zeros((len(normal), self.width), np.uint8)
        for k, p in enumerate(self.bytes_of_rank):
            padded[k, : len(p)] = np.frombuffer(p, np.uint8)
        # a piece as the least and the largest text that begins with it
        self.low = padded.view(f"S{self.width}").ravel()
        after = np.arange(self.width)[None, :] >= self.length[:, None]
        self.high = np.where(after, np.uint8(255), padded).view(f"S{self.width}").ravel()

    def cut(self, chunk: str) -> list[str]:
        """A long chunk in parts that no piece reaches across."""
        out, begun, pairs = [], 0, self.pairs
        for k in range(1, len(chunk)):
            if chunk[k - 1 : k + 1] not in pairs:
                out.append(chunk[begun:k])
                begun = k
        return [*out, chunk[begun:]]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def suffix_array(text: np.ndarray, width: int) -> np.ndarray:
    """The suffixes of a text (bytes above zero) in the order of their first width bytes, a power of two times KEY; equal
    ones in the order of their places."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(KEY, np.uint8)))
    key = np.zeros(n, np.uint64)
    for k in range(KEY):
        key = (key << np.uint64(8)) | padded[k : n + k]
    order, sorted_by = np.argsort(key, kind="stable"), KEY
    ranked = key[order]
    while True:
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.append(False, ranked[1:] != ranked[:-1])[:n]) + 1
        if sorted_by >= width or rank.max(initial=0) == n:
            return order
        key = rank << np.uint64(32)
        more = max(0, n - sorted_by)
        key[:more] |= rank[sorted_by : sorted_by + more]
        order = np.argsort(key, kind="stable")
        ranked, sorted_by = key[order], 2 * sorted_by


def edges(text: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Table of ranks by position and length: which pieces occur in the text (bytes), and where."""
    n = len(text)
    suffixes = suffix_array(text, v.width)
    padded = np.concatenate((text, np.zeros(v.width, np.uint8)))
    ordered = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, v.width)[suffixes]).view(f"S{v.width}").ravel()
    low, high = np.searchsorted(ordered, v.low, "left"), np.searchsorted(ordered, v.high, "right")
    count = high - low
    found = np.nonzero(count)[0]
    count = count[found]
    rank = np.repeat(found, count)
    at = suffixes[np.arange(count.sum()) + np.repeat(low[found] - (np.cumsum(count) - count), count)]
    table = np.full((n, v.longest + 1), _NONE, np.int32)
    fits = at + v.length[rank] <= n
    table[at[fits], v.length[rank[fits]]] = rank[fits]
    return table


def _one(start: np.ndarray, table: np.ndarray, stop: int) -> list[tuple[int, int]]:
    """Merged symbols (start, end) of one chunk with a heap; start: where its characters start."""
    n, longest = len(start), table.shape[1] - 1
    at, end = start.tolist(), [*start[1:].tolist(), stop]
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (size := end[j] - at[i]) <= longest and (r := int(table[at[i], size])) < _NONE:
            heapq.heappush(heap, (r, at[i], i, j, end[j]))

    heap: list = []
    for i in range(n - 1):
        offer(i)
    while heap:
        _, _, i, j, e = heapq.heappop(heap)
        if not (alive[i] and j < n and alive[j] and after[i] == j and end[j] == e):
            continue
        end[i], alive[j] = e, False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [(at[i], end[i]) for i in range(n) if alive[i]]


def segment(chunks: list[bytes], v: Vocabulary) -> list[bytes]:
    """For each chunk its ids as little-endian unsigned 32-bit integers."""
    text = np.frombuffer(b"".join(chunks), np.uint8)
    stops = np.cumsum([len(c) for c in chunks])
    table = edges(text, v)
    start = np.nonzero((text & 0xC0) != 0x80)[0]
    end = np.append(start[1:], len(text))
    owner = np.searchsorted(stops, start, "right")
    done_s, done_e = [], []
    size = np.diff(stops, prepend=0)
    long_ = np.nonzero(size > LONG)[0]
    first, last = np.searchsorted(start, stops - size), np.searchsorted(start, stops)
    for c in long_.tolist():
        merged = _one(start[first[c] : last[c]], table, int(stops[c]))
        done_s.append(np.array([a for a, _ in merged]))
        done_e.append(np.array([b for _, b in merged]))
    if len(long_):
        short = size[owner] <= LONG
        start, end, owner = start[short], end[short], owner[short]
    while len(start):
        rank = np.full(len(start), _NONE, np.int64)
        span = end[1:] - start[:-1]
        near = (owner[1:] == owner[:-1]) & (span < table.shape[1])
        where = np.nonzero(near)[0]
        rank[where] = table[start[where], span[where]]
        first = np.nonzero(np.append(True, owner[1:] != owner[:-1]))[0]
        best = np.minimum.reduceat(rank * len(start) + np.arange(len(start)), first)
        open_ = best < int(_NONE) * len(start)
        if not open_.all():  # chunks with no edge left
            ended = np.repeat(~open_, np.diff(np.append(first, len(start))))
            done_s.append(start[ended])
            done_e.append(end[ended])
            keep = ~ended
        else:
            keep = np.ones(len(start), bool)
        left = best[open_] % len(start)
        end[left] = end[left + 1]
        keep[left + 1] = False
        start, end, owner = start[keep], end[keep], owner[keep]
    start, end = np.concatenate(done_s), np.concatenate(done_e)
    order = np.argsort(start)
    start, end = start[order], end[order]
    fit = np.minimum(end - start, v.longest)
    rank = np.where(end - start == fit, table[start, fit], _NONE)
    known = rank < _NONE
    ids = np.full(len(start), v.unknown, np.int64)
    ids[known] = v.id_of_rank[rank[known]]
    times = np.where(known, 1, end - start)  # unknown characters are spelled in bytes
    spelled = np.repeat(ids, times)
    lost = np.repeat(~known, times)
    from_byte = np.repeat(start, times) + np.arange(len(spelled)) - np.repeat(np.cumsum(times) - times, times)
    spelled[lost] = v.of_byte[text[from_byte[lost]]]
    cuts = np.concatenate(([0], np.cumsum(np.bincount(np.searchsorted(stops, start, "right"), weights=times, minlength=len(chunks)).astype(np.int64)))) * 4
    raw = spelled.astype("<u4").tobytes()
    return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


class Encoder:
    """Ids of texts. Column functions cut a batch's texts into chunks and number them; each different chunk is looked up once,
    and numpy gathers the ids of all places. Only chunks not seen lately are matched."""

    kind = np.dtype("<u4")

    def __init__(self, path: str) -> None:
        self.v = vocabulary(path)
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}  # what was known before, for chunks that come again

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), one text behind the other, and how many each has."""
        texts = pc.fill_null(texts, "")
        spaced = pc.binary_join_element_wise(pc.if_else(pc.equal(texts, ""), "", " "), pc.replace_substring(texts, MARK, " "), "")
        odd = pc.match_substring(texts, APART).to_numpy(zero_copy_only=False)  # holds what parts the chunks below
        plain = pc.if_else(pa.array(odd), "", spaced) if odd.any() else spaced
        lists = pc.split_pattern(pc.replace_substring_regex(plain, self.v.chunks.pattern, rf"\0{APART}"), APART)
        flat, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        kept = np.concatenate(([0], np.cumsum(full)))
        coded = flat.filter(pa.array(full)).dictionary_encode()
        out, ends = gathered(self._look_up(coded.dictionary.to_pylist()), coded.indices.to_numpy(zero_copy_only=False), self.kind)
        ends = ends[kept[at - at[0]]]
        counts = np.diff(ends)
        if odd.any():
            whole = [(k, b"".join(self._look_up(self.v.chunks.findall(spaced[k].as_py())))) for k in np.nonzero(odd)[0].tolist()]
            counts[odd] = [len(x) // 4 for _, x in whole]
            out = np.insert(out, np.repeat([ends[k] for k, _ in whole], counts[odd]), np.concatenate([np.frombuffer(x, self.kind) for _, x in whole]))
        return out, counts

    def __call__(self, texts: Sequence[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        flat, counts = self.ids(pa.array(texts, pa.string()))
        at = np.concatenate(([0], np.cumsum(counts)))
        return [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]

    def _look_up(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks. Long ones are cut where that changes nothing."""
        if len(self._known) > REMEMBERED:
            self._known, self._older = {}, self._known
        known, older = self._known, self._older
        new, long = [], {}
        for c in [c for c in chunks if c not in known]:
            if (before := older.get(c)) is not None:
                known[c] = before
            elif len(c) < LONG // 4:
                new.append(c)
            else:
                long[c] = self.v.cut(c)
        if long:
            new = list({p for parts in long.values() for p in parts if p not in known}.union(new))
        held, size = [], 0
        for k, chunk in enumerate(new):
            held.append(chunk)
            size += len(chunk)
            if size >= INDEXED or k == len(new) - 1:
                known.update(zip(held, segment([c.encode() for c in held], self.v), strict=True))
                held, size = [], 0
        for c, parts in long.items():
            known[c] = b"".join(map(known.__getitem__, parts))
        return list(map(known.__getitem__, chunks))


@cache
def encoder_of(path: str) -> Encoder:
    """One for each worker process, so that its tasks share what is known."""
    return Encoder(path)


def decode(ids: list[int], v: Vocabulary) -> bytes:
    """The UTF-8 bytes of the text; bytes that are no UTF-8 are kept (str decoding replaces them)."""
    return b"".join(map(v.spelled.__getitem__, ids)).removeprefix(b" ")


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, n_bytes, decoded_sha256, exact): the ids' count and checksum (as little-endian
    unsigned 32-bit integers), and what they decode to: its length and digest, and whether it is the text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                texts = batch.column("text").to_pylist()
                flat, counts = encoder.ids(batch.column("text"))
                at = np.concatenate(([0], np.cumsum(counts)))
                ids = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                back = [decode(x.tolist(), encoder.v) for x in ids]
                cols = [
                    batch.column("doc_id"),
                    pa.array(counts),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array([len(b) for b in back], pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
                    pa.array([b == (t or "").encode() for b, t in zip(back, texts, strict=True)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_pieces", "ids_crc32", "n_bytes", "decoded_sha256", "exact"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, n_bytes long, decoded_sha256 string, exact boolean")


def encode_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) with the ids as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                flat, counts = encoder.ids(batch.column("text"))
                at = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(at), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, ids array<int>")
