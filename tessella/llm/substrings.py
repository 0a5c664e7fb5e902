"""Substring dedup: words covered by a window of WINDOW words that also starts earlier in the corpus are removed.

Suffix automata of reference shards decide, by matching statistics. Two equal windows have the same least hash among the
ANCHOR-word sequences in them, so a document is cut into segments: runs of consecutive windows whose (first) least hash
stands at the same place, the segment's anchor. Equal windows always lie in segments with equal anchors, so a shard is made
of anchors: it has the first segment of each content of its anchors, in the order of the corpus, and segments with other
anchors needn't be read through it. Anchors that occur once (almost all in clean text) end the search. Content hashes only
keep equal segments out of a shard; whether a window is a repeat is seen in words.

The anchors that are met most often for the words they need are sent to where the texts lie: their shards, of SHARD_WORDS
words about, are built in tasks, and those of BROADCAST_WORDS words in all (and no more: about 80 bytes a word) are
broadcast. Documents are streamed through them word by word; after each the automaton's state says how long a stretch ends
here that the shard has, and where it stood first. All other shards stay where they are, and the segments come to them: an
anchor's segments are read in the order of the corpus through an automaton that grows with them. An anchor with more than
CONTEXTS different segments (the edges of a very common passage) is cut into its single windows, each under its own hash.
Sending all automata to all documents, in rounds, would read the corpus once for every shard.

Only anchor rows of fixed size are shuffled for the whole corpus. A map batch sends one row for an anchor to the place where
anchors are counted, whatever the number of its segments; the segments themselves are dealt by their content.

Nulls: a null text has no words. Order is by doc_id, nulls first; rows that repeat a doc_id are ordered by their text, and
of equal rows the first keeps its words. Texts of fewer words than a window keep all of them; very long ones are cut to
segments as any. An empty table gives an empty result; further columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keyed, mix64, slices, small, stored, words_of

WINDOW = 20
ANCHOR = 6
#: Different contexts of an anchor that one automaton takes; the segments of hotter anchors are dealt out window by window.
CONTEXTS = 512
#: Words of a shard that is broadcast, about, and of all of them at most.
SHARD_WORDS, BROADCAST_WORDS = 50_000, 400_000

#: A word with the white space before it.
_SPACED = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")

_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def word_hashes(words: pa.Array) -> np.ndarray:
    coded = words.dictionary_encode()
    digest = xxhash.xxh64_intdigest
    own = np.fromiter((digest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return own[coded.indices.to_numpy()] if len(own) else np.empty(0, np.uint64)


def segments_of(hashes: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Anchor, content hash, first word and number of windows of the segments of texts that start at these words."""
    n, spread = len(hashes), window - ANCHOR + 1
    none = (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    if n < window:
        return none
    two = mix64(hashes[:-1] * np.uint64(3) + hashes[1:])
    four = mix64(two[:-2] * np.uint64(5) + two[2:])
    least = mix64(four[: n - ANCHOR + 1] * np.uint64(7) + two[4:])
    where, span = np.arange(len(least)), 1  # the least of each window, and its first place
    while span < spread:
        step = min(span, spread - span)
        right = least[step:] < least[:-step]
        where = np.where(right, where[step:], where[:-step])
        least = np.where(right, least[step:], least[:-step])
        span += step
    inside = np.zeros(n + 1, np.int64)
    first, last = starts[:-1], np.maximum(starts[:-1], starts[1:] - window + 1)
    np.add.at(inside, first, 1)
    np.add.at(inside, last, -1)
    at = np.nonzero(np.cumsum(inside)[: len(least)])[0]
    if not len(at):
        return none
    anchor, place = least[at], where[at]
    edge = np.ones(len(at), bool)
    edge[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.nonzero(edge)[0]
    count = np.diff(np.append(begin, len(at)))
    # a polynomial of the words, shifted to start at power zero; products and sums wrap at 64 bits
    power, back = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _INVERSE, np.uint64)
    power[0] = back[0] = 1
    power, back = np.cumprod(power), np.cumprod(back)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power[:n])))
    s = at[begin]
    content = (sums[s + count + window - 1] - sums[s]) * back[s]
    return anchor[begin], mix64(content + count.astype(np.uint64)), s, count


_ROWS = "k long, kind int, h long, c long, row_key long, start int, windows int"
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
#: Kinds of rows: a segment whose anchor the batch has once; an anchor that it has more often; the segments of such an
#: anchor, the first of each content, and the others.
ONE, MANY, FIRST, AGAIN = range(4)


def _rows(columns, schema: str, kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])


def _segments(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words, starts = words_of(batch.column("text"))
                h, c, at, n = segments_of(word_hashes(words), starts, window)
                if not len(h):
                    continue
                own = np.searchsorted(starts, at, "right") - 1
                key = batch.column("row_key").to_numpy(zero_copy_only=False)[own]
                at = at - starts[own]
                order = np.lexsort((at, key, c, h))
                h, c, at, n, key = h[order], c[order], at[order], n[order], key[order]
                new_h, new_c = np.ones(len(h), bool), np.ones(len(h), bool)
                new_h[1:] = h[1:] != h[:-1]
                new_c[1:] = new_h[1:] | (c[1:] != c[:-1])
                begin = np.nonzero(new_h)[0]
                many = np.repeat(np.diff(np.append(begin, len(h))) > 1, np.diff(np.append(begin, len(h))))
                kind = np.where(~many, ONE, np.where(new_c, FIRST, AGAIN))
                spread = mix64((key * 1_000_003 + at).view(np.uint64))
                k = np.where(kind == ONE, h, np.where(kind == FIRST, mix64(h ^ mix64(c)), spread))
                signed = lambda x: x.view(np.int64)
                yield _rows([signed(k), kind, signed(h), signed(c), key, at, n], _ROWS, _KINDS)
                told = signed(h[begin][many[begin]])
                none = np.zeros(len(told), np.int64)
                yield _rows([told, none + MANY, told, none, none, none, none], _ROWS, _KINDS)

    return run


_FOUND = "h long, row_key long, start int, windows int, first boolean"
_FOUND_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (k, kind, c, row_key, start) in; the segments of anchors that occur more than once out, first for one
    that is the first of its content here. Keeps one row at the edge of a batch, however large a group."""
    held = np.empty((7, 0), np.int64)  # the last row, if its anchor has shown no other yet
    last: tuple | None = None  # k, kind and c of the last row, and whether its anchor has been seen twice
    for batch in batches:
        rows = np.stack([batch.column(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in range(7)])
        if not rows.shape[1]:
            continue
        k, kind, c = rows[0], rows[1], rows[3]
        counted = kind <= MANY
        new_k = np.ones(len(k), bool)
        new_k[1:] = (k[1:] != k[:-1]) | (counted[1:] != counted[:-1])
        new_c = np.ones(len(k), bool)
        new_c[1:] = new_k[1:] | (c[1:] != c[:-1]) | (kind[1:] != kind[:-1])
        goes_on = last is not None and k[0] == last[0] and counted[0] == (last[1] <= MANY)
        if goes_on:
            new_k[0], new_c[0] = False, (kind[0], c[0]) != last[1:3]
        group = np.cumsum(new_k)  # 0: goes on from the batch before
        size = np.bincount(group, minlength=group[-1] + 1)
        if goes_on:
            size[0] += 2 if last[3] else 1
        out = (kind >= FIRST) | ((kind == ONE) & (size[group] > 1))
        first = new_c & (kind != AGAIN)
        if held.shape[1] and goes_on:
            yield _rows([*held[[2, 4, 5, 6]], [True]], _FOUND, _FOUND_KINDS)
        if out.any():
            yield _rows([rows[2][out], rows[4][out], rows[5][out], rows[6][out], first[out]], _FOUND, _FOUND_KINDS)
        seen = bool(counted[-1] and size[group[-1]] > 1)
        held = rows[:, -1:] if kind[-1] == ONE and not seen else np.empty((7, 0), np.int64)
        last = (k[-1], kind[-1], c[-1], seen)


def _lists(column: pa.Array, *names: str) -> Iterator[list[tuple]]:
    """The lists of structs in a column as lists of tuples of these fields (null: an empty list)."""
    flat = column.flatten()
    rows = list(zip(*(flat.field(n).to_pylist() for n in names), strict=True))
    at = 0
    for size in pc.fill_null(pc.list_value_length(column), 0).to_pylist():
        yield rows[at : at + size]
        at += size


def _words(texts: pa.Array, wanted: pa.Array, window: int, *names: str) -> Iterator[tuple]:
    """The row_key, start and windows of each wanted segment, the fields named, and the words of its text that it covers."""
    for doc, segments in zip(texts.to_pylist(), _lists(wanted, "row_key", "start", "windows", *names), strict=True):
        if segments:
            words = (doc or "").encode().split()
            for own, start, windows, *more in segments:
                yield own, start, windows, *more, words[start : start + windows + window - 1]


def _reference(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(shard, row_key, start, words) of the wanted segments."""
        for batch in batches:
            rows = [(shard, own, start, b" ".join(words)) for own, start, _, shard, words in _words(batch.column("text"), batch.column("wanted"), window, "shard")]
            cols = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["shard", "row_key", "start", "words"])

    return run


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, row_key, start) in, an automaton for each shard out."""
    now, shard = None, None
    for batch in batches:
        for own, key, start, words in zip(*(batch.column(k).to_pylist() for k in ("shard", "row_key", "start", "words")), strict=True):
            if own != now:
                if shard is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([shard.written()], pa.binary())], names=["shard", "automaton"])
                now, shard = own, Shard()
            shard.add(key, start, words.split())
    if shard is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([shard.written()], pa.binary())], names=["shard", "automaton"])


_SEGMENTS = "h long, row_key long, start int, windows int, words binary"
_SEGMENT_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def _streamed(window: int, shards):
    """shards: a broadcast of written automata by number, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams the segments of broadcast shards through them, and gives their repeats as rows without words. The others
        are sent on with their words, those of hot anchors as single windows under their own hashes; of rows of a batch
        that are equal in their words the first alone carries them, the others are repeats of it."""
        ready: dict[int, Reader] = {}
        for batch in batches:
            done, sent = [], []
            for own, start, windows, h, shard, hot, words in _words(batch.column("text"), batch.column("wanted"), window, "h", "shard", "hot"):
                if shard is not None:
                    if shard not in ready:
                        ready[shard] = Reader(shards.value[shard])
                    done += [(own, start + a, n) for a, n in ready[shard].repeats(words, own, start, window)]
                elif hot:
                    sent += [(b" ".join(words[k : k + window]), None, own, start + k, 1) for k in range(windows)]
                else:
                    sent.append((b" ".join(words), h, own, start, windows))
            rows = [(_dealt(own, at), own, at, n, None) for own, at, n in done]
            before = None
            for text, h, own, at, n in sorted(sent, key=lambda x: (x[0], x[2], x[3])):
                again = text == before
                key = _dealt(own, at) if again else h if h is not None else xxhash.xxh64_intdigest(text) - (1 << 63)
                rows.append((key, own, at, n, None if again else text))
                before = text
            yield _rows(zip(*rows, strict=True) if rows else [[]] * 5, _SEGMENTS, _SEGMENT_KINDS)

    return run


def _dealt(own: int, at: int) -> int:
    return xxhash.xxh64_intdigest(f"{own} {at}".encode()) - (1 << 63)


class SuffixAutomaton:
    """Built online; feed() returns the matching statistic of the text so far against everything fed before it. first: where
    the strings of a state ended for the first time."""

    __slots__ = ("_last", "first", "length", "link", "next")

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.first, self._last = [-1], [0], [-1], 0

    def feed(self, symbol: object) -> int:
        step, link, length = self.next, self.link, self.length
        p, new = self._last, len(step)
        step.append({})
        length.append(length[p] + 1)
        link.append(0)
        self.first.append(length[p])
        while p >= 0 and symbol not in step[p]:
            step[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = step[p][symbol]
            if length[q] != length[p] + 1:
                twin = len(step)
                step.append(step[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                self.first.append(self.first[q])
                while p >= 0 and step[p].get(symbol) == q:
                    step[p][symbol] = twin
                    p = link[p]
                link[q] = twin
                q = twin
            link[new] = q
        self._last = new
        return length[link[new]]


class Shard:
    """An automaton over the segments of a shard, each followed by a symbol of its own, and where they stand."""

    def __init__(self) -> None:
        self._automaton, self._number = SuffixAutomaton(), {}
        self._begin, self._key, self._start, self._fed = [], [], [], 0

    def add(self, key: int, start: int, words: list[bytes]) -> None:
        self._begin.append(self._fed)
        self._key.append(key)
        self._start.append(start)
        number = self._number
        for w in words:
            self._automaton.feed(number.setdefault(w, len(number)))
        self._automaton.feed(-1 - len(self._begin))
        self._fed += len(words) + 1

    def written(self) -> bytes:
        """Arrays alone: steps as sorted numbers of (state, word), which a reader bisects."""
        a, n = self._automaton, max(1, len(self._number))
        pairs = sorted((state * n + w, to) for state, steps in enumerate(a.next) for w, to in steps.items() if w >= 0)
        arrays = [array("q", (k for k, _ in pairs)), array("i", (t for _, t in pairs)), array("i", a.link), array("i", a.length), array("i", a.first), array("q", self._begin), array("q", self._key), array("i", self._start)]
        words = b" ".join(self._number)
        return b"".join(struct.pack("<q", len(x.tobytes())) + x.tobytes() for x in arrays) + words


class Reader:
    """Streams words through a written shard."""

    def __init__(self, written: bytes) -> None:
        out, at = [], 0
        for kind in "qiiiiqqi":
            size = struct.unpack_from("<q", written, at)[0]
            out.append(array(kind, bytes(written[at + 8 : at + 8 + size])))
            at += 8 + size
        self._steps, self._to, self._link, self._length, self._first, self._begin, self._key, self._start = out
        words = bytes(written[at:]).split()
        self._number, self._n = {w: k for k, w in enumerate(words)}, max(1, len(words))

    def repeats(self, words: list[bytes], key: int, start: int, window: int) -> list[tuple[int, int]]:
        """(first window, number of windows) of the runs of windows that the shard has at an earlier place than (key, start
        and their own place)."""
        steps, to, link, length, n = self._steps, self._to, self._link, self._length, self._n
        state = matched = 0
        out, begun, most = [], None, len(steps)
        for k, word in enumerate(words):
            number = self._number.get(word)
            if number is None:
                state = matched = 0
            else:
                while True:
                    at = bisect_left(steps, state * n + number)
                    if at < most and steps[at] == state * n + number:
                        state, matched = to[at], matched + 1
                        break
                    if not state:
                        matched = 0
                        break
                    state = link[state]
                    matched = length[state]
            repeated = False
            if matched >= window:
                while length[link[state]] >= window:
                    state = link[state]
                    matched = length[state]
                end = self._first[state]
                own = bisect_right(self._begin, end) - 1
                there = self._start[own] + end - self._begin[own] - window + 1
                repeated = (self._key[own], there) < (key, start + k - window + 1)
            if repeated and begun is None:
                begun = k
            elif not repeated and begun is not None:
                out.append((begun - window + 1, k - begun))
                begun = None
        if begun is not None:
            out.append((begun - window + 1, len(words) - begun))
        return out


def _statistics(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (h, row_key, start): each anchor's segments in the order of the corpus."""
        anchor, shard, one = None, SuffixAutomaton(), None
        for batch in batches:
            key, start, n = [], [], []
            for h, own, at, windows, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h != anchor:
                    anchor, shard, one = h, SuffixAutomaton(), None
                if words is None or words == one:  # settled, or nothing new
                    key.append(own)
                    start.append(at)
                    n.append(windows)
                    continue
                one = words
                shard.feed((own, at))  # a symbol of its own keeps matches inside segments
                begun = None
                feed = shard.feed
                words = words.split()
                for k, w in enumerate(words):
                    if feed(w) >= window:
                        begun = k if begun is None else begun
                    elif begun is not None:
                        key.append(own)
                        start.append(at + begun - window + 1)
                        n.append(k - begun)
                        begun = None
                if begun is not None:
                    key.append(own)
                    start.append(at + begun - window + 1)
                    n.append(len(words) - begun)
            cols = [pa.array(key, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["row_key", "start", "windows"])

    return run


def _cover(window: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 16 << 20):
                total, gone, kept = [], [], []
                for text, spans in zip(batch.column("text").to_pylist(), _lists(batch.column("spans"), "start", "windows"), strict=True):
                    words = (text or "").encode().split()
                    lost = np.zeros(len(words) + 1, np.int32)
                    if spans:
                        first, n = np.array(spans).T
                        np.add.at(lost, first, 1)
                        np.add.at(lost, first + n + window - 1, -1)
                    left = np.cumsum(lost)[:-1] == 0
                    n_left = int(left.sum())
                    total.append(len(words))
                    gone.append(len(words) - n_left)
                    if n_left == len(words) and not digest:
                        kept.append(text)
                        continue
                    if digest:
                        joined = b" ".join(words if n_left == len(words) else [w for w, k in zip(words, left.tolist(), strict=True) if k])
                        kept.append(hashlib.sha256(joined).hexdigest())
                        continue
                    spaced = _SPACED.findall(text.encode())
                    kept.append(b"".join([w for w, k in zip(spaced, left.tolist(), strict=True) if k]).lstrip().decode())
                own = [n for n in batch.schema.names if n not in ("text", "spans")]
                cols = [*(batch.column(n) for n in own), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[*own, "n_words", "n_removed", "kept"])

    return run


def _sent(docs: DataFrame, found: DataFrame, window: int):
    """(h, shard, hot) of the anchors that are not dealt with the usual way, and the broadcast of the shards (None if there
    are none): the anchors with the most segments for each content, as long as their contents have few words enough."""
    size = F.sum(F.when(F.col("first"), F.col("windows") + window - 1).otherwise(0))
    per = found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.count_if("first").alias("contents"), size.alias("words"))
    hot = F.col("contents") > CONTEXTS
    level = F.when(~hot, F.floor(F.log2(F.col("n") / F.greatest(F.col("contents"), F.lit(1))) * 4)).cast("int")
    per = stored(per.where(hot | (F.col("n") > 2 * F.col("contents"))).select("h", "words", hot.alias("hot"), level.alias("level")), "anchors")
    room, least = BROADCAST_WORDS, None
    for r in per.where("not hot").groupBy("level").agg(F.sum("words").alias("words")).orderBy(F.desc("level")).collect():  # some 200 levels at most
        if r.words > room:
            break
        room, least = room - r.words, r.level
    n_shards = max(1, -(-(BROADCAST_WORDS - room) // SHARD_WORDS))
    shard = F.when(~F.col("hot") & (F.col("level") >= F.lit(least)), F.pmod(F.xxhash64("h"), F.lit(n_shards))).cast("int")
    anchors = stored(per.select("h", shard.alias("shard"), "hot").where("hot or shard is not null"), "sent")
    anchors = small(anchors, anchors.count())
    if least is None:
        return anchors, None
    first = found.where("first").join(anchors.where("shard is not null"), "h").groupBy("row_key").agg(F.collect_list(F.struct("shard", "row_key", "start", "windows")).alias("wanted"))
    texts = docs.select("row_key", "text").join(F.broadcast(first), "row_key")  # BROADCAST_WORDS / window rows at most
    rows = texts.mapInArrow(_reference(window), "shard int, row_key long, start int, words binary")
    built = stored(rows.repartition("shard").sortWithinPartitions("shard", "row_key", "start").mapInArrow(_built, "shard int, automaton binary"), "automata")
    return anchors, docs.sparkSession.sparkContext.broadcast({r.shard: bytes(r.automaton) for r in built.collect()})  # of a bounded number of words


def remove_repeats(docs: DataFrame, window: int = WINDOW, *, digest: bool = False) -> DataFrame:
    """(row_key, doc_id, n_words, n_removed, kept) and what docs has besides, for every row of docs (of common.keyed()):
    kept is the SHA-256 in hex of the words that stay, joined by one space; or else the text that stays, with the white
    space before each word as it was."""
    found = docs.select("row_key", "text").mapInArrow(_segments(window), _ROWS)
    found = stored(found.repartition("k").sortWithinPartitions("k", "kind", "c", "row_key", "start").mapInArrow(_shared, _FOUND), "segments")
    anchors, shards = _sent(docs, found, window)

    texts = docs.repartition("row_key")  # dealt once: both joins select the same columns, so Spark reuses the exchange
    told = F.struct("h", "row_key", "start", "windows", "shard", F.coalesce("hot", F.lit(False)).alias("hot"))
    wanted = found.join(anchors, "h", "left").groupBy("row_key").agg(F.collect_list(told).alias("wanted"))
    read = texts.join(wanted, "row_key", "left").select(*docs.columns, "wanted")
    read = read.mapInArrow(_streamed(window, shards), _SEGMENTS)
    spans = read.repartition("h").sortWithinPartitions("h", "row_key", "start").mapInArrow(_statistics(window), "row_key long, start int, windows int")
    spans = spans.groupBy("row_key").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    covered = texts.join(spans, "row_key", "left").select(*docs.columns, "spans")
    schema = T.StructType([f for f in docs.schema if f.name != "text"]).add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return covered.mapInArrow(_cover(window, digest), schema)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the repeated passages taken out of text (and n_chars, where it is there, counted anew)."""
    done = remove_repeats(keyed(docs), window)
    columns = {c: F.col("kept") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(columns["n_chars"])
    return done.select(*(x.alias(c) for c, x in columns.items()))
