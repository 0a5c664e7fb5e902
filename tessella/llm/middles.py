"""Fill-in-the-middle: a text's units are dealt to a prefix, a middle and a suffix, and written with the middle last.

Units and control marks are found by one automaton over bytes: its states tell a word from white space and how much of a
mark has been read. It runs over all chunks of a batch at once and from every state: a chunk gives the state that follows
each state and, for each, the words that end in it and the marks it completes. Such summaries are composed (an associative
operation, done by doubling) to the state in which each chunk is really entered, and to the number of words that end before
it; so the chunk that holds a cut is known, and only there its place is looked for.

Texts over GIANT bytes are cut into pieces of that size, which are dealt to all tasks and summed up there by the same
functions; the summaries of a text meet (a text has 2 GB, so 32,768 of them at most), and its two cuts are looked for in the
pieces that hold them. What a text becomes doesn't depend on where it is cut.

A null text counts as empty, a null id as an empty one in the seed; empty texts, and those that contain a mark, stay plain.
Repeated rows and ids get each a row, equal ones for equal texts. Where both cuts fall together the middle is empty. An empty
table gives an empty result; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, slices

#: Prefix, suffix and middle mark.
MARKS = ("<P>", "<S>", "<M>")
SPACES = b" \t\n\v\f\r"
CHUNK = 1024
GIANT = 1 << 16


@dataclass(frozen=True)
class Automaton:
    """By state and class of bytes: the state that follows, whether a word ends, whether a mark is complete. The last class
    pads a chunk and changes nothing. State 0 is that of white space and of a text's start."""

    classes: np.ndarray
    follows: np.ndarray
    ends: np.ndarray
    hits: np.ndarray
    in_word: np.ndarray


@cache
def automaton(marks: tuple[str, ...] = MARKS) -> Automaton:
    words = [m.encode() for m in marks]
    known: dict[tuple[bool, bytes], int] = {(False, b""): 0}
    table, queue = [], [(False, b"")]
    for word, read in queue:
        row = []
        for byte in range(256):
            space = byte in SPACES
            seen = read + bytes([byte])
            hit = any(seen.endswith(w) for w in words)
            while seen and not any(len(w) > len(seen) and w.startswith(seen) for w in words):
                seen = seen[1:]
            if (state := (not space, seen)) not in known:
                known[state] = len(known)
                queue.append(state)
            row.append((known[state], space and word, hit))
        table.append(row)
    columns = [tuple(row[byte] for row in table) for byte in range(256)]
    kinds = {c: k for k, c in enumerate(dict.fromkeys(columns))}
    part = lambda n, pad: np.array([[c[s][n] for c in kinds] + [pad(s)] for s in range(len(table))])
    return Automaton(
        np.array([kinds[c] for c in columns], np.uint8),
        part(0, lambda s: s).astype(np.uint8),
        part(1, lambda s: False).astype(np.int32),
        part(2, lambda s: False).astype(np.int32),
        np.array([word for word, _ in queue]),
    )


@dataclass
class Summary:
    """Of chunks, by the state that each is entered in: the state it is left in, words that end in it, marks completed."""

    follows: np.ndarray
    ends: np.ndarray
    hits: np.ndarray
    chars: np.ndarray

    def at(self, rows: np.ndarray) -> Summary:
        return Summary(self.follows[rows], self.ends[rows], self.hits[rows], self.chars[rows])

    def then(self, later: Summary) -> Summary:
        """The summaries of each chunk with the chunk behind it."""
        by = self.follows.astype(np.int64)
        taken = [np.take_along_axis(x, by, 1) for x in (later.follows, later.ends, later.hits)]
        return Summary(taken[0], self.ends + taken[1], self.hits + taken[2], self.chars + later.chars)

    def running(self, place: np.ndarray) -> Summary:
        """Of each chunk with all before it in its text, where it has that place."""
        out, step = self.at(np.arange(len(place))), 1
        while step <= place.max(initial=0):
            late = np.flatnonzero(place >= step)
            both = out.at(late - step).then(out.at(late))
            out.follows[late], out.ends[late], out.hits[late], out.chars[late] = both.follows, both.ends, both.hits, both.chars
            step *= 2
        return out


def rows_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The classes of the chunks' bytes, a row each, padded."""
    auto = automaton()
    width = int(sizes.max(initial=1))
    at = starts[:, None] + np.arange(width)
    inside = np.arange(width) < sizes[:, None]
    return np.where(inside, auto.classes[data[np.minimum(at, max(len(data) - 1, 0))]], np.uint8(auto.follows.shape[1] - 1)) if len(data) else np.full((len(starts), width), auto.follows.shape[1] - 1, np.uint8)


def first_bytes(data: np.ndarray) -> np.ndarray:
    """How many code points begin before each byte, and in all."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))


def summarised(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, chars: np.ndarray) -> Summary:
    """All chunks read at once, from all states, a byte of each at a time."""
    auto = automaton()
    n_states, n_classes = auto.follows.shape
    follows, ends, hits = (np.ascontiguousarray(x.reshape(-1)) for x in (auto.follows, auto.ends, auto.hits))
    state = np.repeat(np.arange(n_states, dtype=np.int32)[:, None], len(starts), 1)
    ended, hit = np.zeros_like(state), np.zeros_like(state)
    for column in np.ascontiguousarray(rows_of(data, starts, sizes).T):
        at = state * n_classes + column
        ended += ends[at]
        hit += hits[at]
        state = follows[at].astype(np.int32)
    return Summary(state.T.copy(), ended.T.astype(np.int64), hit.T.astype(np.int64), chars[starts + sizes] - chars[starts])


def cut_chunks(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, place in it, start and size of chunks; an empty text has one."""
    n = np.maximum(1, -(-sizes // CHUNK))
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return text, place, starts[text] + place * CHUNK, np.minimum(CHUNK, sizes[text] - place * CHUNK)


def found_ends(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, entered: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Where in each chunk, entered in a known state, its nth word ends."""
    auto = automaton()
    rows = rows_of(data, starts, sizes)
    word = auto.in_word[auto.follows[0]][rows]  # whether a byte is part of a word depends on the byte alone
    before = np.concatenate((auto.in_word[entered][:, None], word[:, :-1]), 1)
    inside = np.arange(rows.shape[1]) < sizes[:, None]
    return (np.cumsum(before & ~word & inside, axis=1) >= nth[:, None]).argmax(axis=1)


def targets(n: np.ndarray, draws: list[np.ndarray]) -> list[np.ndarray]:
    """Units before the first and the second cut, from two draws of unsigned 32-bit numbers."""
    a, b = (d % (n + 1) for d in draws)
    return [np.minimum(a, b), np.maximum(a, b)]


def cuts(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, draws: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of texts that lie in data: units, marks, and for both cuts the bytes and code points before."""
    chars = first_bytes(data)
    text, place, at, size = cut_chunks(starts, sizes)
    run = summarised(data, at, size, chars).running(place)
    last = np.flatnonzero(np.append(np.diff(text) > 0, True)) if len(text) else np.zeros(0, np.int64)
    ends = run.ends[:, 0]
    n = ends[last] + (sizes > 0)
    far = int(ends.max(initial=0)) + 2
    keys = text * far + ends
    found, told = [], []
    for want in targets(n, draws):
        k = np.minimum(np.searchsorted(keys, np.arange(len(n)) * far + want), last)
        first = place[k] == 0
        entered = np.where(first, 0, run.follows[k - 1, 0])
        nth = want - np.where(first, 0, ends[k - 1])
        inner = at[k] + found_ends(data, at[k], size[k], entered, nth) if len(k) else at[k]
        where = np.where(want == 0, starts, np.where(want == n, starts + sizes, inner))
        found.append(where - starts)
        told.append(chars[where] - chars[starts])
    return n, run.hits[last, 0], found, told


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a binary column, the starts and the sizes of its values."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[: at[-1]] if len(column) else np.zeros(0, np.uint8)
    return data[at[0] :] if len(at) else data, at[:-1] - at[0], np.diff(at)


_CUT = {"n": pa.int64(), "marks": pa.int64(), "first": pa.int64(), "second": pa.int64(), "first_chars": pa.int64(), "second_chars": pa.int64()}
_CUT_SCHEMA = ", ".join(f"{c} long" for c in _CUT)


def _small(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, h1, h2) with their cuts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                draws = [batch.column(c).to_numpy() for c in ("h1", "h2")]
                n, marks, at, chars = cuts(*_bytes_of(batch.column("text")), draws)
                made = [pa.array(x, pa.int64()) for x in (n, marks, *at, *chars)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *made], names=["doc_id", "text", *_CUT])

    return rows.mapInArrow(cut, f"doc_id long, text binary, {_CUT_SCHEMA}")


_PIECE = pa.schema([("row_key", pa.int64()), ("piece", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("size", pa.int64()), ("follows", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("hits", pa.list_(pa.int64())), ("chars", pa.int64())])
_SIDES = ("first", "second")
_FOUND = pa.schema([("row_key", pa.int64()), ("n", pa.int64()), ("marks", pa.int64())] + [(f"{s}_{x}", pa.int64()) for s in _SIDES for x in ("piece", "state", "nth", "chars")])


def _sum_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "part"):
            data, starts, sizes = _bytes_of(batch.column("part"))
            text, place, at, size = cut_chunks(starts, sizes)
            last = np.flatnonzero(np.append(np.diff(text) > 0, True))
            done = summarised(data, at, size, first_bytes(data)).running(place).at(last)
            cols = [batch.column(c) for c in ("row_key", "piece", "h1", "h2")]
            lists = [pa.array(x.astype(np.int64).tolist(), pa.list_(pa.int64())) for x in (done.follows, done.ends, done.hits)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sizes), *lists, pa.array(done.chars)], schema=_PIECE)


def _resolved(table: pa.Table) -> pa.Table:
    """Of the summaries of one text: its units and marks, and for each cut the piece that holds it, the state in which that is
    entered, which word's end it is (0: the text's start, -1: its end) and the code points before the piece."""
    table = table.sort_by("piece")
    grid = lambda c: np.array(table[c].to_pylist(), np.int64)
    each = Summary(grid("follows"), grid("ends"), grid("hits"), table["chars"].to_numpy())
    run = each.running(np.arange(len(each.chars)))
    ends, n = run.ends[:, 0], int(run.ends[-1, 0]) + 1
    row = {"row_key": table["row_key"][0].as_py(), "n": n, "marks": int(run.hits[-1, 0])}
    for side, want in zip(_SIDES, targets(np.array([n]), [table[c].to_numpy()[:1] for c in ("h1", "h2")]), strict=True):
        want = int(want[0])
        k = min(int(np.searchsorted(ends, want)), len(ends) - 1) if want else 0
        before = (0, 0, 0) if k == 0 else (int(run.follows[k - 1, 0]), int(ends[k - 1]), int(run.chars[k - 1]))
        nth = 0 if want == 0 else -1 if want == n else want - before[1]
        row |= {f"{side}_piece": k, f"{side}_state": before[0], f"{side}_nth": nth, f"{side}_chars": int(run.chars[-1]) if nth == -1 else before[2]}
    return pa.Table.from_pylist([row], schema=_FOUND)


def _place(part: bytes, state: int, nth: int) -> tuple[int, int]:
    """Bytes and code points of a piece, entered in a state, up to the end of its nth word."""
    data = np.frombuffer(part, np.uint8)
    chars = first_bytes(data)
    _, place, at, size = cut_chunks(np.zeros(1, np.int64), np.array([len(data)]))
    run = summarised(data, at, size, chars).running(place)
    ends = run.ends[:, state]
    k = int(np.searchsorted(ends, nth))
    entered = state if k == 0 else int(run.follows[k - 1, state])
    left = nth - (0 if k == 0 else int(ends[k - 1]))
    where = int(at[k] + found_ends(data, at[k : k + 1], size[k : k + 1], np.array([entered]), np.array([left]))[0])
    return where, int(chars[where])


def _giant(rows: DataFrame, giant: int) -> DataFrame:
    """The same for rows (row_key, doc_id, text, h1, h2) of long texts, whose pieces are read apart."""
    size = F.octet_length("text")
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((size - 1) / giant))).alias("piece")
    pieces = rows.select("row_key", "h1", "h2", "text", numbers)
    pieces = pieces.select("row_key", "piece", "h1", "h2", F.substring("text", (F.col("piece") * giant + 1).cast("int"), F.lit(giant)).alias("part"))
    sums = pieces.repartition("row_key", "piece").mapInArrow(_sum_pieces, "row_key long, piece long, h1 long, h2 long, size long, follows array<long>, ends array<long>, hits array<long>, chars long")
    found = sums.groupBy("row_key").applyInArrow(_resolved, ", ".join(f"{f.name} long" for f in _FOUND))
    both = rows.drop("h1", "h2").join(found, "row_key")
    for side in _SIDES:
        held = F.substring("text", (F.col(f"{side}_piece") * giant + 1).cast("int"), F.lit(giant))
        both = both.withColumn(f"{side}_part", F.when(F.col(f"{side}_nth") > 0, held))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                at, told = [], []
                for side in _SIDES:
                    parts, states, nths, before = (batch.column(f"{side}_{x}").to_pylist() for x in ("part", "state", "nth", "chars"))
                    inner = [(0, 0) if p is None else _place(p, s, k) for p, s, k in zip(parts, states, nths, strict=True)]
                    held, sizes = batch.column(f"{side}_piece").to_pylist(), batch.column("size").to_pylist()
                    at.append([0 if k == 0 else z if k < 0 else h * giant + w for k, z, h, (w, _) in zip(nths, sizes, held, inner, strict=True)])
                    told.append([0 if k == 0 else b if k < 0 else b + c for k, b, (_, c) in zip(nths, before, inner, strict=True)])
                made = [pa.array(x, pa.int64()) for x in (*at, *told)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text", "n", "marks")), *made], names=["doc_id", "text", *_CUT])

    return both.withColumn("size", size.cast("long")).mapInArrow(cut, f"doc_id long, text binary, {_CUT_SCHEMA}")


def fill_in_middle(docs: DataFrame, seed: str = "42", rate: int = 50, suffix_first: int = 80, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output). Of a hundred texts about rate are cut, and of a hundred of those
    about suffix_first have form spm, the others psm."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    small, long = base.where(F.octet_length("text") <= giant), base.where(F.octet_length("text") > giant)
    drawn = lambda df: df.withColumns({f"h{k + 1}": _draw(seed, k) for k in range(2)})
    rows = _small(drawn(small))
    if long.limit(1).count():
        apart = keyed(long.withColumn("text", F.col("text").cast("string"))).select("row_key", "doc_id", F.col("text").cast("binary").alias("text"))
        rows = rows.union(_giant(drawn(apart), giant))
    plain = (F.octet_length("text") == 0) | (F.col("marks") > 0) | (_draw(seed, 2) % 100 >= rate)
    form = F.when(plain, "plain").when(_draw(seed, 3) % 100 < suffix_first, "spm").otherwise("psm")
    part = lambda a, b: F.substring("text", (a + 1).cast("int"), (b - a).cast("int"))
    first, second, size = F.col("first"), F.col("second"), F.octet_length("text").cast("long")
    prefix, middle, suffix = part(F.lit(0).cast("long"), first), part(first, second), part(second, size)
    p, s, m = (F.lit(x).cast("binary") for x in MARKS)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    cut = lambda c: F.when(F.col("form") != "plain", c)
    return rows.withColumn("form", form).select(
        "doc_id", "n", "form", cut(F.col("first_chars")).alias("prefix_chars"), cut(F.col("second_chars") - F.col("first_chars")).alias("middle_chars"), output.cast("string").alias("output")
    )


def _draw(seed: str, k: int) -> Column:
    """The kth 32 bits of the seeded hash of a document's id, unsigned."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: the marks part it, and no text that was cut contains one."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in MARKS), 4)
    at = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))
