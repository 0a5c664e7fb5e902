"""Token ids as binary files with fixed-width bit packing.

Every id takes the least number of bits that the vocabulary needs. A file is a Parquet part whose rows are blocks: a
block holds whole documents (one, if it is longer than BLOCK_IDS), their ids packed one after the other, and for each
document where it ends, so one document is read by unpacking its own bits and nothing else. Documents lie in ascending
doc_id order (nulls first), within a shard and from shard to shard. Shards are ranges of doc_id from quantiles of the id
column alone; a doc_id (or null) that fills shards by itself is cut further by the checksum of its texts. Ids are made
where the texts lie and only they move.

Nulls: a null text is empty and has the end id alone; null doc_ids come first. Rows that repeat a doc_id follow each
other, ordered by their text's checksum, their length and their ids' checksum; rows that tie in all that are equal. A very
long text is a block of its own. An empty table gives no files and an empty result; further columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import gathered, slices, stored, words_of

BLOCK_IDS = 1 << 17
#: Documents of a shard, about; their number follows the input up to SHARDS_MOST.
SHARD_DOCS = 4000
SHARDS_MOST = 20_000
#: Words whose ids a worker remembers, and as many older ones.
REMEMBERED = 250_000
#: Stands for a null doc_id in bounds, before all others.
LEAST = int(np.iinfo(np.int64).min)

_STOP = r"[a-z0-9][.,]$"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Least significant bit first, without gaps."""
    ids = np.ascontiguousarray(ids, "<u4")
    if bits in (8, 16, 32):  # the same bytes, whole
        return ids.astype(f"<u{bits // 8}").tobytes()
    flat = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(flat, bitorder="little").tobytes()


def unpack(data: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """count ids from the start-th on, touching only their bytes."""
    first, last = start * bits // 8, -(-(start + count) * bits // 8)
    raw = np.frombuffer(data, np.uint8)[first:last]
    if bits in (8, 16, 32):
        return raw.view(f"<u{bits // 8}").astype(np.uint32)
    skip = start * bits - 8 * first
    flat = np.unpackbits(raw, bitorder="little")[skip : skip + count * bits].reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _told(path: str) -> dict:
    """What the tokenizer's own file says of how it cuts texts."""
    whole = json.loads(_tokenizer(path).to_str())
    return {"normalizer": whole["normalizer"], "pre_tokenizer": whole["pre_tokenizer"], "suffix": whole["model"].get("end_of_word_suffix")}


def vocabulary_size(path: str) -> int:
    return _tokenizer(path).get_vocab_size()


#: Texts on which ids by words must be those of whole texts before a tokenizer is trusted with words.
PROBES = (
    "Plain words, and more. Of 10 or 2.5: it's I'LL we'd.", "tab\there\n\nline\x0b\x0c\rend", "a.b c,d e., f.,g (h) [i] {j}. k", "ÀÉ ß İ ǅ ΑΣ. Σ, 日本語。 テキスト é\u0301.",
    "x  y   z", " lead and trail ", "under_score a-b-c #*$%&|", "a. b, c.d e,f 9. 9, ..", "no\u00a0break\u2003space\u3000wide", "😀 ok. 👍🏽,",
)


def cuts_at_words(path: str) -> bool:
    """Whether the tokenizer's own file says that it lowers its input, cuts at white space and drops it, and the probes
    agree."""
    told = _told(path)
    steps = lambda x, many: [] if x is None else x[many] if x["type"] == "Sequence" else [x]
    normal, first = steps(told["normalizer"], "normalizers"), steps(told["pre_tokenizer"], "pretokenizers")[:1]
    lowers = any(x["type"] == "Lowercase" for x in normal) and all(x["type"] in ("NFC", "Lowercase", "Replace") for x in normal)
    spaces = all(x["type"] != "Replace" or (x["pattern"] == {"Regex": r"\s+"} and x["content"] == " ") for x in normal)
    drops = bool(first) and first[0]["type"] == "Split" and first[0]["behavior"] == "Removed" and first[0]["invert"]
    if not (lowers and spaces and drops and any(t.special for t in _tokenizer(path).get_added_tokens_decoder().values())):
        return False
    words = WordIds(path)
    return all(np.array_equal(np.frombuffer(x, words.kind), words.whole(t)) for t, x in zip(PROBES, words(PROBES), strict=True))


class Ids:
    """Makes ids of texts."""

    #: The type of the ids: little-endian, two bytes where the vocabulary fits.
    kind: np.dtype

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), one text behind the other, and how many each has."""
        raise NotImplementedError

    def __call__(self, texts: Sequence[str | None]) -> list[bytes]:
        """For each text its ids as integers of the kind."""
        flat, counts = self.ids(pa.array(texts, pa.string()))
        at = np.concatenate(([0], np.cumsum(counts)))
        return [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


class WholeIds(Ids):
    """Ids of whole texts, for any tokenizer."""

    def __init__(self, path: str) -> None:
        self._tokenizer = _tokenizer(path)
        self.kind = np.dtype("<u2" if vocabulary_size(path) <= 1 << 16 else "<u4")

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        done = [x.ids for x in self._tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        return np.array([k for x in done for k in x], self.kind), np.array([len(x) for x in done], np.int64)


class WordIds(Ids):
    """Ids of a text from those of its words: right for tokenizers that lower their input and whose pre-tokenizer cuts at
    ASCII white space, which it drops, and between letters or digits and marks (see cuts_at_words). A batch's texts are cut
    into words and numbered by column functions; each different word is looked up once, and the ids of all places are gathered
    by numpy. A full stop or comma that ends a word counts as a word. Only words not seen lately go to the tokenizer, many in
    one call: a special token, which no word given so holds, keeps them apart. A text that may hold a special token goes there
    as it is."""

    def __init__(self, path: str) -> None:
        tokenizer = _tokenizer(path)
        many = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        self.kind = np.dtype("<u2" if vocabulary_size(path) <= 1 << 16 else "<u4")
        self.whole = lambda text: np.array(many([text], add_special_tokens=False)[0].ids, self.kind)
        special = sorted((k, t.content) for k, t in tokenizer.get_added_tokens_decoder().items() if t.special)
        self._apart, self._mark = special[0]
        suffix = _told(path)["suffix"]
        self._ends = np.zeros(vocabulary_size(path), bool)
        self._ends[[k for t, k in tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]] = True
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}  # what was known before, for words that come again

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        words, at = words_of(pc.ascii_lower(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts))
        coded = words.dictionary_encode()
        held = self._look_up(coded.dictionary)
        flat, ends = gathered(held, coded.indices.to_numpy(zero_copy_only=False), self.kind)
        counts = np.diff(ends[at])
        if odd.any():
            whole = [(k, self.whole(texts[k].as_py())) for k in np.nonzero(odd)[0].tolist()]
            counts[odd] = [len(x) for _, x in whole]
            flat = np.insert(flat, np.repeat([ends[at[k]] for k, _ in whole], counts[odd]), np.concatenate([x for _, x in whole]))
        return flat, counts

    def _look_up(self, words: pa.Array) -> list[bytes]:
        """The ids of different words. A word with a full stop or comma at its end is looked up without."""
        if len(self._known) > REMEMBERED:
            self._known, self._older = {}, self._known
        known, older = self._known, self._older
        names = words.to_pylist()
        stopped = np.nonzero(pc.match_substring_regex(words, _STOP).to_numpy(zero_copy_only=False))[0].tolist() if len(words) else []
        marks = {}
        for k in stopped:
            marks[k], names[k] = names[k][-1], names[k][:-1]
        letters, others = [], []
        for w in {*names, *".,"} if stopped else names:
            if w not in known:
                if (before := older.get(w)) is not None:
                    known[w] = before
                else:
                    (letters if w.isalpha() else others).append(w)
        for at in range(0, len(letters), 1000):
            self._learn_letters(letters[at : at + 1000])
        for at in range(0, len(others), 1000):
            self._learn(others[at : at + 1000])
        out = [known[w] for w in names]
        for k, mark in marks.items():
            out[k] += known[mark]
        return out

    def _learn(self, words: list[str]) -> None:
        """In one call, with the special token between the words."""
        ids = self.whole(self._mark.join(words))
        cut = np.nonzero(ids == self._apart)[0]
        self._note(words, ids, np.concatenate(([0], cut + 1)), np.append(cut, len(ids)))

    def _learn_letters(self, words: list[str]) -> None:
        """In one call, with a space between. A word of letters is one unit to the pre-tokenizer, whose last id is one that
        ends a word; if there are as many of those as words (none makes fewer than one), they tell the words apart."""
        ids = self.whole(" ".join(words))
        end = np.nonzero(self._ends[ids])[0] + 1
        if len(end) == len(words):
            self._note(words, ids, np.concatenate(([0], end[:-1])), end)
        else:
            self._learn(words)

    def _note(self, words: list[str], ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        size, raw = self.kind.itemsize, ids.tobytes()
        self._known.update(zip(words, [raw[a:b] for a, b in zip((size * start).tolist(), (size * end).tolist(), strict=True)], strict=True))


@cache
def word_ids(path: str) -> WordIds | WholeIds:
    """One for each worker process, so that its tasks share what is known."""
    return WordIds(path) if cuts_at_words(path) else WholeIds(path)


def encode(docs: DataFrame, path: str, end_id: int, bounds: list[tuple[int, int]]) -> DataFrame:
    """(doc_id, shard, text_crc, n_tokens, packed) of docs (doc_id, text): the ids of the text and end_id; bounds are the
    upper ends of the ranges but the last and the shards of each range."""
    bits = bits_for(vocabulary_size(path))
    below, parts = np.array([e for e, _ in bounds], np.int64), np.array([n for _, n in bounds] + [1], np.int64)
    base = np.cumsum(parts) - parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(path)
        kind = ids_of.kind
        whole_bytes = bits == 8 * kind.itemsize  # then the ids are packed as they are
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                docs = batch.column("doc_id")
                place = np.searchsorted(below, docs.fill_null(LEAST).to_numpy(zero_copy_only=False), "left")
                raw = batch.column("text").cast(pa.binary()).to_pylist()
                crc = np.array([zlib.crc32(t or b"") for t in raw], np.int64)
                place = base[place] + (crc * parts[place] >> 32)
                flat, counts = ids_of.ids(batch.column("text"))
                at = np.cumsum(counts)
                flat, at = np.insert(flat, at, end_id), np.concatenate(([0], at + np.arange(1, len(at) + 1)))
                if whole_bytes:
                    packed = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(at * kind.itemsize), pa.py_buffer(flat)]).cast(pa.binary())
                else:
                    packed = pa.array([pack(flat[a:b], bits) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                cols = [docs, pa.array(place, pa.int32()), pa.array(crc), pa.array(counts + 1), packed]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "shard", "text_crc", "n_tokens", "packed"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shard int, text_crc long, n_tokens long, packed binary")


def _boundaries(ids: DataFrame) -> list[tuple[int, int]]:
    """Upper ends of the ranges of doc_id but the last, and the shards of each: from a quantile sketch of doc_id (bounded by
    SHARDS_MOST numbers). An id that is several quantiles, or null if it is often, is a range of its own with several."""
    n, nulls = ids.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
    shards = min(SHARDS_MOST, max(1, n // SHARD_DOCS))
    if shards == 1:
        return []
    often = Counter({LEAST: nulls * shards // n})
    quantiles = ids.where("doc_id is not null").approxQuantile("doc_id", [k / shards for k in range(1, shards)], min(0.25, 0.1 / shards))
    often.update(int(q) for q in quantiles)
    out = {}
    for q, times in often.items():
        if times > 1 and q > LEAST:
            out.setdefault(q - 1, 1)
        if times:
            out[q] = max(1, times)
    return sorted(out.items())


def write_files(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the token files of docs and returns them as read back: (shard, block, start, bits, doc_ids, counts, packed).

    start: ids of the shard before the block; counts: each document's number of ids."""
    bits = bits_for(vocabulary_size(path))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    encoded = encode(narrow, path, end_id, _boundaries(narrow.select("doc_id")))
    order = [F.col("doc_id").asc_nulls_first(), "text_crc", "n_tokens", F.crc32("packed")]
    dealt = encoded.repartition("shard").sortWithinPartitions("shard", *order)
    schema = "shard int, block int, start long, bits int, doc_ids array<bigint>, counts array<bigint>, packed binary"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start, ids, counts, parts, held = None, 0, 0, [], [], [], 0

        def ended() -> pa.RecordBatch:
            # documents end on any bit: joined as ids unless every one fills whole bytes
            whole = bits % 8 == 0
            packed = b"".join(parts) if whole else pack(np.concatenate([unpack(p, bits, 0, n) for p, n in zip(parts, counts, strict=True)]), bits)
            row = [shard, block, start, bits, ids, counts, packed]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for doc, own, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "shard", "n_tokens", "packed")), strict=True):
                if ids and (own != shard or held + n > BLOCK_IDS):
                    yield ended()
                    block, start, ids, counts, parts, held = block + 1, start + held, [], [], [], 0
                if own != shard:
                    shard, block, start = own, 0, 0
                ids.append(doc)
                counts.append(n)
                parts.append(data)
                held += n
        if ids:
            yield ended()

    return stored(dealt.mapInArrow(blocks, schema), "tokens")


def read_digests(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the token files alone."""
    # one row for each shard, of which there are SHARDS_MOST at most
    shards = files.select("shard", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = shards.select("shard", F.coalesce(before, F.lit(0)).alias("shard_start"))
    placed = files.join(F.broadcast(starts), "shard").select((F.col("shard_start") + F.col("start")).alias("start"), "bits", "doc_ids", "counts", "packed")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                start, bits, docs, counts, data = (x.as_py() for x in row)
                at = np.concatenate(([0], np.cumsum(counts)))
                ids = unpack(data, bits, 0, int(at[-1])).astype("<u4")
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                cols = [pa.array(docs, pa.int64()), pa.array(start + at[:-1]), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(files: DataFrame, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of all rows with one of these doc_ids, unpacking nothing of the blocks but their own bits."""
    wanted = frozenset(doc_ids)
    array = F.array(*(F.lit(d).cast("long") for d in sorted(wanted))) if wanted else F.array().cast("array<bigint>")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, counts, bits, data in zip(*(batch.column(c) for c in ("doc_ids", "counts", "bits", "packed")), strict=True):
                docs, counts = docs.as_py(), counts.as_py()
                at = np.concatenate(([0], np.cumsum(counts)))
                hits = [k for k, d in enumerate(docs) if d in wanted]
                ids = [unpack(data.as_py(), bits.as_py(), int(at[k]), counts[k]).astype(np.int64) for k in hits]
                yield pa.RecordBatch.from_arrays([pa.array([docs[k] for k in hits], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    hits = files.where(F.arrays_overlap("doc_ids", array)).select("doc_ids", "counts", "bits", "packed")
    return hits.mapInArrow(read, "doc_id long, ids array<bigint>")
