"""Media columns: what a blob really is, by its bytes.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass over a blob. Each hit is only a
suspicion: a validator of the format then walks the structure (chunk lengths, checksums, end marks) and gives the exact
span, or rejects the hit. The outermost valid spans, from left to right, are the media of the blob: one that covers it
whole corrects the declared type, the others are carved out as embedded media. End marks are looked for once in a blob, and
what a chain of pages, boxes, chunks or frames comes to is kept for each of its places, so that a blob is walked once by each
format however many hits ask. Only deflated data have to be inflated from every hit whose header makes sense.

Null blobs have no media and a null type; empty ones have none and type application/octet-stream. A blob without valid
media keeps its declared type if that is not one of the known formats, else becomes application/octet-stream. Repeated
rows each get theirs; of hits that tie at a place the first format that is valid counts. Long blobs are read one at a time.
An empty table gives an empty result, and columns that have the names of what is made are replaced.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

UNKNOWN = "application/octet-stream"
UNIT = 192
SAMPLE_RATE = 8000


@lru_cache(maxsize=64)
def places(b: bytes, pattern: bytes) -> list[int]:
    """Where a pattern stands in a blob: looked for once, whatever the number of hits that ask."""
    return [m.start() for m in re.finditer(pattern, b, re.DOTALL)]


@lru_cache(maxsize=1)
def _kept(b: bytes) -> dict[object, dict]:
    """What has been learnt of places in the blob, by the kind of chain."""
    return defaultdict(dict)


def chained(b: bytes, kind: object, at: int, step: Callable[[int], int | None], close: Callable[[int, object], object]) -> object:
    """What the chain of parts (pages, boxes, chunks) from a place on comes to. step gives the place of the next part, or None
    at the end of the chain; close makes of a part and of what the rest comes to (None at the end) what the chain comes to from
    that part on. It is kept for every part, so that chains that meet are walked once."""
    known, path = _kept(b)[kind], []
    while at is not None and at not in known:
        path.append(at)
        at = step(at)
    rest = None if at is None else known[at]
    for k in reversed(path):
        rest = known[k] = close(k, rest)
    return rest


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo that of CRC-32, bits reversed."""
    out = 0
    for k in range(32):
        if b & (1 << (31 - k)):
            out ^= a
        a = a >> 1 ^ (0xEDB88320 if a & 1 else 0)
    return out


@cache
def _square(k: int) -> int:
    """x to the power 2**k."""
    return 1 << 30 if k == 0 else _times(_square(k - 1), _square(k - 1))


def crc_of(b: bytes, start: int, end: int) -> int:
    """CRC-32 of a part. Of long ones by the checksums of what ends with their start and with their end, which are kept at
    regular places, so that the same bytes are not read once for every part they are in."""
    if end - start <= 4 * _STRIDE:
        return zlib.crc32(b[start:end])
    kept = _kept(b)["crc"]

    def upto(at: int) -> int:
        whole = at // _STRIDE
        for k in range(len(kept), whole + 1):
            kept[k] = zlib.crc32(b[(k - 1) * _STRIDE : k * _STRIDE], kept[k - 1]) if k else 0
        return zlib.crc32(b[whole * _STRIDE : at], kept[whole])

    shift, n, k = 1 << 31, 8 * (end - start), 0
    while n:
        if n & 1:
            shift = _times(shift, _square(k))
        n, k = n >> 1, k + 1
    return upto(end) ^ _times(shift, upto(start))


_STRIDE = 4096


def _png(b: bytes, s: int) -> int | None:
    def chunk(at: int) -> tuple[int, bytes] | None:
        """End and kind of a whole chunk."""
        if at + 12 > len(b):
            return None
        n, kind = struct.unpack_from(">I4s", b, at)
        whole = at + 12 + n <= len(b) and crc_of(b, at + 4, at + 8 + n) == struct.unpack_from(">I", b, at + 8 + n)[0]
        return (at + 12 + n, kind) if whole else None

    def step(at: int) -> int | None:
        parts[at] = chunk(at)
        return None if parts[at] is None or parts[at][1] == b"IEND" else parts[at][0]

    def close(at: int, rest: tuple[int | None, bool] | None) -> tuple[int | None, bool]:
        if parts[at] is None:
            return None, False
        end, data = rest or (parts[at][0], False)
        return end, data or parts[at][1] == b"IDAT"

    parts = _kept(b)["png parts"]
    if b[s + 12 : s + 16] != b"IHDR":
        return None
    end, data = chained(b, "png", s + 8, step, close)
    return end if data else None


def _gif(b: bytes, s: int) -> int | None:
    if len(b) < s + 13:
        return None
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 128 else 0

    def blocks(at: int) -> int | None:
        """Behind the data blocks that start there."""
        return chained(b, "gif blocks", at, lambda k: k + 1 + b[k] if k < len(b) and b[k] else None, lambda k, rest: rest if rest is not None else k + 1 if k < len(b) and not b[k] else None)

    def step(at: int) -> int | None:
        kind = b[at] if at < len(b) else 0
        if kind == 0x21:
            return blocks(at + 2)
        return blocks(at + 11 + table(b[at + 9])) if kind == 0x2C and at + 10 < len(b) else None

    def close(at: int, rest: tuple[int | None, bool] | None) -> tuple[int | None, bool]:
        if rest is None:
            return (at + 1, False) if at < len(b) and b[at] == 0x3B else (None, False)
        return rest[0], rest[1] or b[at] == 0x2C

    end, image = chained(b, "gif", s + 13 + table(b[s + 10]), step, close)
    return end if image else None


def _jpeg(b: bytes, s: int) -> int | None:
    marks = places(b, rb"\xff[^\x00\xd0-\xd7]")

    def step(at: int) -> int | None:
        if at + 4 > len(b) or b[at] != 0xFF or b[at + 1] in (0xD8, 0xD9) or (n := int.from_bytes(b[at + 2 : at + 4], "big")) < 2:
            return None
        if b[at + 1] != 0xDA:
            return at + 2 + n
        k = bisect.bisect_left(marks, at + 2 + n)  # coded data up to the next mark
        return marks[k] if k < len(marks) else None

    def close(at: int, rest: tuple[int | None, bool] | None) -> tuple[int | None, bool]:
        """The end, and whether there is a frame; the end mark counts behind coded data only, which starts with 0xDA."""
        kind = b[at + 1] if at + 2 <= len(b) and b[at] == 0xFF else 0
        if rest is None:
            return (at + 2 if kind == 0xD9 else None), False
        if kind != 0xDA and rest[0] is not None and b[at + 2 + int.from_bytes(b[at + 2 : at + 4], "big") + 1] == 0xD9:
            return None, False
        return rest[0], rest[1] or 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)

    end, frame = chained(b, "jpeg", s + 2, step, close)
    return end if frame and end != s + 4 else None


def _bmp(b: bytes, s: int) -> int | None:
    if len(b) < s + 30:
        return None
    size, _, pixels, header = struct.unpack_from("<IIII", b, s + 2)
    planes = struct.unpack_from("<H", b, s + 26)[0]
    ok = header in (40, 52, 56, 108, 124) and planes == 1 and 14 + header <= pixels < size and s + size <= len(b)
    return s + size if ok else None


def _riff(kind: bytes, first: tuple[bytes, ...], needed: dict[bytes, int]) -> Callable[[bytes, int], int | None]:
    """needed: chunks that must be there, with the bytes they have at least, one of each at least."""

    def valid(b: bytes, s: int) -> int | None:
        if len(b) < s + 20 or b[s + 8 : s + 12] != kind or b[s + 12 : s + 16] not in first:
            return None
        end = s + 8 + struct.unpack_from("<I", b, s + 4)[0]
        if end > len(b):
            return None

        def step(at: int) -> int | None:
            n = struct.unpack_from("<I", b, at + 4)[0] if at + 8 <= end else end
            return at + 8 + n + n % 2 if at + 8 + n <= end else None

        def close(at: int, rest: dict[bytes, int] | None) -> dict[bytes, int] | None:
            """Sizes of the needed chunks from there on, of each the first; None where they don't end with the file."""
            if rest is None:
                return {} if at == end else None
            name = b[at : at + 4]
            return rest | {name: struct.unpack_from("<I", b, at + 4)[0]} if name in needed else rest

        size = chained(b, (kind, end), s + 12, step, close)
        return end if size is not None and all(size.get(n, -1) >= least for n, least in needed.items()) else None

    return valid


def riff_chunks(b: bytes, s: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, start and end of each chunk's body; stops where one would leave the file."""
    at = s + 12
    while at + 8 <= end:
        name, n = struct.unpack_from("<4sI", b, at)
        if at + 8 + n > end:
            return
        yield name, at + 8, at + 8 + n
        at += 8 + n + n % 2


def _crc(width: int, poly: int) -> list[int]:
    table = []
    for k in range(256):
        c = k << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (width - 1) else c << 1) & ((1 << width) - 1)
        table.append(c)
    return table


_CRC8, _CRC16 = _crc(8, 0x07), _crc(16, 0x8005)


def _flac_header(b: bytes, s: int) -> int | None:
    """End of the frame header at s with its checksum, or None."""
    if s + 6 > len(b) or b[s] != 0xFF or b[s + 1] & 0xFE != 0xF8 or b[s + 2] >> 4 == 0 or b[s + 2] & 15 == 15:
        return None
    lead = b[s + 4]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1  # bytes that go on the number of the frame
    at = s + 5 + more + {6: 1, 7: 2}.get(b[s + 2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(b[s + 2] & 15, 0)
    if at >= len(b) or 0x80 <= lead < 0xC0:
        return None
    crc = 0
    for x in b[s:at]:
        crc = _CRC8[crc ^ x]
    return at + 1 if crc == b[at] else None


def _flac_frames(b: bytes) -> tuple[list[int], set[int]]:
    """Where frame headers stand in the blob."""
    kept = _kept(b)["flac"]
    if not kept:
        kept["starts"] = [x for x in places(b, rb"\xff[\xf8\xf9]") if _flac_header(b, x) is not None]
        kept["set"] = set(kept["starts"])
    return kept["starts"], kept["set"]


def _flac_body(b: bytes, s: int) -> int | None:
    """Where the first frame of the file at s stands, behind the metadata blocks."""
    if b[s + 4 : s + 5] not in (b"\x00", b"\x80") or int.from_bytes(b[s + 5 : s + 8], "big") != 34:
        return None

    def block(at: int) -> int | None:
        return at + 4 + int.from_bytes(b[at + 1 : at + 4], "big") if at + 4 <= len(b) and b[at] & 127 != 127 else None

    def close(at: int, rest: int | None) -> int | None:
        return block(at) if at + 4 <= len(b) and b[at] >= 128 else rest

    at = chained(b, "flac blocks", s + 4, lambda k: block(k) if k + 4 <= len(b) and b[k] < 128 else None, close)
    return at if at in _flac_frames(b)[1] else None


def _flac(b: bytes, s: int) -> int | None:
    """Metadata blocks, then frames. A frame's length is not written down: it ends where its checksum comes out and a frame
    header follows, or none. The frames end before the next file at the latest."""
    at = _flac_body(b, s)
    if at is None:
        return None
    _, wanted = _flac_frames(b)
    heads = _kept(b)["flac heads"]
    if not heads:
        heads["all"] = [x for x in places(b, b"fLaC") if _flac_body(b, x) is not None]
    k = bisect.bisect_left(heads["all"], at)
    limit = heads["all"][k] if k < len(heads["all"]) else len(b)
    crc, ends = 0, []
    least = at + max(10, int.from_bytes(b[s + 12 : s + 15], "big"))  # no frame is shorter than the first block says
    for k in range(at, limit):
        crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ b[k]]
        if crc == 0 and k + 1 in wanted and k + 1 < limit:
            least += k + 1 - at
            at, ends = k + 1, []
        elif crc == 0 and k + 1 >= least:
            ends.append(k + 1)
    # the last frame: up to the next file or the blob's end if its checksum comes out there, else to where it does first
    return None if not ends else ends[-1] if ends[-1] == limit else ends[0]


def _ogg(b: bytes, s: int) -> int | None:
    def page(at: int) -> int | None:
        """The end of the page there."""
        if at + 27 > len(b) or b[at : at + 5] != b"OggS\0" or at + 27 + b[at + 26] > len(b):
            return None
        end = at + 27 + b[at + 26] + sum(b[at + 27 : at + 27 + b[at + 26]])
        return end if end <= len(b) else None

    def step(at: int) -> int | None:
        ends[at] = page(at)
        return None if ends[at] is None or b[at + 5] & 4 else ends[at]

    ends = _kept(b)["ogg pages"]
    return chained(b, "ogg", s, step, lambda at, rest: ends[at] if ends[at] is not None and b[at + 5] & 4 else rest)


def _pdf(b: bytes, s: int) -> int | None:
    """Up to the last end mark before the next file: updates are appended behind an end mark."""
    if not (len(b) > s + 8 and b[s + 5 : s + 6].isdigit() and b[s + 6 : s + 7] == b"."):
        return None
    heads, ends = places(b, rb"%PDF-[0-9]\."), places(b, b"%%EOF")
    k = bisect.bisect_right(heads, s)
    last = bisect.bisect_left(ends, heads[k] if k < len(heads) else len(b)) - 1
    if last < 0 or ends[last] < s:
        return None
    refs = places(b, b"startxref")
    r = bisect.bisect_left(refs, s)
    return ends[last] + 5 if r < len(refs) and refs[r] < ends[last] else None


def _gzip(b: bytes, s: int) -> int | None:
    """A member whose header makes sense is inflated, if the stored blocks that it may start with lead to a further block."""
    if len(b) < s + 18 or b[s + 3] > 31 or b[s + 8] not in (0, 2, 4) or 13 < b[s + 9] < 255:
        return None

    def stored(at: int) -> int | None:
        """Behind the stored block there, which is not the last."""
        if at + 5 > len(b) or b[at] & 7 or int.from_bytes(b[at + 1 : at + 3], "little") ^ int.from_bytes(b[at + 3 : at + 5], "little") != 0xFFFF:
            return None
        return at + 5 + int.from_bytes(b[at + 1 : at + 3], "little")

    def close(at: int, rest: bool | None) -> bool:
        return rest if rest is not None else at < len(b) and b[at] & 6 != 6 and (b[at] & 6 != 0 or stored(at) is not None or b[at] & 7 == 1)

    if b[s + 3] == 0 and not chained(b, "gzip stored", s + 10, stored, close):
        return None
    box, at = zlib.decompressobj(31), s
    try:
        while at < len(b) and not box.eof:
            step = 65536 if at > s else 512
            box.decompress(box.unconsumed_tail or b[at : at + step], 1 << 20)  # bounded, however far it inflates
            at += 0 if box.unconsumed_tail else step
    except zlib.error:
        return None
    return min(at, len(b)) - len(box.unused_data) if box.eof else None


def _zip(b: bytes, s: int) -> int | None:
    """Up to the end record that tells of an archive which starts at s: a record gives the size and place of its directory, so
    it belongs to one start, and archives that are stored inside have others."""
    kept = _kept(b)["zip"]
    if not kept:
        kept[-1] = -1
        for end in places(b, rb"PK\x05\x06"):
            if end + 22 <= len(b):
                size, first, comment = struct.unpack_from("<IIH", b, end + 12)
                start = end - size - first
                if start >= 0 and end + 22 + comment <= len(b) and b[end - size : end - size + 4] == b"PK\1\2":
                    kept[start] = end + 22 + comment
    return kept.get(s)


def _mp4(b: bytes, s: int) -> int | None:
    """Boxes from ftyp on, of which one is moov or moof, as long as they follow each other; with the next ftyp another file
    starts."""

    def box(at: int) -> int | None:
        if at + 8 > len(b):
            return None
        n, kind = struct.unpack_from(">I4s", b, at)
        head = 8
        if n == 1 and at + 16 <= len(b):
            n, head = struct.unpack_from(">Q", b, at + 8)[0], 16
        return at + n if kind in BOXES and n >= head and at + n <= len(b) else None

    def step(at: int) -> int | None:
        return None if b[at + 4 : at + 8] == b"ftyp" else box(at)

    def close(at: int, rest: tuple[int, bool] | None) -> tuple[int, bool]:
        return (at, False) if rest is None else (rest[0], rest[1] or b[at + 4 : at + 8] in (b"moov", b"moof"))

    if (behind := box(s)) is None:
        return None
    end, movie = chained(b, "mp4", behind, step, close)
    return end if movie else None


def _mp3(b: bytes, s: int) -> int | None:
    """An ID3 tag and the frames behind it, three at least."""
    if len(b) < s + 10 or max(b[s + 6 : s + 10]) > 127:
        return None
    size = 0
    for x in b[s + 6 : s + 10]:
        size = size << 7 | x

    def frame(at: int) -> int | None:
        if at + 4 > len(b) or b[at] != 0xFF or b[at + 1] & 0xFE != 0xFA:  # version 1, layer III
            return None
        rate, hz = b[at + 2] >> 4, b[at + 2] >> 2 & 3
        if rate in (0, 15) or hz == 3:
            return None
        n = 144_000 * MP3_RATES[rate - 1] // (44_100, 48_000, 32_000)[hz] + (b[at + 2] >> 1 & 1)
        return at + n if at + n <= len(b) else None

    end, frames = chained(b, "mp3", s + 10 + size, frame, lambda at, rest: (at, 0) if rest is None else (rest[0], rest[1] + 1))
    return end if frames > 2 else None


#: Names of boxes at the top of a file, and kilobits a second of version 1, layer III (fixed values of the public formats).
BOXES = frozenset((b"ftyp", b"moov", b"moof", b"mdat", b"free", b"skip", b"wide", b"meta", b"sidx", b"styp", b"mfra", b"uuid", b"pdin"))
MP3_RATES = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)


#: Magic bytes, media type and validator of each format (fixed values of the public formats). A later format is tried where
#: the validator of an earlier one with the same bytes says no.
FORMATS: tuple[tuple[bytes, str, Callable[[bytes, int], int | None]], ...] = (
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"RIFF", "audio/wav", _riff(b"WAVE", (b"fmt ", b"JUNK", b"bext"), {b"fmt ": 16, b"data": 0})),
    (b"RIFF", "image/webp", _riff(b"WEBP", (b"VP8 ", b"VP8L", b"VP8X"), {})),
    (b"ID3", "audio/mpeg", _mp3),
    (b"ftyp", "video/mp4", _mp4),
    (b"fLaC", "audio/flac", _flac),
    (b"OggS", "audio/ogg", _ogg),
    (b"%PDF-", "application/pdf", _pdf),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"PK\x03\x04", "application/zip", _zip),
)
TYPES = frozenset(x[1] for x in FORMATS)
#: Bytes before the magic ones that belong to a file.
BEFORE = {b"ftyp": 4}


@cache
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    by_magic: dict[bytes, list] = {}
    for magic, kind, valid in FORMATS:
        by_magic.setdefault(magic, []).append((kind, valid))
    for magic, formats in by_magic.items():
        out.add_word(magic.decode("latin-1"), (len(magic) + BEFORE.get(magic, 0), formats))
    out.make_automaton()
    return out


def found_in(blob: bytes) -> list[tuple[str, int, int]]:
    """Type, start and end of the outermost valid media, in order. A hit inside an accepted span is not looked at."""
    out, free = [], 0
    for last, (size, formats) in _automaton().iter(blob.decode("latin-1")):
        start = last + 1 - size
        if start < free:
            continue
        for kind, valid in formats:
            if (end := valid(blob, start)) is not None:
                out.append((kind, start, end))
                free = end
                break
    places.cache_clear()
    _kept.cache_clear()
    return out


def corrected(declared: str | None, found: list[tuple[str, int, int]], size: int) -> str:
    if found and found[0][1:] == (0, size):
        return found[0][0]
    return UNKNOWN if declared is None or declared in TYPES else declared


_FOUND = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


@dataclass(frozen=True)
class Features:
    """Columns computed of a blob (null: all null) and its corrected type in the pass that sniffs it."""

    names: tuple[str, ...]
    kinds: tuple[str, ...]
    of: Callable[[bytes, str], tuple]


def sniff(df: DataFrame, blob_col: str = "media", declared_col: str = "declared_type", keep: list[str] | None = None, features: Features | None = None) -> DataFrame:
    """The columns keep of df (all, if not given) with media_type (corrected) and found (array of type, start, end; null
    for a null blob), and features. Columns of df with those names are replaced."""
    more = features or Features((), (), lambda blob, kind: ())
    base = df.drop("media_type", "found", *more.names)
    keep = [c for c in base.columns if keep is None or c in keep]
    span = T.StructType().add("type", "string").add("start", "long").add("end", "long")
    schema = T.StructType([base.schema[c] for c in keep]).add("media_type", "string").add("found", T.ArrayType(span))
    for n, k in zip(more.names, more.kinds, strict=True):
        schema = schema.add(n, k)
    arrow = {"long": pa.int64(), "string": pa.string()}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, blob_col):
                kinds, rows, extra = [], [], []
                for blob, told in zip(batch.column(blob_col), batch.column(declared_col).to_pylist(), strict=True):
                    b = blob.as_py()
                    found = None if b is None else found_in(b)
                    kinds.append(None if b is None else corrected(told, found, len(b)))
                    rows.append(None if b is None else [{"type": t, "start": s, "end": e} for t, s, e in found])
                    extra.append((None,) * len(more.names) if b is None else more.of(b, kinds[-1]))
                made = [pa.array([x[k] for x in extra], arrow[t]) for k, t in enumerate(more.kinds)]
                cols = [*(batch.column(c) for c in keep), pa.array(kinds, pa.string()), pa.array(rows, _FOUND), *made]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "media_type", "found", *more.names])

    return base.mapInArrow(look, schema)


def carve(df: DataFrame, blob_col: str = "media", keep: list[str] | None = None, declared_col: str = "declared_type") -> DataFrame:
    """(keep, place, type, start, end, bytes): a row for each media found in the blobs of df, the bytes cut out; place
    counts them in a blob from 0."""
    keep = keep or []
    found = sniff(df, blob_col, declared_col, [*keep, blob_col])
    rows = found.select(*keep, blob_col, F.posexplode("found").alias("place", "m"))
    return rows.select(*keep, "place", "m.type", "m.start", "m.end", F.col(blob_col).substr((F.col("m.start") + 1).cast("int"), (F.col("m.end") - F.col("m.start")).cast("int")).alias("bytes"))


def _little_endian(n: Column, size: int) -> Column:
    big = F.unhex(F.lpad(F.hex(n.cast("long")), 2 * size, "0"))
    return F.concat(*(F.substring(big, k, 1) for k in range(size, 0, -1)))


def as_wav(text: Column) -> Column:
    """The UTF-8 bytes of a text (null: none), padded with spaces to a positive multiple of UNIT, as unsigned 8-bit
    samples of a WAVE file. A further chunk, tlen, keeps the length without the padding."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(raw)
    size = F.greatest(F.lit(1), F.ceil(n / UNIT)).cast("int") * UNIT
    word = lambda x: F.lit(x).cast("binary")
    fixed = struct.pack("<IHHIIHH", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8)
    head = [word("RIFF"), _little_endian(4 + 24 + 16 + 8 + size, 4), word("WAVEfmt "), F.lit(bytearray(fixed)), word("tlen"), F.lit(bytearray(struct.pack("<I", 8)))]
    return F.concat(*head, _little_endian(n, 8), word("data"), _little_endian(size, 4), raw, F.repeat(F.lit(" "), size - n).cast("binary"))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media, declared_type): each text as a WAVE file under the type an unaware writer would declare."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), as_wav(F.col(text_col).cast("string")).alias("media"), F.lit("text/plain").alias("declared_type"))


def _samples(blob: bytes, kind: str) -> tuple:
    form = (len(blob), hashlib.sha256(blob).hexdigest())
    if kind != "audio/wav":
        return (None,) * 4 + form + (kind,)
    parts = {name: (s, e) for name, s, e in riff_chunks(blob, 0, len(blob))}
    _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", blob, parts[b"fmt "][0])
    data = blob[slice(*parts[b"data"])]
    told = parts.get(b"tlen", (0, 0))
    n = struct.unpack_from("<Q", blob, told[0])[0] if told[1] - told[0] >= 8 else len(data)
    centred = np.frombuffer(data, np.uint8).astype(np.int64) - 128
    power, peak = int(np.dot(centred, centred)), int(np.abs(centred).max(initial=0))
    crossings = int(np.count_nonzero((centred[1:] < 0) != (centred[:-1] < 0)))
    feature = f"{kind};{rate}Hz;{channels}ch;{bits}bit;sum={int(centred.sum())};power={power};peak={peak};crossings={crossings}"
    return n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), *form, feature


#: What the stored texts read back as. A blob that is not one whole WAVE file has null payload columns.
SAMPLES = Features(
    ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"),
    ("long", "long", "string", "long", "long", "string", "string"),
    _samples,
)
