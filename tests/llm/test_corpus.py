"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties, repeated rows and names
that clash with what the operators make, and on an empty table."""

import collections
import hashlib
import json
import math
import random
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import bayes, chat, media, mixing, packing, pieces, queries, rules, sharding, simhash, substrings
from tessella.llm.common import indexed, keyed, stored
from tessella.llm.queries import tokenizer_file

DOCS = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))]
    + [T.StructField(n, T.StringType()) for n in ("size", "row_key", "words", "h", "kept", "media_type", "fp", "node", "rest", "stratum", "target", "taken")]
)
EXTRA = ("x",) * 12


def sentence(rng, n):
    return " ".join(rng.choice("the of and a tion er anble, thst. On é世 <|end|> ### \\c1;".split(" ")) + str(rng.randint(0, 30)) for _ in range(n))


def edge_rows(unique: bool):
    rng = random.Random(5)
    passage, line = sentence(rng, 60), sentence(rng, 7)
    texts = [None, "", "   \n\t ", "one", "a b c", passage, passage, sentence(rng, 30) + " " + passage + "\n" + sentence(rng, 25), "x " * 300, "ab cd " * 40]
    texts += [sentence(rng, 5000), ("W" * 4000) + " tail", "\n".join([line] * 30), line.upper() + "!! ###", "z" * 9, sentence(rng, 19), sentence(rng, 20)]
    texts += [sentence(rng, rng.randint(1, 120)) for _ in range(40)]
    changed = texts[-1].split()
    texts += [" ".join(changed), " ".join(["new", *changed[1:]]), passage.replace(" ", "\x0b"), passage + "\x1c" + passage, "<|endoftext|> ok", "  ▁ x\r\ny"]
    rows = [(k, t, ("en", "de", None)[k % 3], ("s1", "s2", None, "t")[k % 4], len(t or "")) for k, t in enumerate(texts)]
    rows = [*rows[20:], *rows[:20]]
    if not unique:
        rows += [rows[3], rows[3], (None, passage, None, None, None), (None, None, "en", "s1", 0), (7, "seven again", "en", "s1", 1), rows[30]]
    return [(*r, *EXTRA) for r in rows]


@pytest.fixture(scope="module", params=["unique", "repeated", "empty"])
def docs(spark, request):
    rows = [] if request.param == "empty" else edge_rows(request.param == "unique")
    return spark.createDataFrame(rows, DOCS).repartition(3), rows


def word_list(text):
    return (text or "").encode().split()


def same_rows(df, want):
    assert collections.Counter(map(tuple, df.collect())) == collections.Counter(want)


def test_media(docs):
    df, rows = docs
    want = []
    for r in rows:
        raw = (r[1] or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        want.append((r[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    got = media.sniff(media.store_texts(df), features=media.SAMPLES)
    same_rows(got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"), want)
    assert got.where("media_type <> 'audio/wav' or media_bytes <= payload_bytes").count() == 0


def png(size=1):
    import struct

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", size, size, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0" * size)) + chunk(b"IEND", b"")


def test_sniffing_corrects_and_carves(spark):
    import gzip
    import io
    import wave
    import zipfile

    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("a.txt", "hello")
    gif = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
    broken = bytearray(png())
    broken[20] ^= 1
    wav = bytes(spark.range(1).select(media.as_wav(F.lit("text with GIF89a and BM in it"))).first()[0])
    assert wave.open(io.BytesIO(wav)).readframes(999).rstrip(b" ") == b"text with GIF89a and BM in it"
    rows = [
        (1, png(), "image/jpeg"), (2, b"junk" + png() + b"mid" + gif + b"end", None), (3, bytes(broken), "image/png"), (4, wav, None), (5, None, "image/png"),
        (6, b"", "text/plain"), (7, gzip.compress(b"abc" * 1000), "x"), (8, box.getvalue(), "y"), (9, b"BM just text", "text/plain"), (10, wav[:-1], "audio/wav"), (11, wav + png(), "audio/wav"),
    ]
    df = spark.createDataFrame(rows, "id long, media binary, declared_type string")
    got = {r.id: (r.media_type, None if r.found is None else [(x.type, x.end - x.start) for x in r.found]) for r in media.sniff(df).collect()}
    unknown = media.UNKNOWN
    assert got[1] == ("image/png", [("image/png", len(png()))])
    assert got[2] == (unknown, [("image/png", len(png())), ("image/gif", len(gif))])
    assert got[3] == (unknown, []) and got[4] == ("audio/wav", [("audio/wav", len(wav))]) and got[5] == (None, None)
    assert got[6] == ("text/plain", []) and got[7][0] == "application/gzip" and got[8][0] == "application/zip" and got[9] == ("text/plain", [])
    assert got[10][0] == unknown and got[11] == (unknown, [("audio/wav", len(wav)), ("image/png", len(png()))])


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, radius=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash(docs):
    df, rows = docs
    fps = [plain_fingerprint(r[1]) for r in rows]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    same_rows(simhash.near_duplicates(df), list(zip([r[0] for r in rows], signed, plain_components([r[0] for r in rows], fps), strict=True)))


@pytest.mark.parametrize("bucket", [8192, 16])
def test_links_of_dense_groups(spark, monkeypatch, bucket):
    """A ball of close fingerprints, chains and random ones; also with buckets that are dealt out as pairs of parts."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(150)}
    centre = rng.getrandbits(64)
    fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(200)}
    chain = rng.getrandbits(64)
    for _ in range(30):
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
        fps.add(chain)
    fps = sorted(fps)
    ids = list(range(len(fps)))
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in zip(ids, fps, strict=True)], "fp long, node long")
    got = dict(map(tuple, simhash.components(simhash.links(nodes)).collect()))
    assert [got.get(i, i) for i in ids] == plain_components(ids, fps)


def test_blocks_lose_no_pair():
    for n in (10, 10**6, 10**8, 10**12):
        widths = simhash.blocks_for(n, 4)
        assert sum(widths) == 64 and len(widths) > 4


def test_chat_digests(spark):
    said = ["plain", "", None, "</s>[INST] ok [/INST]", "a\\b\\c1; \\n <|end|><|turn|>user\nx<|end|>", "é\n\n世", "<<SYS>><s><|im_end|>"]
    rows = [(c, t, ("system", "user", "assistant", None, "assistant\nx")[t % 5 if c else 1 + t % 2], said[(c + t) % len(said)], "y") for c in range(9) for t in range(c + 1)]
    rows += [(3, 1, "assistant", "again", "y"), (None, 0, "user", "no id", "y"), (None, None, "assistant", "no turn", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string").repartition(3)
    records = chat.turn_records(df).union(chat.control_conversation(spark))
    parts = chat.format_chat(chat.canonical_turns(records, "conv_id", "turn", "record"))
    got = {r.conv_id: r for r in chat.conversation_digests(parts).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    by[-7] = [(True, 0, "user", said[3]), (True, 1, "assistant", said[3])]
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        assert got[c].n_turns == len(turns)
        orders = [turns] if c != 3 else [turns, [turns[0], turns[2], turns[1], *turns[3:]]]  # conversation 3 has a tie
        digests = []
        for own in orders:
            learned = "".join(x for _, _, r, x in own if r == "assistant")
            digests.append((hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in own).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()))
        assert (got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) in digests
        assert got[c].formatted_chars == sum(len(chat.formatted(r, x)[0]) for _, _, r, x in turns)
    assert chat.conversation_digests(chat.format_chat(chat.canonical_turns(records.limit(0), "conv_id", "turn", "record"))).count() == 0


def test_chat_layouts(spark):
    layouts = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "name": "n"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 3},
        {"instruction": "q", "input": "", "output": "a"}, {"instruction": "q", "output": "a", "extra": {"deep": [1]}},
        {"prompt": "q", "response": "a"}, {"prompt": "q", "completion": "a"}, {"question": "q", "answer": "a"},
    ]
    rows = [(k, 0, json.dumps(x)) for k, x in enumerate(layouts)] + [(90, 0, "not json"), (91, 0, None), (92, 0, '{"foo": 1}'), (93, 0, "[1]")]
    df = spark.createDataFrame(rows, "c long, o long, r string")
    got = collections.defaultdict(list)
    for r in chat.canonical_turns(df, "c", "o", "r").orderBy("conv_id", "step").collect():
        got[r.conv_id].append((r.role, r.text, r.layout))
    for k in range(len(layouts)):
        assert [x[:2] for x in got[k]] == [("user", "q"), ("assistant", "a")], k
    assert all(got[k] == [(None, None, None)] for k in (90, 91, 92, 93))
    assert chat.schema_fingerprint(layouts[0]) != chat.schema_fingerprint(layouts[1])
    assert chat.schema_fingerprint({"a": 1, "b": "x"}) == chat.schema_fingerprint({"b": 2, "a": None})


@pytest.mark.parametrize("n_shards", [40, 3])
def test_sharding(docs, n_shards):
    df, rows = docs
    got = sharding.shard(df, n_shards).collect()
    want = [(r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows]
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == collections.Counter(want)
    slots = collections.defaultdict(list)
    for r in got:
        assert 0 <= r.shard < n_shards
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    fair = sum(w[1] for w in want) / n_shards if want else 0
    groups = collections.defaultdict(set)
    for r in got:
        groups[(r.text_crc32, r["size"])].add(r.shard)
    sums = collections.Counter()
    for r in want:
        sums[(r[2], r[1])] += r[1]
    assert all(len(s) == 1 for g, s in groups.items() if sums[g] <= fair)


def test_shards_are_near_equal(spark):
    rng = random.Random(1)
    rows = [(k, "w" * rng.randint(0, 3000)) for k in range(4000)] + [(k, "hot " * 200) for k in range(4000, 6000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 40).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r.b for r in got]
    assert len(sizes) == 40 and max(sizes) <= 1.02 * min(sizes)


def test_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(30):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(1, 80))]
        free, want = [], {}
        for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            fit = [(left, b) for b, left in enumerate(free) if left >= sizes[k]]
            at = min(fit)[1] if fit else len(free)
            free += [] if fit else [60]
            free[at] -= sizes[k]
            want[k] = at
        runs = sorted(collections.Counter(sizes).items())
        placed = dict(zip((x for x, _ in runs), sharding.best_fit_decreasing(runs, 60), strict=True))
        own = {x: [b for b, n in bins for _ in range(n)] for x, bins in placed.items()}
        order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
        assert [own[sizes[k]].pop(0) for k in order] == [want[k] for k in order]


def test_size_classes(spark):
    sizes = [1, 17, sharding.EXACT, sharding.EXACT + 1, 10**6 + 3, 2**31 + 5, 10**13 + 7]
    got = [r.c for r in spark.createDataFrame([(k,) for k in sizes], "size long").select(sharding.size_class(F.col("size")).alias("c")).collect()]
    assert got[:3] == sizes[:3] and all(s <= c <= s * (1 + 2**-15) for s, c in zip(sizes, got, strict=True))


def test_shards_split_a_hot_text_of_null_ids(spark):
    rows = [(None, "hot text of many words")] * 3000 + [(k, f"text {k}") for k in range(300)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 8)
    sizes = [r.b for r in got.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) <= 1.1 * min(sizes)
    assert got.groupBy("shard", "slot").count().where("count > 1").count() == 0


def test_sainte_lague():
    rng = random.Random(4)
    for _ in range(60):
        shares = [rng.choice([0.0, rng.random(), 5.0, 1e-9]) for _ in range(rng.randint(1, 12))]
        most = [rng.randint(0, 60) for _ in shares]
        seats = rng.randint(0, 80)
        want = [0] * len(shares)
        for _ in range(seats):
            open_ = [(-x / (2 * want[k] + 1), k) for k, x in enumerate(shares) if x > 0 and want[k] < most[k]]
            if not open_:
                break
            want[min(open_)[1]] += 1
        assert mixing.sainte_lague(shares, seats, most) == want


def test_apportionment_of_a_table(spark):
    rng = random.Random(14)
    for n, seats in ((1, 7), (40, 500), (300, 90), (25, 10_000), (5, 0)):
        x = [rng.choice([0.0, rng.random() * 100, 7.0]) for _ in range(n)]
        most = [rng.randint(0, 60) for _ in range(n)]
        shares = spark.createDataFrame(list(zip(range(n), x, most, strict=True)), "k long, x double, most long").repartition(3)
        got = {r.k: r.seats for r in mixing.apportioned(shares, seats).collect()}
        assert [got[k] for k in range(n)] == mixing.sainte_lague(x, seats, most)


def test_indexed(spark):
    values = [(k * 7919) % 1000 for k in range(1000)] + [5, 5, None]
    rows = indexed(spark.createDataFrame([(v,) for v in values], "v long"), [F.col("v").asc_nulls_last()], "at").collect()
    assert [r.v for r in sorted(rows, key=lambda r: r["at"])] == sorted(values, key=lambda v: (v is None, v or 0))
    assert sorted(r["at"] for r in rows) == list(range(len(values)))


def test_mixing(docs):
    df, rows = docs
    sized = stored(mixing.sized(df), "sizes")
    got = mixing.mix(sized).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert collections.Counter((r.doc_id, r["size"]) for r in got) == collections.Counter((r[0], len(word_list(r[1]))) for r in rows)
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(word_list(r[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    left, want, open_ = float(sum(size.values())), {}, {s: 1 + k % 3 for k, s in enumerate(order)}
    while open_:
        level = left / sum(open_.values())
        full = [s for s, w in open_.items() if w * level > 3 * size[s]]
        for s in full:
            want[s] = 3.0 * size[s]
            left -= want[s]
            del open_[s]
        if not full:
            want |= {s: w * level for s, w in open_.items()}
            break
    taken = collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] + 2 for s in want)
    again = mixing.mix(sized.repartition(2)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, got))
    pieces_ = mixing.mixed_texts(df)
    found = pieces_.collect()
    assert sum(len(word_list(r.text)) for r in found) == sum(taken.values())
    assert pieces_.columns == df.columns and all(r["size"] == "x" and r.target == "x" and r.n_chars == len(r.text) for r in found)
    whole = collections.Counter(r[1] for r in rows)
    assert all(r.text in whole or any(r.text in (t or "") for t in whole) for r in found)


def test_packing(docs):
    from tokenizers import Tokenizer

    df, rows = docs
    path = tokenizer_file("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    files = packing.write_files(df, path, 1)
    ids = [[*own.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows]
    got = sorted(map(tuple, packing.read_digests(files).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert collections.Counter(g[1:] for g in got) == collections.Counter((r[0], len(x), crc(x)) for r, x in zip(rows, ids, strict=True))
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    assert [g[1] for g in got] == sorted((g[1] for g in got), key=lambda d: (d is not None, d or 0))
    if rows:
        assert [list(r.ids) for r in packing.read_documents(files, [41]).collect()] == [ids[[r[0] for r in rows].index(41)]]


@pytest.mark.parametrize("bits", [1, 5, 8, 15, 16, 17, 31, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 999, dtype=np.uint64).astype(np.uint32)
    data = packing.pack(ids, bits)
    assert len(data) == -(-999 * bits // 8)
    assert (packing.unpack(data, bits, 0, 999) == ids).all() and (packing.unpack(data, bits, 77, 300) == ids[77:377]).all()


def test_word_ids_of_odd_texts(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    own, mine = Tokenizer.from_file(path), packing.WordIds(path)
    rng = random.Random(12)
    texts = ["ΑΣ Βς ΟΔΟΣ'S", "it's <|endoftext|> a<|startoftext|>b", "á b\xa0c d", "I'LL we'd. it's, x.. y., 5. a5,", "İ I", "Ǆ", "日本語。 テキスト", "<|ENDOFTEXT|> <|", "a.\u0301 b"]
    texts += ["".join(rng.choice("abE .,'\n\té世9<|> ") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    monkeypatch.setattr(packing, "REMEMBERED", 100)
    for k in range(0, len(texts), 40):
        part = texts[k : k + 40]
        for text, ids in zip(part, mine(part), strict=True):
            assert np.frombuffer(ids, mine.kind).tolist() == own.encode(text, add_special_tokens=False).ids, text


def test_blocks_of_odd_width(spark, monkeypatch):
    """A vocabulary whose ids end on no byte, and blocks smaller than the documents."""
    monkeypatch.setattr(packing, "BLOCK_IDS", 50)
    monkeypatch.setattr(packing, "SHARD_DOCS", 10)
    monkeypatch.setattr(packing, "bits_for", lambda n: 17)
    df = spark.createDataFrame([(k, f"word{k} " * (k % 9)) for k in range(60)], "doc_id long, text string").repartition(3)
    path = tokenizer_file("word_bpe_49k.json")
    files = packing.write_files(df, path, 1)
    assert files.select("shard").distinct().count() > 1 and files.count() > 5
    rows = packing.read_digests(files).orderBy("doc_id").collect()
    encode = packing.WordIds(path)
    for r in rows:
        ids = np.append(np.frombuffer(encode([f"word{r.doc_id} " * (r.doc_id % 9)])[0], encode.kind), 1).astype("<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def plain_repeats(texts, window=20):
    seen, out = set(), []
    for t in texts:
        w = word_list(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def test_substrings(docs):
    df, rows = docs
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want = [(r[0], n, g, hashlib.sha256(k).hexdigest()) for r, (n, g, k) in zip(ordered, plain_repeats([r[1] for r in ordered]), strict=True)]
    same_rows(substrings.remove_repeats(keyed(df), digest=True).select("doc_id", "n_words", "n_removed", "kept"), want)
    out = substrings.without_repeats(df)
    assert out.columns == df.columns
    kept = collections.Counter((r.doc_id, hashlib.sha256(b" ".join(word_list(r.text))).hexdigest()) for r in out.collect())
    assert kept == collections.Counter((w[0], w[3]) for w in want)


@pytest.mark.parametrize(("contexts", "sent"), [(512, 400_000), (512, 0), (1, 400_000), (40, 2000)])
def test_substrings_of_few_words(spark, monkeypatch, contexts, sent):
    """Few different words: many chance repeats, periods and overlaps; several batches and groups over their edges; with all
    that may be broadcast, with nothing broadcast, with nearly all anchors treated as hot ones, and with some of each."""
    monkeypatch.setattr(substrings, "CONTEXTS", contexts)
    monkeypatch.setattr(substrings, "BROADCAST_WORDS", sent)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 1000)
    rng = random.Random(8)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(15, 200))) for _ in range(60)]
    texts += [" ".join(["a"] * n) for n in (19, 20, 21, 100, 400)] + ["a b c " * 90, "b c a " * 70]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(300)) for _ in range(30)]
    for k in range(40):
        base = texts[rng.randint(67, 96)].split()
        at = rng.randint(0, 250)
        texts.append(" ".join([*base[:at], "new", *base[at + k % 3 :]]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = [(k, n, g, hashlib.sha256(x).hexdigest()) for k, (n, g, x) in enumerate(plain_repeats(texts))]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (before, "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            same_rows(substrings.remove_repeats(keyed(df), digest=True).select("doc_id", "n_words", "n_removed", "kept"), want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_suffix_automaton():
    rng = random.Random(6)
    text, shard = [], substrings.SuffixAutomaton()
    for _ in range(200):
        text.append(rng.choice("abc"))
        want = max(n for n in range(len(text) + 1) if n == 0 or any(text[i : i + n] == text[-n:] for i in range(len(text) - n)))
        assert shard.feed(text[-1]) == want


def test_shards_read_back():
    rng = random.Random(16)
    shard, segments = substrings.Shard(), []
    for k in range(30):
        segments.append((k // 3, 40 * (k % 3), [rng.choice([b"a", b"b", b"\xc3\xa9"]) for _ in range(rng.randint(5, 30))]))
        shard.add(*segments[-1])
    reader, window = substrings.Reader(shard.written()), 5
    first = {}
    for key, start, words in segments:
        for i in range(len(words) - window + 1):
            first.setdefault(tuple(words[i : i + window]), (key, start + i))
    for key, start, words in [*segments, (4, 7, [rng.choice([b"a", b"b", b"new"]) for _ in range(300)]), (99, 0, segments[3][2]), (99, 0, [b"new"] * 9)]:
        got = [False] * len(words)
        for a, n in reader.repeats(words, key, start, window):
            got[a : a + n] = [True] * n
        want = [tuple(words[i : i + window]) in first and first[tuple(words[i : i + window])] < (key, start + i) for i in range(len(words) - window + 1)]
        assert got[: len(want)] == want and not any(got[len(want) :])


def plain_features(text):
    w = [x.decode() for x in word_list(text)]
    lines = [x for x in (text or "").split("\n") if word_list(x)]
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count, hit = collections.Counter(runs), set()
    for i, r in enumerate(runs):
        if count[r] > 1:
            hit |= set(range(i, i + 8))
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), failed


def test_rules_base(docs, spark):
    df, rows = docs
    feats = rules.features(df)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    cut = rules.thresholds(feats, labels)
    assert cut.count() == 0  # too few labels to be sure of anything
    got = rules.judge(feats, cut)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    same_rows(got.select(*names), [(r[0], *plain_features(r[1])) for r in rows])
    assert got.where("kept = base_failed").count() == 0


def test_binomial_tail(spark):
    from math import comb, isclose, log

    cases = [(10, 0, 0.3), (10, 2, 0.3), (500, 3, 0.02), (2000, 0, 0.005), (3000, 9, 0.005)]
    for n, k, p in cases:
        got = spark.range(1).select(rules.log_binomial_tail(F.lit(n), F.lit(k).cast("long"), p)).first()[0]
        assert isclose(got, log(sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))), rel_tol=1e-9)


def test_certified_thresholds(spark):
    """One stratum has enough labels and a clean cut, one a signal that good documents show too, one few labels."""
    rng = random.Random(9)
    rows, labels, k = [], [], 0
    for lang, n, noise in (("en", 3000, 0.0), ("fr", 3000, 0.05), ("de", 100, 0.0)):
        for _ in range(n):
            bad = rng.random() < 0.2
            odd = bad or rng.random() < noise
            rows.append((k, " ".join(f"w{rng.randint(0, 9**9)}" + ("###" if odd else "") for _ in range(25)), lang))
            labels.append((k, int(not bad), 0))
            k += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    feats = rules.features(df).cache()
    cut = {(r.stratum, r.signal): r.cutoff for r in rules.thresholds(feats, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert set(cut) == {("en", "symbol_share")} and cut["en", "symbol_share"] in rules.GRID["symbol_share"]
    wide = spark.createDataFrame([(s, n, c) for (s, n), c in cut.items()], "stratum string, signal string, cutoff double")
    lost = rules.judge(feats, wide).where("not kept").groupBy("stratum").count().collect()
    assert [r.stratum for r in lost] == ["en"] and 500 < lost[0]["count"] < 700


def test_pieces(docs):
    import sentencepiece

    df, rows = docs
    path = tokenizer_file("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    want = []
    for r in rows:
        ids = own.encode(r[1] or "")
        back = own.decode(ids).encode()
        assert back.decode() == (r[1] or "").replace("▁", " ")
        want.append((r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), len(back), hashlib.sha256(back).hexdigest(), back.decode() == (r[1] or "")))
    same_rows(pieces.encode_and_decode(df, path), want)


def test_pieces_of_odd_texts():
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    own, mine = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Encoder(path)
    rng = random.Random(11)
    texts = ["", " ", "   a", "a  ", "\n\n x \t y", "▁▁a ▁", "日本語 テキスト", "x" * 700, "ab" * 300 + " " + "c" * 97, "a\x00b", "😀 é́", "<s> </s> <0x0A>", " " * 40, "ﬁ​"]
    texts += ["".join(rng.choice("ab \n\tétion▁世x.,😀") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    for text, ids in zip(texts, mine(texts), strict=True):
        ids = np.frombuffer(ids, "<u4").tolist()
        assert ids == own.encode(text)
        assert pieces.decode(ids, mine.v).decode() == own.decode(ids)


def test_bayes_edges(docs, spark):
    df, rows = docs
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    got = bayes.classify(df, labels).collect()
    assert collections.Counter((r.doc_id, r.host, r.path) for r in got) == collections.Counter((r[0], r[3], r[2]) for r in rows)
    assert all(0 <= r.posterior <= 1 for r in got)


def test_bayes_held_out(spark, small_dir):
    base = small_dir.rsplit("/", 1)[0] + "/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    seen = labels.where("doc_id % 2 = 0")
    got = bayes.classify(docs, seen).join(labels.where("doc_id % 2 = 1"), "doc_id").select("kept", "quality").collect()
    right = sum(r.kept == bool(r.quality) for r in got) / len(got)
    prior = max(sum(r.quality for r in got), sum(1 - r.quality for r in got)) / len(got)
    assert right >= 0.95 and right > prior


def plain_posteriors(rows):
    """rows: (host, path, own log odds, evidence)."""
    n, overall = len(rows), sum(r[3] for r in rows) / len(rows)
    odds = lambda p: math.log(min(1 - 1e-9, max(1e-9, p)) / (1 - min(1 - 1e-9, max(1e-9, p))))

    def weight(sites):
        spread = sum(len(e) * (sum(e) / len(e) - p) ** 2 for e, p in sites)
        chance, within = sum(p * (1 - p) for _, p in sites), sum(len(e) * p * (1 - p) for e, p in sites)
        return min(bayes.WEIGHT_MOST, max(bayes.WEIGHT_LEAST, within / (spread - chance) - 1)) if spread > chance else bayes.WEIGHT_MOST

    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for host, path, _, e in rows:
        hosts[host].append(e)
        paths[host, path].append(e)
    host_w = weight([(e, overall) for e in hosts.values()])
    prior = {h: (sum(e) + host_w * overall) / (len(e) + host_w) for h, e in hosts.items()}
    path_w = weight([(e, prior[h]) for (h, _), e in paths.items()])
    out = []
    for host, path, own, e in rows:
        h = (sum(hosts[host]) - e + host_w * overall) / (len(hosts[host]) - 1 + host_w)
        p = (sum(paths[host, path]) - e + path_w * h) / (len(paths[host, path]) - 1 + path_w)
        out.append((h, p, 1 / (1 + math.exp(-(own + odds(p) - odds(overall))))))
    assert n == len(out)
    return out


def test_posteriors_by_hand(spark):
    rng = random.Random(8)
    rows = []
    for k in range(400):
        host = rng.choice(["a", "a", "a", "b", "c", bayes.NULL])
        path = rng.choice("xyz")
        own = rng.gauss({"a": 1.0, "b": -1.5}.get(host, 0.2), 1)
        rows.append((host, path, own, round(1 / (1 + math.exp(-own)), 9) if k % 3 else float(own > 0)))
    rows += [("alone", "x", 0.3, 1.0), ("alone", "x", 0.3, 1.0)]
    df = spark.createDataFrame([(k, h, p, o, round(e * bayes.UNIT)) for k, (h, p, o, e) in enumerate(rows)], "doc_id long, host string, path string, own double, e long").repartition(5)
    got = {r.doc_id: r for r in bayes.combined(df).collect()}
    for k, (h, p, post) in enumerate(plain_posteriors(rows)):
        assert abs(got[k].host_rate - h) < 2e-6 and abs(got[k].path_rate - p) < 2e-6 and abs(got[k].posterior - post) < 2e-6, k
        assert got[k].host == (None if rows[k][0] == bayes.NULL else rows[k][0])


def test_url_sites(spark):
    urls = ["http://A.example.com/fr/825?page=2", "https://u:p@m.example.net:8080/en/25#top", "https://x.org", "x.org/?q=/a", None]
    host, path = bayes.url_site(F.col("u"))
    got = [tuple(r) for r in spark.createDataFrame([(u,) for u in urls], "u string").select(host, path).collect()]
    assert got == [("a.example.com", "fr"), ("m.example.net", "en"), ("x.org", ""), ("x.org", ""), (None, "")]


def test_sparse_sites_shrink(spark):
    sites = {("big", "a"): (1000, 300), ("big", "b"): (2, 0), ("good", "a"): (1000, 900), ("rare", "a"): (2, 0)}
    rows = [(h, p, 0.0, bayes.UNIT if k < good else 0) for (h, p), (m, good) in sites.items() for k in range(m)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, host string, path string, own double, e long")
    got = {(r.host, r.path): r for r in bayes.combined(df).collect()}
    overall = 1200 / 2004
    assert abs(got["rare", "a"].host_rate - overall) < abs(got["big", "a"].host_rate - overall)
    assert got["good", "a"].host_rate > 0.85 and got["big", "a"].host_rate < 0.35
    assert 0.0 < got["big", "b"].path_rate < got["big", "b"].host_rate


def test_simhash_of_null_ids_alone(spark):
    """Fingerprints of null ids are linked, may join others, and a repeated id joins nothing."""
    base = " ".join(f"w{k}" for k in range(400))
    near = next(t for k in range(400) if (t := base.replace(f"w{k} ", f"n{k} ")) and 0 < (simhash.fingerprint(t) ^ simhash.fingerprint(base)).bit_count() <= 4)
    other = " ".join(f"v{k}" for k in range(50))
    rows = [(3, base), (None, near), (3, other), (5, other), (9, other + " z " * 40)]
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(3, 3), (None, 3), (5, 3), (9, 9)} == got
    rows = [(7, base), (None, near), (2, other), (7, other + " z " * 40)]
    got = collections.Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(7, 7): 2, (None, 7): 1, (2, 2): 1}


def test_chat_odd_records(spark):
    deep = "[" * 100_000 + "]" * 100_000
    rows = [
        (1, '{"prompt": "hi \\ud83d", "response": "a"}'), (2, '{"prompt": ' + deep + ', "response": "a"}'), (3, '{"messages[].role": 1, "messages[].content": 2}'),
        (4, '{"messages": [{"role": "user", "content": "q"}, "odd", 5]}'), (5, '{"messages": [{"role": "user", "content": [{"type": "text", "text": "q1"}, "q2"]}, {"role": "assistant", "content": "a"}]}'),
        (6, '{"messages": "x"}'), (7, '{"a\\ud83d": 1}'), (8, None),
    ]
    df = spark.createDataFrame([(c, 0, r) for c, r in rows], "c long, o long, r string")
    got = collections.defaultdict(list)
    for r in chat.canonical_turns(df, "c", "o", "r").orderBy("conv_id", "step").collect():
        got[r.conv_id].append((r.role, r.text, r.problem))
    assert got[1] == [("user", "hi \ufffd", None), ("assistant", "a", None)]
    assert got[2] == [(None, None, "nested too deep")] and got[3] == got[6] == got[7] == [(None, None, "no mapping")] and got[8] == [(None, None, "null")]
    assert got[4] == [("user", "q", None), (None, '"odd"', "no object in a list of turns"), (None, "5", "no object in a list of turns")]
    assert got[5] == [("user", "q1\nq2", None), ("assistant", "a", None)]
    assert {r.conv_id for r in chat.conversation_digests(chat.format_chat(chat.canonical_turns(df, "c", "o", "r"))).collect()} == {1, 4, 5}


def flac(n_frames, seed=3):
    """A stream whose frames have valid checksums (their content is noise)."""
    rng = random.Random(seed)
    out = b"fLaC" + bytes([0x80, 0, 0, 34]) + bytes(34)
    for k in range(n_frames):
        head = bytes([0xFF, 0xF8, 0x19, 0x08, k])
        crc = 0
        for x in head:
            crc = media._CRC8[crc ^ x]
        body = head + bytes([crc]) + bytes(rng.randrange(255) for _ in range(40))
        crc = 0
        for x in body:
            crc = (crc << 8 & 0xFFFF) ^ media._CRC16[crc >> 8 ^ x]
        out += body + crc.to_bytes(2, "big")
    return out


def test_more_formats_and_carving(spark):
    import struct

    whole, pdf = flac(3), b"%PDF-1.4 a startxref 9 %%EOF b startxref 20 %%EOF"
    chunk = lambda name, data: name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    riff = lambda kind, *chunks: b"RIFF" + struct.pack("<I", 4 + sum(map(len, chunks))) + kind + b"".join(chunks)
    box = lambda name, data: struct.pack(">I", 8 + len(data)) + name + data
    mp4 = box(b"ftyp", b"isom") + box(b"moov", b"x" * 9) + box(b"mdat", b"y" * 30)
    mp3 = b"ID3\4\0\0\0\0\0\5abcde" + 3 * (b"\xff\xfb\x90\0" + b"\1" * 413)
    webp, headless = riff(b"WEBP", chunk(b"VP8L", b"abc")), riff(b"WAVE", chunk(b"JUNK", b"1234"), chunk(b"data", b"12"))
    short = riff(b"WAVE", chunk(b"fmt ", struct.pack("<HHIIHH", 1, 1, 8000, 8000, 1, 8)), chunk(b"tlen", b"12"), chunk(b"data", b"12"))
    want = {1: [("audio/flac", whole), ("image/png", png())], 2: [("application/pdf", pdf), ("application/pdf", pdf)], 3: [("video/mp4", mp4)], 4: [("audio/mpeg", mp3)], 5: [("image/webp", webp)], 6: [], 7: [("audio/wav", short)]}
    blobs = {1: whole + png(), 2: pdf + b"--" + pdf + b" tail", 3: b"ab" + mp4 + b"tail", 4: mp3 + b"zz", 5: webp, 6: headless, 7: short}
    df = spark.createDataFrame([(k, bytearray(b), None) for k, b in blobs.items()], "id long, media binary, declared_type string")
    got = collections.defaultdict(list)
    for r in media.carve(df, keep=["id"]).orderBy("id", "place").collect():
        got[r.id].append((r.type, bytes(r.bytes)))
    assert {k: got[k] for k in want} == want
    read = {r.id: r for r in media.sniff(df, features=media.SAMPLES).collect()}
    assert read[7].n_bytes == 2 and read[6].n_bytes is None


def test_documents_of_one_id_fill_shards(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "SHARD_DOCS", 5)
    path = tokenizer_file("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    rows = [(7, f"word{k}") for k in range(100)] + [(None, f"none{k}") for k in range(40)] + [(k, f"other {k}") for k in range(20)]
    files = packing.write_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, 1)
    assert files.where("array_contains(doc_ids, 7)").select("shard").distinct().count() > 5
    digests = packing.read_digests(files).orderBy("start").collect()
    assert [r.doc_id for r in digests] == [None] * 40 + sorted(d for d, _ in rows if d is not None)
    got = collections.Counter(tuple(r.ids) for r in packing.read_documents(files, [7, 999]).collect())
    assert got == collections.Counter((*own.encode(t, add_special_tokens=False).ids, 1) for d, t in rows if d == 7)


def test_tokenizers_of_another_kind_get_whole_texts():
    assert packing.cuts_at_words(tokenizer_file("word_bpe_49k.json")) and not packing.cuts_at_words(tokenizer_file("byte_bpe_50k.json"))
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    ids = packing.word_ids(path)
    text = "Whole Texts,  and 世 too."
    assert np.frombuffer(ids([text])[0], ids.kind).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_suffix_array():
    rng = np.random.default_rng(4)
    for n, letters in ((0, 3), (1, 3), (5, 2), (300, 2), (2000, 4)):
        text = rng.integers(97, 97 + letters, n).astype(np.uint8)
        raw = text.tobytes()
        assert pieces.suffix_array(text, 64).tolist() == sorted(range(n), key=lambda k: (raw[k : k + 64], k))


def test_models_of_another_kind_are_refused():
    message = lambda n, data: bytes([n << 3 | 2, len(data)]) + data
    good = message(2, b"\x18\x02") + message(3, b"\x20\x00")
    pieces.check_model(good)
    for bad in (message(2, b"\x18\x01") + message(3, b"\x20\x00"), message(2, b"\x18\x02"), message(2, b"\x18\x02") + message(3, b"\x12\x01x\x20\x00")):
        with pytest.raises(ValueError):
            pieces.check_model(bad)


def test_pieces_of_long_chunks():

    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(21)
    texts = ["".join(rng.choice("abcdefghij0123") for _ in range(120)) for _ in range(400)]
    texts += ["".join(rng.choice("日本語中文字世界人大") for _ in range(500)) for _ in range(20)] + ["a" * 3000, "日" * 900, "x" * 97 + "\x00" + "y" * 30]
    began = time.process_time()
    got = pieces.Encoder(path)(texts)
    assert time.process_time() - began < 20
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode(text), text[:40]


def test_queries_run_their_operators(spark, tmp_path, docs):
    """The registered forms, on tables with repeated rows and nulls: columns and one row for each row."""
    df, rows = docs
    folder = str(tmp_path)
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, 0, "user", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    made = {n: f(spark, folder) for n, f in queries.queries().items() if n not in ("op3_chat", "op11_whitening", "op12_extraction")}
    for name, out in made.items():
        assert collections.Counter(r.doc_id for r in out.select("doc_id").collect()) == collections.Counter(r[0] for r in rows), name
    ids, fps = [r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows]
    want = collections.Counter(zip(ids, (f"{x:016x}" for x in fps), plain_components(ids, fps), strict=True))
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in made["op2_simhash"].collect()) == want
    placed = made["op4_sharding"].collect()
    assert {(r.law, r.grown_shard) for r in placed} <= {("bytes", None)}
    assert queries.op3_chat(spark, folder).count() == 2


def stored_archive(files):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as f:
        for name, data in files:
            f.writestr(name, data)
    return out.getvalue()


@pytest.mark.parametrize("inside", range(7))
def test_archives_in_archives_are_one_file(inside):
    inner = [stored_archive([(f"a{k}.txt", b"x" * 50)]) for k in range(inside)]
    whole = stored_archive([*((f"i{k}.zip", b) for k, b in enumerate(inner)), ("t", b"hello")])
    assert media.found_in(whole) == [("application/zip", 0, len(whole))]
    assert media.found_in(b"ab" + whole + b"--" + whole) == [("application/zip", 2, 2 + len(whole)), ("application/zip", 4 + len(whole), 4 + 2 * len(whole))]


def legal_patterns():
    import gzip
    import struct

    box = lambda name, data: struct.pack(">I", 8 + len(data)) + name + data
    whole = flac(3)
    riff = b"RIFF" + struct.pack("<I", 1000) + b"WAVEfmt " + struct.pack("<I", 16) + bytes(16)
    return {
        "ogg": b"OggS\0\0" + bytes(20) + b"\1\0", "boxes": box(b"ftyp", b"isom") + box(b"free", b"yy"), "heads": b"fLaC\x80\0\0\x22" + bytes(34), "flac": whole, "bodies": b"fLaC" + whole[4:60],
        "zip": stored_archive([("a", b"x" * 20)]), "ends": b"PK\3\4PK\5\6" + bytes(18), "gzip": b"\x1f\x8b\x08\0\0\0\0\0\0\3", "stored": b"\x1f\x8b\x08\0\0\0\0\0\0\3\0\xff\xff\0\0",
        "cut": gzip.compress(b"abc" * 100)[:-4], "riff": riff, "png": png()[:40], "gif": b"GIF89a\1\0\1\0\0\0\0!\xf9\4abcd", "jpeg": b"\xff\xd8\xff\xe0\0\4ab", "mp3": b"ID3\4\0\0\0\0\0\0\xff\xfb\x90\0",
    }


@pytest.mark.parametrize("name", legal_patterns())
def test_long_patterns_are_walked_once(name):
    """Work that grows with the square of the length would take minutes."""
    pattern = legal_patterns()[name]
    blob = pattern * (2_000_000 // len(pattern))
    began = time.process_time()
    found = media.found_in(blob)
    assert time.process_time() - began < 8
    assert len(found) == (len(blob) // len(pattern) if name in ("flac", "zip") else 0)


def test_checksums_of_long_parts():
    rng = random.Random(3)
    blob = rng.randbytes(200_000)
    for _ in range(50):
        a, b = sorted(rng.randrange(200_001) for _ in range(2))
        assert media.crc_of(blob, a, b) == zlib.crc32(blob[a:b])


def test_two_films_are_two_files():
    import struct

    box = lambda name, data: struct.pack(">I", 8 + len(data)) + name + data
    film = box(b"ftyp", b"isom") + box(b"moov", b"x" * 9)
    assert media.found_in(film + film) == [("video/mp4", 0, len(film)), ("video/mp4", len(film), 2 * len(film))]


@pytest.mark.parametrize("large", [[], [90_000], [90_000, 40_000, 90_000], [5000] * 45])
def test_shards_are_near_equal_beside_large_documents(spark, large):
    """Documents over the fair share have shards of their own, which leaves none empty and the others near equal."""
    rng = random.Random(6)
    texts = ["x" * n for n in large] + [sentence(rng, rng.randint(1, 60)) for _ in range(300)] + ["copied text " * 30] * 3
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = sharding.shard(df, 20).collect()
    assert len(got) == len(texts)
    held = collections.defaultdict(list)
    for r in got:
        held[r.shard].append(r.size)
    assert set(held) == set(range(20))
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(len(held[s]))) for s in held)
    total = sum(map(sum, held.values()))
    several = [sum(x) for x in held.values() if len(x) > 1 and max(x) * 20 <= total]
    if len(large) < 20:
        assert max(several) <= 1.1 * min(several)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_shards_of_the_tables_are_near_equal(spark, sf):
    held = collections.defaultdict(list)
    for r in queries.op4_sharding(spark, f"/root/testdata/{sf}").collect():
        held[r.shard].append(r.size)
    several = [sum(x) for x in held.values() if len(x) > 1]
    assert len(held) == 40 and max(several) <= 1.1 * min(several)


def test_packing_one_size_and_more_bins_than_items():
    for runs, n in (([(10, 3)], 5), ([(10, 5)], 5), ([(7, 100), (1, 50)], 8), ([(100, 1), (1, 3)], 3), ([(0, 4)], 2)):
        bins = collections.Counter()
        for (size, count), placed in zip(runs, sharding.pack_into(runs, n), strict=True):
            assert sum(k for _, k in placed) == count
            for b, k in placed:
                assert b < n
                bins[b] += size * k
        assert max(bins.values()) <= max(max(s for s, _ in runs), 1.1 * sum(s * c for s, c in runs) / n + 7)


def mixed(df):
    return collections.Counter(map(tuple, mixing.mix(stored(mixing.sized(df), "sizes")).select("doc_id", "source", "size", "source_size", "target", "taken").collect()))


def test_mix_of_many_sources_is_that_of_few(docs, monkeypatch):
    """The search over the table of sources gives what the driver's arithmetic does."""
    df, _ = docs
    few = mixed(df)
    monkeypatch.setattr(mixing, "SOURCES_MOST", 0)
    assert mixed(df) == few


@pytest.mark.parametrize("ids", ["null", "one", "own"])
def test_mix_deals_rows_of_one_id_to_parts(spark, monkeypatch, ids):
    """A hot source whose rows have one id, many of them one text: no part gets more than its share by far."""
    monkeypatch.setattr(mixing, "PART_WORDS", 500)
    rng = random.Random(9)
    texts = [sentence(rng, 12) if k % 3 else "the same text of eight words for all" for k in range(2000)]
    rows = [({"null": None, "one": 5, "own": k}[ids], t, "hot" if k % 10 else "cold") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    sizes = stored(mixing.sized(df), "sizes")
    dealt = mixing.dealt_by(sizes, 42)
    words = sum(len(word_list(t)) for t in texts)
    parts = dealt.groupBy(F.pmod("dealt", F.lit(20)).alias("p")).agg(F.sum("size").alias("n")).collect()
    assert len(parts) == 20 and max(r.n for r in parts) < 1.6 * words / 20
    assert dealt.select("source", "dealt").distinct().count() == len(rows)
    taken = collections.Counter()
    for (_, source, size, _, target, n), count in mixed(df).items():
        assert n <= 3 * size
        taken[source, target] += n * count
    assert all(abs(n - target) <= 0.01 * target + 2 for (_, target), n in taken.items())
    assert mixed(df.repartition(7)) == mixed(df)


def test_bayes_from_labels_to_posteriors(spark, small_dir):
    """End to end on the tables: a classifier that tells good from bad, and sites by plain sums over its results and labels."""
    docs, labels = (spark.read.parquet(f"{small_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = bayes.classify(docs, labels).collect()
    good = {}
    for r in labels.collect():
        if r.quality is not None:
            good[r.doc_id] = min(r.quality, good.get(r.doc_id, 1))
    logit = lambda p: math.log(p / (1 - p))
    rows = [(r.host, r.path, logit(min(max(r.doc_prob, 1e-9), 1 - 1e-9)), float(good.get(r.doc_id, r.doc_prob))) for r in got]
    for r, (host_rate, path_rate, posterior) in zip(got, plain_posteriors(rows), strict=True):
        assert abs(r.host_rate - host_rate) < 1e-4 and abs(r.path_rate - path_rate) < 1e-4 and abs(r.posterior - posterior) < 1e-3
        assert r.kept == (r.posterior >= bayes.KEEP) or abs(r.posterior - bayes.KEEP) < 1e-5
    known = [(r.doc_prob >= 0.5, good[r.doc_id] == 1) for r in got if r.doc_id in good]
    assert sum(a == b for a, b in known) / len(known) > 0.8


def test_bayes_of_pages_has_hosts_and_paths(spark, small_dir):
    from tessella.llm import extraction

    docs, labels, pages = (spark.read.parquet(f"{small_dir}/{t}.parquet") for t in ("documents", "labels", "pages"))
    texts = stored(extraction.extract(pages, extraction.PRIOR), "texts")
    got = bayes.classify_pages(texts, docs, labels).collect()
    urls = {r.page_id: r.url for r in pages.collect()}
    logit = lambda p: math.log(min(max(p, 1e-9), 1 - 1e-9) / (1 - min(max(p, 1e-9), 1 - 1e-9)))
    for r in got:
        parts = urls[r.doc_id].split("://")[1].split("?")[0].split("#")[0].split("/")
        assert (r.host, r.path) == (parts[0], parts[1] if len(parts) > 1 else "")
    assert len(got) == len(urls) and len({r.host for r in got}) > 10
    for r, (host_rate, path_rate, posterior) in zip(got, plain_posteriors([(r.host, r.path, logit(r.doc_prob), r.doc_prob) for r in got]), strict=True):
        assert abs(r.host_rate - host_rate) < 1e-3 and abs(r.path_rate - path_rate) < 1e-3 and abs(r.posterior - posterior) < 5e-3
    nothing = bayes.classify_pages(spark.createDataFrame([(1, None, None)], "page_id long, url string, text string"), docs, labels).first()
    assert (nothing.host, nothing.path) == (None, "") and nothing.posterior is not None
