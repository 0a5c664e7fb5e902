"""The stages of the pipeline against plain Python, one by one and as a whole."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from test_corpus import DOCS, edge_rows, plain_features, plain_repeats, word_list

import corpus_pipeline
from tessella.llm import similar, simhash
from tessella.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, source string"


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def alike(x, y):
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def first_rows(rows):
    """Rows that are the first of their connected texts, in the order of doc_id (nulls first), then text."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    sets, label = [grams(r[1]) for r in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if label[a] != label[b] and alike(sets[a], sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    return sorted((r for k, r in enumerate(rows) if label[k] == k), key=repr)


def texts(seed):
    rng = random.Random(seed)
    made = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.choice([1, 4, 5, 12, 30, 80, 200]))) for _ in range(40)]
    line = " ".join(f"c{k}" for k in range(12))
    out = [None, "", " \n", "one", "One", *made]
    for text in made:
        words = text.split()
        for _ in range(3):
            changed = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                changed[rng.randrange(len(words))] = f"n{rng.randint(0, 9)}"
            out.append(" ".join(changed))
        out.append(line + " " + text)
    return out


@pytest.mark.parametrize("unique", [True, False])
@pytest.mark.parametrize("part", [similar.PART, 8])
def test_near_duplicates(spark, monkeypatch, unique, part):
    monkeypatch.setattr(similar, "PART", part)
    monkeypatch.setattr(similar, "FLUSH", 1000)
    rows = [(k if unique else (None if k % 17 == 0 else k % 50), t, f"s{k % 3}") for k, t in enumerate(texts(3))]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=repr)
    want = first_rows(rows)
    assert [r[:2] for r in got] == [r[:2] for r in want]


def loose_texts(n, seed=11):
    """Texts of one frame in which some words differ: all within the sketches' bounds of others, few similar."""
    rng = random.Random(seed)
    frame = [f"f{k}" for k in range(60)]
    out = []
    for _ in range(n):
        words = list(frame)
        for k in rng.sample(range(60), rng.choice((1, 2, 3))):
            words[k] = f"x{rng.randint(0, 30)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("n, part", [(400, 16), (150, 4)])
def test_a_loose_component_is_decided_in_small_groups(spark, monkeypatch, n, part):
    monkeypatch.setattr(similar, "PART", part)
    largest, meet = [], similar._meet

    def watched(rows, n_words):
        groups = rows.groupBy("component", "lo", "hi").count().agg({"count": "max"}).first()[0]
        largest.append(groups or 0)
        return meet(rows, n_words)

    monkeypatch.setattr(similar, "_meet", watched)
    rows = [(k, t, "s") for k, t in enumerate(loose_texts(n))]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=repr)
    assert got == first_rows(rows) and 1 < len(got) < n
    assert len(largest) >= 2 and max(largest) <= 2 * part + 4 * (2 * part) ** 0.5 + 4


def test_pairs_of_parts_bring_all_labels_together(spark, monkeypatch):
    monkeypatch.setattr(similar, "PART", 5)
    rows = [(7, k, 0 if k % 3 == 0 else k % 4, f"t{k}") for k in range(90)] + [(8, 100 + k, k, "t") for k in range(3)] + [(9, 200, 1, "t")]
    df = spark.createDataFrame(rows, "component long, sig long, label long, text string")
    met = collections.defaultdict(set)
    for r in similar._in_pairs(df).collect():
        met[r.component, r.lo, r.hi].add(r.sig)
    together = {(a, b) for group in met.values() for a in group for b in group}
    assert all((a[1], b[1]) in together for a in rows for b in rows if a[0] == b[0] and a[2] != b[2])
    assert max(map(len, met.values())) <= 24


def test_near_duplicates_of_nothing(spark):
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame([], SCHEMA), "").collect() == []


def test_copies_beyond_the_radius_of_op2_are_found(spark):
    words = [f"w{k}" for k in range(100)]
    for k in range(20):
        changed = [*words[: 5 * k], f"n{k}", *words[5 * k + 1 :]]
        a, b = " ".join(words), " ".join(changed)
        if (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 4:
            break
    else:
        raise AssertionError("no such copy")
    docs = spark.createDataFrame([(1, a, "s"), (2, b, "s")], SCHEMA)
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()] == [1]


def read(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))


@pytest.mark.parametrize("kind", ["unique", "repeated", "empty"])
def test_run(spark, tmp_path, kind):
    """Each stage on what the one before kept; nulls, ties, repeated rows, long texts and clashing names are in the rows."""
    import sentencepiece

    rows = [] if kind == "empty" else edge_rows(kind == "unique")
    folder = str(tmp_path)
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    def run(name):
        path = f"{folder}/{name}"
        stages[name](spark, docs, folder).write.parquet(path)
        return spark.read.parquet(path)

    # no stratum has labels enough for a certified cutoff, so only the base rules reject; a row's own text decides
    docs = run("quality_rules")
    kept = [r for r in rows if not plain_features(r[1])[5]]
    assert docs.columns == DOCS.names and read(docs) == sorted(kept, key=repr)
    docs = run("simhash_near_dedup")
    kept = first_rows(kept)
    assert docs.columns == DOCS.names and [r[:2] for r in read(docs)] == [r[:2] for r in kept]
    before = ordered([tuple(r) for r in docs.collect()])
    docs = run("substring_dedup")
    after = ordered([tuple(r) for r in docs.collect()])
    assert docs.columns == DOCS.names and len(after) == len(before)
    want = collections.Counter((r[0], *x[1:]) for r, x in zip(before, plain_repeats([r[1] for r in before]), strict=True))
    assert collections.Counter((r[0], k) for r, k in ((r, b" ".join(word_list(r[1]))) for r in after)) == collections.Counter((d, k) for d, _, k in want.elements())
    whole = {(r[1], r[4]) for r in before}
    assert all((r[1], r[4]) in whole or r[4] == len(r[1]) for r in after)
    size = collections.Counter()
    for r in after:
        size[r[3]] += len(word_list(r[1]))
    docs = run("mixing")
    mixed, taken, texts = [tuple(r) for r in docs.collect()], collections.Counter(), {r[1] for r in after}
    assert docs.columns == DOCS.names
    for r in mixed:
        taken[r[3]] += len(word_list(r[1]))
        assert r[1] in texts or any(r[1] in (t or "") for t in texts)
    total = sum(size.values())
    assert abs(sum(taken.values()) - total) <= 0.02 * total + 5 and all(taken[s] <= 3 * size[s] for s in taken)
    own = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    want = collections.Counter()
    for r in mixed:
        ids = own.encode(r[1] or "")
        back = own.decode(ids).encode()
        want[(r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), len(back), hashlib.sha256(back).hexdigest(), back == (r[1] or "").encode())] += 1
    assert collections.Counter(tuple(r) for r in run("sentencepiece").collect()) == want
    assert collections.Counter(tuple(r) for r in corpus_pipeline.run(spark, folder).collect()) == want
