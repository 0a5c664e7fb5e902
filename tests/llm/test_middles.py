"""Fill-in-the-middle against the units' pattern."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import middles, queries

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in middles.MARKS) or h[2] % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text, text
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(units), form, len(prefix), len(middle), out, text


def texts():
    rng = random.Random(5)
    out = [None, "", " ", "a", " a", "a ", "<P>", "x <S>", "<", "<P", "a <P b> <S", "<<S>", "<P<M>", "é ü\n\tß <M", "x" * 5000, " " * 5000, "a\x1cb\x85c　d e"]
    return out + ["".join(rng.choice("ab <>PSMé\n🙂") for _ in range(rng.randint(0, 3000))) for _ in range(150)] + ["one two\n" * 3000]


@pytest.mark.parametrize("giant", [1 << 16, 700, 1])
def test_fill_in_middle(spark, giant):
    rows = [(None if k % 50 == 0 else k % 120, t, "x", 1) for k, t in enumerate(texts()) if giant > 1 or len(t or "") < 400]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, n long").repartition(3)
    got = middles.fill_in_middle(df, giant=giant)
    got = got.withColumn("restored", middles.restored(F.col("output"), F.col("form")))
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(brute(i, t) for i, t, _, _ in rows)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert middles.fill_in_middle(df).collect() == []


def test_summaries_compose_in_any_grouping():
    rng = random.Random(2)
    data = np.frombuffer("".join(rng.choice("a <>PSM ") for _ in range(3000)).encode(), np.uint8)
    chars = middles.first_bytes(data)
    whole = middles.summarised(data, np.array([0]), np.array([3000]), chars)
    for size in (1, 7, 100, 2999):
        starts = np.arange(0, 3000, size)
        each = middles.summarised(data, starts, np.minimum(size, 3000 - starts), chars)
        last = each.running(np.arange(len(starts))).at(np.array([len(starts) - 1]))
        for name in ("follows", "ends", "hits", "chars"):
            assert (getattr(last, name) == getattr(whole, name)).all(), (size, name)


def test_query(spark, small_dir):
    out = queries.op13_middles(spark, small_dir)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()
    want = collections.Counter((i, n, f, p, m, sha(o), sha(t)) for i, n, f, p, m, o, t in (brute(*r) for r in rows))
    assert collections.Counter(tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")) for r in out.collect()) == want
    assert len({r.form for r in out.select("form").distinct().collect()}) == 3
