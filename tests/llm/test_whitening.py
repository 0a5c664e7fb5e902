"""Whitening against numpy in whole numbers."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from tessella.llm import queries, whitening

VECTORS = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("component", T.StringType()), T.StructField("x", T.StringType()), T.StructField("w1", T.StringType())]
)


def rows_of(n, dims, seed=3):
    rng = random.Random(seed)
    mix = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(dims)]
    out = []
    for k in range(n):
        base = [rng.gauss(0, 1 + 2 * j) for j in range(dims)]
        out.append((k, [3.0 + sum(m * b for m, b in zip(row, base, strict=True)) for row in mix], "c", "x", "w"))
    return out


def brute(rows, components=8):
    """Sums and deviations in whole numbers, the covariance in fractions."""
    dims = len(rows[0][1])
    grid = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in r[1]] for r in rows]
    n, sums = len(grid), [sum(x[j] for x in grid) for j in range(dims)]
    scatter = [[sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in grid) for j in range(dims)] for i in range(dims)]
    cov = np.array([[float(Fraction(s, n**3)) for s in row] for row in scatter])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    centred = np.array([[float(Fraction(n * x - s, n)) for x, s in zip(row, sums, strict=True)] for row in grid])
    white = centred @ vectors[:, :components] / np.sqrt(values[:components])
    deviations = [sum((n * x - s) ** 2 for x, s in zip(row, sums, strict=True)) for row in grid]
    return values, white, deviations


@pytest.mark.parametrize("dims", [2, 5, 11, 70])
def test_whitening(spark, dims):
    rows = rows_of(60 + 3 * dims, dims)
    bad = [(-1, None), (-2, [None] + [1.0] * (dims - 1)), (-3, [float("nan")] * dims), (-4, [float("-inf")] * dims), (-5, []), (-6, [0.5] * (dims + 1))]
    again = [(None, rows[0][1], "c", "x", "w"), rows[1], rows[1]]
    df = spark.createDataFrame([*rows, *again, *((k, v, "c", "x", "w") for k, v in bad)], VECTORS).repartition(3)
    values, white, deviations = brute([*rows, *again])
    got = whitening.whiten(df).toPandas()
    count = min(8, dims)
    assert len(got) == (len(rows) + 3) * count and set(got.component) == set(range(1, count + 1))
    assert set(got.n) == {len(rows) + 3}
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    ids = np.array([r[0] if r[0] is not None else -9 for r in [*rows, *again]])
    for k in range(count):
        mine = got[got.component == k + 1].assign(vec_id=lambda d: d.vec_id.fillna(-9)).sort_values("vec_id", kind="stable")
        order = np.argsort(ids, kind="stable")
        want = white[order, k]
        a = mine.whitened.to_numpy()
        assert min(np.abs(a - want).max(), np.abs(a + want).max()) < 1e-7
        assert [int(d) for d in mine.deviation] == [deviations[i] for i in order]
        assert abs(mine.explained.iloc[0] - values[k] / values.sum()) < 1e-12


def test_large_offsets_lose_nothing(spark):
    """Entries far from zero with a spread of a few steps: products that aren't centred would keep no digit of it."""
    rng = random.Random(8)
    rows = [(k, [float(2**20 + rng.randint(0, 3)), float(2**21 - rng.randint(0, 5))], "", "", "") for k in range(200)]
    values, white, _ = brute(rows)
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).toPandas()
    assert got.identity_error[0] < 1e-9
    first = got[got.component == 1].sort_values("vec_id").whitened.to_numpy()
    assert min(np.abs(first - white[:, 0]).max(), np.abs(first + white[:, 0]).max()) < 1e-9
    assert np.allclose(got.groupby("component").eigenvalue.first(), values, rtol=1e-12)


def test_wide_values_keep_exact_deviations(spark):
    rows = [(k, [3.0e4 * k * k, -2.0e7 * k], "", "", "") for k in range(90)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).where("component = 1").toPandas().sort_values("vec_id")
    deviations = brute(rows)[2]
    assert [int(d) for d in got.deviation_exact] == deviations
    assert [None if math.isnan(d) else int(d) for d in got.deviation.astype(object)] == [d if d < 2**63 else None for d in deviations]
    assert max(deviations) > 2**63


def test_huge_entries_stop_at_the_limit(spark):
    rows = [(1, [3e38, 1.0], "", "", ""), (2, [-3e38, 2.0], "", "", ""), (3, [0.0, 3.0], "", "", "")]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS))
    assert got.count() == 6


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_nothing_to_whiten(spark, vectors):
    got = whitening.whiten(spark.createDataFrame([(k, v, "", "", "") for k, v in enumerate(vectors)], VECTORS)).collect()
    usable = sum(v is not None for v in vectors)
    assert len(got) == 2 * usable
    assert all(r.whitened is None and r.identity_error is None and r.explained is None and r.deviation == 0 for r in got)


def test_query(spark, small_dir):
    out = queries.op11_whitening(spark, small_dir)
    rows = out.toPandas()
    given = spark.read.parquet(f"{small_dir}/embeddings.parquet").count()
    assert len(rows) == 8 * given and rows.identity_error.max() < 1e-4
    assert {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"} <= set(out.columns)
