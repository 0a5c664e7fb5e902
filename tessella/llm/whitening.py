"""Whitening of embeddings by the covariance of all of them.

A vector's entries become whole numbers on a grid, so that sums of them are exact in any order. One aggregation gives the
sums of every dimension, a second one the upper triangle of the scatter: for every pair of dimensions a cell (dimension,
block of OFFSETS distances to the other) x (distance), of which the distances are columns, each a generated SQL expression
that sums the products of entries centred before at the whole number next to their mean. What the mean is off that number is
taken out afterwards in whole numbers, so nothing cancels, and below 2**53 the sums are exact. Each task has one row for a
cell before the shuffle, so no vector, however common, weighs on one task, and the driver gets a table whose size depends on
the dimensions alone; LAPACK decomposes it there. A third aggregation measures the covariance of what came out.

Rows whose vector is null, empty, or holds a null, NaN or infinite entry are dropped, and so are those that have not the most
common number of dimensions among the others (of ties the larger number). Grid values stop at +-2**52. Repeated rows and ids
count each time; a null id stays null. Components whose eigenvalue is nothing beside the largest have no whitened values
(null) and aren't measured; if none is left, as with one row or equal rows, the error is null. An empty table gives an empty
result. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 1024, 100_000
LIMIT = 1 << 52
#: Low bits that are summed apart, so that neither part of a sum can overflow.
LOW = 24
#: Distances between the dimensions of a pair that are columns of one row; more take further rows.
OFFSETS = 64


@dataclass(frozen=True)
class Whitening:
    """What was fitted: n vectors, the sums of each dimension, eigenvalues from the largest on, unit eigenvectors in columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    bound: int  # of the squared deviations

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def mean(self) -> list[float]:
        return [s / self.n for s in self.sums]

    def rank(self) -> int:
        """Components that aren't nothing beside the first."""
        least = max(self.values.max(initial=0.0), 0.0) * self.dims * np.finfo(float).eps * 8
        return int((self.values > least).sum())


def fit_list(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors as doubles without those that can't be used."""
    v = F.col(vector_col).cast("array<double>")
    usable = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf")))  # NaN is above infinity
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & usable)
    sizes = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return rows.where(F.size("v") == (sizes.dims if sizes else 0))


def on_grid(rows: DataFrame) -> DataFrame:
    """(vec_id, x): the entries as whole numbers."""
    step = lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))) + OFFSET
    return rows.select("vec_id", F.transform("v", step).alias("x"))


def sums_of(grid: DataFrame) -> tuple[int, list[int], int]:
    """Vectors, the sums of each dimension, and the most that n times an entry is off its dimension's sum."""
    each = grid.select(F.posexplode("x").alias("j", "c")).groupBy("j")
    got = each.agg(F.count(F.lit(1)).alias("n"), F.expr(f"sum(shiftright(c, {LOW}))").alias("high"), F.expr(f"sum(c & {(1 << LOW) - 1})").alias("low"), F.min("c").alias("least"), F.max("c").alias("most")).collect()
    got.sort(key=lambda r: r.j)
    n, sums = got[0].n, [(r.high << LOW) + r.low for r in got]
    return n, sums, max(max(n * r.most - s, s - n * r.least) for r, s in zip(got, sums, strict=True))


def covariance(grid: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The covariance with divisor n, of the upper triangle's sums in one aggregation."""
    dims = len(sums)
    centre = [round(Fraction(s, n)) for s in sums]
    near = F.array(*(F.lit(c).cast("long") for c in centre))
    centred = grid.select(F.zip_with("x", near, lambda x, m: (x - m).cast("double")).alias("c"))
    blocks = F.explode(F.sequence(F.lit(0), F.lit((dims - 1) // OFFSETS))).alias("block")
    cells = centred.select("c", F.posexplode("c").alias("i", "ci")).select("c", "i", "ci", blocks)
    sums_at = [F.expr(f"sum(ci * get(c, i + {OFFSETS} * block + {k}))").alias(f"p{k}") for k in range(min(dims, OFFSETS))]
    out = np.zeros((dims, dims))
    for row in cells.groupBy("i", "block").agg(*sums_at).collect():
        for k, p in enumerate(row[2:]):
            if (j := row.i + OFFSETS * row.block + k) < dims:
                off = (sums[row.i] - n * centre[row.i]) * (sums[j] - n * centre[j])
                out[row.i, j] = out[j, row.i] = float((Fraction(p) - Fraction(off, n)) / n)
    return out


def fit(rows: DataFrame) -> Whitening | None:
    """The whitening of a fit list; None of an empty one."""
    first = rows.first()
    if first is None:
        return None
    dims = len(first.v)
    grid = on_grid(rows)
    n, sums, far = sums_of(grid)
    values, vectors = np.linalg.eigh(covariance(grid, n, sums))
    values, vectors = values[::-1], vectors[:, ::-1]
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(dims)]
    return Whitening(n, sums, values, vectors * np.where(lead < 0, -1.0, 1.0), dims * far * far)


def project(grid: DataFrame, fitted: Whitening, components: int) -> DataFrame:
    """(vec_id, deviation, w1, w2, ...): the exact sum of (n * x - sum) ** 2 over the dimensions (null beyond 38 digits) and
    the whitened values, null beyond the rank."""
    mean, n, sums = np.array(fitted.mean), fitted.n, fitted.sums
    known = min(components, fitted.rank())
    by = fitted.vectors[:, :known] / np.sqrt(fitted.values[:known])
    whole = fitted.bound < 1 << 63
    kind = pa.int64() if whole else pa.decimal128(38)
    schema = f"vec_id long, deviation {'long' if whole else 'decimal(38,0)'}, " + ", ".join(f"w{k + 1} double" for k in range(components))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(sums))
            if whole:
                far = pa.array((((n * x - np.array(sums)) ** 2).sum(axis=1)), kind)
            else:
                exact = (sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist())
                far = pa.array([Decimal(e) if e < 10**38 else None for e in exact], kind)
            white = (x - mean) @ by
            cols = [pa.array(white[:, k]) if k < known else pa.nulls(batch.num_rows, pa.float64()) for k in range(components)]
            yield pa.RecordBatch.from_arrays([batch.column(0), far, *cols], names=["vec_id", "deviation", *(f"w{k + 1}" for k in range(components))])

    return grid.mapInArrow(rows, schema)


def identity_error(whitened: DataFrame, rank: int) -> float | None:
    """Largest entry of the whitened values' covariance less the identity, without sign."""
    if not rank:
        return None
    pairs = [(a, b) for a in range(1, rank + 1) for b in range(a, rank + 1)]
    got = whitened.agg(*(F.covar_pop(f"w{a}", f"w{b}").alias(f"v{a}_{b}") for a, b in pairs)).first()
    return max(abs(v - (a == b)) for (a, b), v in zip(pairs, got, strict=True))


def whiten(df: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue, deviation_exact): a row for each
    vector of the fit list and component, from 1. deviation is null where a long can't hold it, deviation_exact is not."""
    rows = fit_list(df, id_col, vector_col)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double, deviation_exact decimal(38,0)"
    fitted = fit(rows)
    if fitted is None:
        return df.sparkSession.createDataFrame([], schema)
    components = min(components, fitted.dims)
    done = project(on_grid(rows), fitted, components)
    error = identity_error(done, min(components, fitted.rank()))
    total = float(fitted.values.sum())
    share = lambda k: F.lit(float(fitted.values[k]) / total if total > 0 else None).cast("double")
    made = [F.struct(F.lit(k + 1).alias("component"), F.col(f"w{k + 1}").alias("whitened"), share(k).alias("explained"), F.lit(float(fitted.values[k])).alias("eigenvalue")) for k in range(components)]
    long = done.select("vec_id", "deviation", F.explode(F.array(*made)).alias("c"))
    return long.select(
        "vec_id",
        "c.component",
        F.lit(fitted.n).cast("long").alias("n"),
        F.expr("try_cast(deviation as long)").alias("deviation"),
        "c.whitened",
        "c.explained",
        F.lit(error).cast("double").alias("identity_error"),
        "c.eigenvalue",
        F.col("deviation").cast("decimal(38,0)").alias("deviation_exact"),
    )
