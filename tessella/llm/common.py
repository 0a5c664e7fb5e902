"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import fresh_path

#: The white space of the word pattern [^\x20\x09-\x0D]+, as a Java character class.
SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACES = r"[^\x20\x09-\x0D]+"

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)

#: Rows of a narrow table that is sent to all tasks at most; a larger one is joined by a shuffle.
BROADCAST = 200_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to a table in the shared folder and read from there; cuts the lineage."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, doc_id, text, rest): row_key is unique and in the order of doc_id (nulls first), then text; rest is a
    struct of the whole row, so that no name clashes.

    row_key is doc_id itself where that is unique and never null, the usual case, for which a look at the id column is
    enough. Otherwise the rows are numbered after a range sort; rows that agree in both get numbers in any order."""
    own = F.col(id_col).cast("long").alias("doc_id")
    narrow = docs.select(own, F.col(text_col).cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest"))
    odd = docs.select(own).groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count()
    if not odd:
        return narrow.select(F.col("doc_id").alias("row_key"), "*")
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ranged.select(F.monotonically_increasing_id().alias("row_key"), "*"), "keyed")


def indexed(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its rows' places in the order, from 0, as a column of that name. Only the counts of range partitions come to
    the driver."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    ranged = stored(ranged, "indexed")
    part = F.shiftright(name, 33)
    counts = {r.part: r.n for r in ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, starts = 0, []
    for k in sorted(counts):
        starts.append(before - (k << 33))
        before += counts[k]
    if not starts:
        return ranged
    table = F.array(*map(F.lit, starts))
    at = F.array_position(F.array(*(F.lit(k).cast("long") for k in sorted(counts))), part.cast("long")).cast("int")
    return ranged.withColumn(name, F.col(name) + F.element_at(table, at))


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, sent to all tasks if it has few rows."""
    return F.broadcast(df) if rows <= BROADCAST else df


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many bytes in the column, or one row: bounds what numpy holds at once."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + limit, "right")))
        yield batch.slice(start, end - start)
        start = end


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (null: none) and, for each text and the end, where its words start."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    kept = np.concatenate(([0], np.cumsum(full)))
    return flat.filter(pa.array(full)), kept[at]


def gathered(held: list[bytes], place: np.ndarray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The numbers held for each place, one place's behind the other's, and where each place's start, and the end."""
    size = np.fromiter(map(len, held), np.int32, len(held)) // kind.itemsize
    count = size[place]
    ends = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
    wide = np.int32 if max(ends[-1], size.sum(dtype=np.int64)) < 1 << 31 else np.int64
    spot = np.repeat((np.cumsum(size, dtype=wide) - size)[place] - ends[:-1].astype(wide), count)
    spot += np.arange(len(spot), dtype=wide)
    return np.frombuffer(b"".join(held), kind)[spot], ends


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
