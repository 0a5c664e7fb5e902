"""Tables: reading the driver's Parquet, and intermediate tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to four tasks for each core, however few its bytes: for joins that make far more rows than they read."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; where it is unset (tests) an own folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
    return sc.getCheckpointDir().rstrip("/")


#: Paths in the shared folder that this process has given out.
_GIVEN: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    _GIVEN.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _GIVEN[-1]


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes what has been written to the paths given out so far, or since so many of them. Results that still have to be
    read must not need it."""
    sc = spark.sparkContext
    while len(_GIVEN) > since:
        path = sc._jvm.org.apache.hadoop.fs.Path(_GIVEN.pop())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what is stored inside, so that a long application doesn't fill the shared folder: for a job that
    writes its result to a place of its own."""
    before = len(_GIVEN)
    try:
        yield
    finally:
        release(spark, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back: cuts the lineage, and outlives a lost executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
