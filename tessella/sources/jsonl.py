"""Line-delimited JSON: a validated scan with the rejected lines, and an appending sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def scan(spark: SparkSession, path: str, schema: T.StructType | str, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): rows of the schema for which valid holds, and the text of the others with the reason.

    Blank lines are neither. Lines are read as text, so a reject can be shown as it was written."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    broken = F.col(f"r.{CORRUPT}").isNotNull() | F.col("r").isNull()
    flat = parsed.select("value", broken.alias("broken"), "r.*")
    ok = ~F.col("broken") & F.coalesce(valid, F.lit(False))
    rejects = flat.where(~ok).select(F.col("value").alias("line"), F.when(F.col("broken"), "not JSON").otherwise("not valid").alias("reason"))
    return flat.where(ok).select(*[f.name for f in schema.fields]), rejects


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
