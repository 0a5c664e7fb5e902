"""A corpus pipeline of the operators in tessella.llm: quality rules, near-dedup (SimHash tiles of a wider radius than
op2's and an exact test of similarity, llm.similar), substring dedup, mixing sources to target weights, and SentencePiece
encoding and decoding. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import mixing, pieces, rules, similar, substrings
from tessella.llm.common import keyed, small, stored
from tessella.llm.queries import tokenizer_file

#: Not expressible in SQL; tests/llm/test_pipeline.py holds each stage and run() against plain Python.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Each row goes with its features, so that its verdict finds it without a join."""
    feats = stored(rules.features(docs, {"row": F.struct(*(F.col(f"`{c}`") for c in docs.columns))}), "features")
    judged = rules.judge(feats, rules.thresholds(feats.drop("row"), spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return judged.where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts connected by similarities >= 0.8 of their five-word shingles the document with the smallest doc_id; of
    rows that agree in it, one."""
    keys = keyed(docs)
    found = similar.near_copies(keys.select(F.col("row_key").alias("doc_id"), "text"))
    dropped = stored(found.where("doc_id <> first_id").select(F.col("doc_id").alias("row_key")), "dropped")
    return keys.join(small(dropped, dropped.count()), "row_key", "left_anti").select(*(F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that an earlier document, or the same one before, has."""
    return substrings.without_repeats(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What a mix to the weights takes: a row for each whole pass over a document and for each span taken of it."""
    return mixing.mixed_texts(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_and_decode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixing", mixed_sources),
    ("sentencepiece", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
