"""One query for each operator, over its whole table, with the parameters used in production."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bayes, chat, extraction, media, middles, mixing, packing, pieces, rules, sharding, simhash, substrings, whitening
from .common import documents, keyed, stored
from .oracles import oracle_sql  # noqa: F401

#: Where the vocabulary files of the public tokenizers lie.
TOKENIZERS = os.environ.get("TESSELLA_TOKENIZERS", "")
END_ID = 1


def tokenizer_file(name: str) -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = media.sniff(media.store_texts(documents(spark, sf_dir)), keep=["doc_id"], features=media.SAMPLES)
    return done.select("doc_id", *media.SAMPLES.names, "media_type")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.turn_records(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    records = rows.union(chat.control_conversation(spark))
    return chat.conversation_digests(chat.format_chat(chat.canonical_turns(records, "conv_id", "turn", "record")))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(documents(spark, sf_dir), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = stored(mixing.sized(documents(spark, sf_dir)), "sizes")
    return mixing.mix(sizes).select("doc_id", "size", "source_size", "target", "taken")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.read_digests(packing.write_files(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), END_ID))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.remove_repeats(keyed(documents(spark, sf_dir).select("doc_id", "text")), digest=True)
    return done.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = stored(rules.features(documents(spark, sf_dir)), "features")
    judged = rules.judge(feats, rules.thresholds(feats, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_and_decode(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op10_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayes.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("deviation_exact")


def op12_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extraction.extract(pages, extraction.fit(pages))


def op13_middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = middles.fill_in_middle(documents(spark, sf_dir))
    restored = middles.restored(F.col("output"), F.col("form"))
    return done.withColumns({"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored, 256)}).drop("output")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_media, op2_simhash, op3_chat, op4_sharding, op5_mixing, op6_packing, op7_substrings, op8_rules, op9_pieces, op10_bayes, op11_whitening, op12_extraction, op13_middles)
    return {f.__name__: f for f in own}
