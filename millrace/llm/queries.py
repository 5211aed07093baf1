"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, lm, omh, packing, quality, sharding, substring, url_reputation, warc
from .runtime import read_table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = tokenizer_path("byte_bpe_50k.tiktoken")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_turns(turns, tokenizer), tokenizer).drop("n_tokens", "loss_tokens")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels")
    return url_reputation.judge(pages, url_reputation.outcomes_from_labels(pages, labels))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=2048)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents"), (1.0,) * 8)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove(read_table(spark, sf_dir, "documents"), window=20, digest=True)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, quality.fit(docs))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.classes(read_table(spark, sf_dir, "documents"), k=5, threshold=0.8).select("doc_id", "class_id", "class_size")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read(warc.write(read_table(spark, sf_dir, "pages"), warc.fresh_directory(spark)))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_url_filter, op3_best_fit_packing, op4_decontaminate, op5_lm_score, op6_shard, op7_substring_dedup, op8_quality_rules, op9_near_duplicates, op10_warc)}
