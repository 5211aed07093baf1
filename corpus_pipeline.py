"""A training-corpus pipeline of five stages; part of subpackage llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, omh, packing, quality, substring
from millrace.llm.queries import tokenizer_path
from millrace.llm.runtime import read_table, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or whose posterior is below one half go."""
    return quality.judge(docs, quality.fit(docs), only_kept=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays."""
    return omh.keep_one(docs, k=5, threshold=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated windows of 20 words go, all but the first; a document keeps its row even if nothing of it is left."""
    return substring.remove(docs, window=20).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    # Rows that share an id, or have none, are told apart by their text.
    mark = F.struct(F.col("doc_id"), F.xxhash64("text").alias("tie"))
    found = decontaminate.decontaminate(docs.select(mark.alias("doc"), "text"), read_table(spark, sf_dir, "benchmark"), window=10, key="doc")
    hit = found.where("contaminated").select(F.col("doc_id.doc_id").alias("__hit"), F.col("doc_id.tie").alias("__tie")).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("__hit")) & (F.xxhash64("text") == F.col("__tie")), "left_anti")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("substring dedup", substring_dedup),
    ("decontamination", benchmark_decontamination),
    ("packing", best_fit_packing),
]

#: The stages learn by expectation-maximisation, align texts and call a tokenizer: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Tables between them go to the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
