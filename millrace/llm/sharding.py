"""Sharding by weighted rendezvous hashing of a stable record key.

Every shard draws a number from the record's key and its own name; the shard with the best draw keeps the record. A new
shard can only win records for itself, so no record moves between old shards. Draws come from md5, so that the placement
can be recomputed by any system.

Nulls: a null key hashes as the empty key, so all null keys share one shard; a null text has size 1 and the CRC of the
empty text. Repeated rows (equal keys) share a shard and get slots of their own. An empty table gives an empty result.
Columns beyond the key and the text are not looked at; the result has only the columns named here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The draw has this many bits, so that it fits a double exactly.
DRAW_BITS = 52


def draw(key: Column, shard: int) -> Column:
    """Uniform in (0, 1) from the key and the shard's name."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{shard}"))), 1, DRAW_BITS // 4)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << DRAW_BITS)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of the key: the largest weight / -ln(draw), the lower number on a tie."""
    scores = [F.struct((F.lit(float(w)) / -F.log(draw(key, s))).alias("score"), F.lit(-s).alias("low")) for s, w in enumerate(weights)]
    return -(F.greatest(*scores) if len(scores) > 1 else scores[0])["low"]


def shard(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, added: float = 1.0, *, key: str = "doc_id", text: str = "text", rows_per_block: int = 200_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row.

    Slots count the rows of a shard from 0. A shard holds an eighth of all rows, so its rows are not numbered in one
    task: rows are dealt into blocks by a hash of their content, numbered within shard and block, and shifted by the
    counts of the blocks before, of which there is one small row for each shard and block. Text never moves; what is
    shuffled is the narrow result.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    old = rendezvous(F.col("doc_id"), weights)
    new = F.lit(float(added)) / -F.log(draw(F.col("doc_id"), len(weights)))
    best = F.greatest(*[F.lit(float(w)) / -F.log(draw(F.col("doc_id"), s)) for s, w in enumerate(weights)], F.lit(0.0))
    blocks = max(1, -(-docs.count() // rows_per_block))
    rows = rows.withColumn("shard", old.cast("int")).withColumn("grown_shard", F.when(new > best, F.lit(len(weights))).otherwise(F.col("shard")).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(blocks)).cast("int"))
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("rank", F.row_number().over(within))
        .join(counts, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard")
    )
