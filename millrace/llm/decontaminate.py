"""Benchmark decontamination: a prefix-filtered set join. DataFrame functions only.

A window is `window` consecutive words of an item (an item of fewer words is one window). A document contains a window
only if it contains all its shingles, so it is enough to look for one: the window's rarest shingle over the corpus, its
necessary prefix for full containment. Each document's shingles meet the table of prefix shingles; a meeting fixes where
the window would have to start, which bounds by position and length reject or the comparison of all words confirms.

A shingle is two adjacent words; for a window of one word it is that word and nothing. Counts that order shingles by
rarity are taken over all documents.

Everything about a document happens in the row that holds its words: words are exploded, looked up, filtered and
verified in one stage, and only confirmed hits and one row for each document are shuffled. Text is never shuffled.
Items are handled in blocks of `block_bytes` of text, and only a block is broadcast; a larger benchmark means more
passes over the documents.

Nulls: a null text has no words; a null item has none either; hits of items with a null id count as hit words but are not
listed. Repeated items with one id count once. Repeated documents get a row each: rows are told apart by their place in
the input, not by id, so the input must be stable when read again, as files are. Empty tables: no documents, no rows; no
items, no hits. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of letters, digits and all that is not ASCII, A-Z lower-cased."""
    parts = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _UPPER.lower()), _BETWEEN)
    return F.filter(parts, lambda w: w != "")


def _document_words(text: Column) -> Column:
    """As words_of, but without a lambda: only the first and last part of a split can be empty."""
    parts = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _UPPER.lower()), _BETWEEN)
    return F.slice(parts, F.when(F.get(parts, F.lit(0)) == "", 2).otherwise(1), F.size(parts))


def _shingle(word: Column, following: Column) -> Column:
    return F.xxhash64(word, F.coalesce(following, F.lit("")))


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """item_id, win (words), one row for each distinct window of an item."""
    items = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, window))).alias("win")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = 10, key: str = "doc_id", text: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, contaminated for each row of docs. items is sorted as strings."""
    # The closing empty word stands for the document itself: its row reports the number of words.
    parts = docs.select(F.col(key).alias("doc_id"), F.monotonically_increasing_id().alias("row"), _document_words(F.col(text)).alias("raw"))
    parts = parts.select("doc_id", "row", F.concat(F.when(F.get("raw", F.size("raw") - 1) == "", F.slice("raw", 1, F.size("raw") - 1)).otherwise(F.col("raw")), F.array(F.lit(""))).alias("words"))
    placed = parts.select("doc_id", "row", "words", F.posexplode_outer("words").alias("pos", "word"))
    keyed = placed.withColumn("shingle", _shingle(F.col("word"), F.get("words", F.col("pos") + 1)))

    wins = windows_of(items, window)
    tokens = wins.select("item_id", "win", F.posexplode("win").alias("at", "word"))
    tokens = tokens.withColumn("shingle", _shingle(F.col("word"), F.get("win", F.col("at") + 1))).where((F.col("at") < F.size("win") - 1) | (F.size("win") == 1))
    # Items of one word: single words are looked up too. That is a join of its own, as a union before the join would keep
    # Spark from filtering rows, each of which holds its document's words, while it explodes them.
    alone = placed.where(F.col("word") != "").withColumn("shingle", _shingle(F.col("word"), F.lit(""))) if wins.where(F.size("win") == 1).limit(1).count() else None
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]  # one row
    blocks = max(1, -(-int(total) // block_bytes))
    in_block = lambda df, b: df.where(F.pmod(F.hash("item_id"), F.lit(blocks)) == b) if blocks > 1 else df

    found = None
    for b in range(blocks):
        own = in_block(tokens, b)
        vocabulary = F.broadcast(own.select("shingle").distinct())
        frequency = keyed.select("shingle").join(vocabulary, "shingle", "left_semi").groupBy("shingle").agg(F.count("*").alias("seen"))
        ordered = own.join(frequency, "shingle", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
        prefix = ordered.groupBy("item_id", "win").agg(F.min(F.struct("seen", "at", "shingle")).alias("rarest"))
        prefix = prefix.select(F.col("rarest.shingle").alias("shingle"), F.col("rarest.at").alias("at"), "item_id", "win", F.size("win").alias("len"))
        if b == 0:
            closing = prefix.sparkSession.range(1).select(
                _shingle(F.lit(""), F.lit("")).alias("shingle"), F.lit(0).alias("at"), F.lit(None).cast(dict(items.dtypes)["item_id"]).alias("item_id"), F.array(F.lit("")).alias("win"), F.lit(0).alias("len")
            )
            prefix = closing.unionByName(prefix)
        start = F.col("pos") - F.col("at")
        fits = (start >= 0) & (start + F.size("win") <= F.size("words"))
        same = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size("win")) == F.col("win")
        for rows, wanted in [(keyed, prefix)] + ([] if alone is None else [(alone, prefix.where("len = 1"))]):
            hits = rows.join(F.broadcast(wanted), "shingle").where(fits & same)
            hits = hits.select("row", "doc_id", start.alias("start"), "len", "item_id", F.when(F.col("len") == 0, F.col("pos")).alias("n_words"))
            found = hits if found is None else found.unionByName(hits)

    spans = F.when(F.col("len") > 0, F.struct("start", (F.col("start") + F.col("len")).alias("end")))
    each = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"), F.collect_set(spans).alias("spans"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("upto")),
        lambda acc, s: F.struct((acc["hit"] + F.greatest(s["end"] - F.greatest(s["start"], acc["upto"]), F.lit(0))).alias("hit"), F.greatest(acc["upto"], s["end"]).alias("upto")),
    )
    each = each.withColumn("n_hit", F.when(F.size("spans") == 0, F.lit(0)).otherwise(covered["hit"]).cast("long")).withColumn("items", F.array_sort("items"))
    return each.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))
