"""Helpers that several corpus operators share: lineage cuts and vectorised text handling."""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
TOP = U64(0xFFFFFFFFFFFFFFFF)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. One of our own only where none is set and all tasks run in this process (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-"))
    return sc.getCheckpointDir()


#: With this set, Spark removes the shuffle files of a query when it ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, plain: bool = False) -> DataFrame:
    """Materialise df once in the shared checkpoint folder. Its files go when the JVM no longer refers to them.

    What was shuffled for it is not needed any more and is removed at once. plain: forget the planner's estimate of the
    size. Checkpoints hand it on, joins multiply it, and over many rounds of joins its digits are multiplied again and
    again, until planning takes minutes.
    """
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        done = df.select("*").checkpoint(eager=True)
        if plain:
            return DataFrame(spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), spark)
        return done
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- vectorised text ---------------------------------------------------------------------------------------------


def slices(texts: pa.Array, max_bytes: int):
    """(start, length) runs of rows holding about max_bytes of text; one longer text is a run of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + max_bytes, side="right")))
        yield at, end - at
        at = end


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words [^ \\t\\n\\v\\f\\r]+ of all texts in order (null: none), and where each text's words begin (n + 1 offsets)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        offsets = np.concatenate(([0], np.cumsum(full)))[offsets]
        words = words.filter(pa.array(full))
    return words, offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def word_codes(words: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of the words, the distinct words, and a 64-bit hash of each distinct word."""
    d = pc.dictionary_encode(words)
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in d.dictionary.to_pylist()), U64, len(d.dictionary))
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary, hashes


class Rolling:
    """Hashes of word runs [l, r) from prefix sums of a polynomial modulo 2**64 with an odd base."""

    BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    powers = inverses = np.ones(1, U64)

    def __init__(self, word_hashes: np.ndarray):
        n = len(word_hashes) + 1
        if len(self.powers) < n:
            size = 1 << n.bit_length()
            for name, base in (("powers", self.BASE), ("inverses", self.INVERSE)):
                steps = np.full(size, base, U64)
                steps[0] = 1
                setattr(Rolling, name, np.cumprod(steps, dtype=U64))
        self.prefix = np.concatenate((np.zeros(1, U64), np.cumsum(word_hashes * self.powers[: n - 1], dtype=U64)))

    def runs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return mix((self.prefix[right] - self.prefix[left]) * self.inverses[left])


def slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over every window of the given width, by doubling."""
    if len(a) < width:
        return a[:0]
    cur, span = a, 1
    while span * 2 <= width:
        cur = op(cur[:-span], cur[span:])
        span *= 2
    return op(cur[: len(a) - width + 1], cur[width - span :]) if span < width else cur


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values for each run between offsets, empty runs included."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]
