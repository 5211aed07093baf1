"""Reading and writing folders of files."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_folder(spark: SparkSession, path: str, *, schema: StructType | None = None, files: bool = False) -> DataFrame:
    """Parquet files of a folder (or one file). A missing folder is an error; an empty one gives no rows if a schema is given.

    files adds the column `file`, to group or order by the file a row came from.
    """
    try:
        df = spark.read.option("pathGlobFilter", "*.[pP][aA][rR][qQ][uU][eE][tT]").parquet(path)
    except AnalysisException as error:
        if schema is None or error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        df = spark.createDataFrame([], schema)
    return df.withColumn("file", F.input_file_name()) if files else df


def count_rows(spark: SparkSession, path: str) -> int:
    """From footers alone."""
    return spark.read.parquet(path).count()


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


def stage(path: str) -> str:
    """A path or prefix as Spark's readers take it."""
    return re.sub(r"^s3://", "s3a://", path)


def write_folder(df: DataFrame, path: str, *, files: int | None = None, mode: str = "errorifexists", allow_empty: bool = True) -> None:
    """Parquet with Snappy; with files, split evenly into so many."""
    if not allow_empty and df.isEmpty():
        raise ValueError("nothing to write")
    (df.repartition(files) if files else df).write.mode(mode).option("compression", "snappy").parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of spark.checkpoint.dir; in one of our own only where none is set and all tasks are local."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base or tempfile.mkdtemp(prefix='millrace-')}/{name}-{uuid.uuid4().hex}"


def split_contiguous(df: DataFrame, files: int, *order: str) -> DataFrame:
    """Adds part: of n rows in the given order, each of the files gets ceil(n / files) in turn, the last what is left.

    The sorted rows are checkpointed; the driver sees one count for each of their partitions.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch(spark, "checkpoints"))
    rows = df.orderBy(*order).checkpoint().withColumns({"_at": F.monotonically_increasing_id()})
    place, local = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    begin, starts = 0, {}
    for r in rows.groupBy(place.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        starts[r["p"]], begin = begin, begin + r["n"]
    if not begin:
        return rows.withColumn("part", F.lit(0)).drop("_at")
    offsets = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])
    return rows.withColumn("part", F.floor((offsets[place] + local) / -(-begin // files)).cast("int")).drop("_at")


def write_batches(df: DataFrame, path: str, prefix: str, files: int, *order: str) -> None:
    """Files prefix_00000.parquet and so on, each with a run of ceil(n / files) rows in the given order."""
    spark = df.sparkSession
    split_contiguous(df, files, *order).repartitionById(files, F.col("part")).drop("part").write.mode("overwrite").parquet(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        if found := re.match(r"part-(\d{5})-.*\.parquet$", name := status.getPath().getName()):
            fs.rename(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), jvm.org.apache.hadoop.fs.Path(f"{path}/{prefix}_{found[1]}.parquet"))


def write_chunks(df: DataFrame, path: str, rows: int) -> None:
    """Files of at most so many rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def write_single(df: DataFrame, path: str) -> None:
    """One file; meant for small results."""
    if df.isEmpty():
        raise ValueError("nothing to write")
    df.coalesce(1).write.mode("overwrite").parquet(path)


def append_benchmark(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path, header=True)


def sample_lines(df: DataFrame, n: int = 5) -> DataFrame:
    """Header and the first n rows as `name=value` lines: column `line`."""
    row = F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in df.columns])
    head = df.sparkSession.createDataFrame([(", ".join(df.columns),)], "line string")
    return head.union(df.limit(n).select(row.alias("line")))


def write_names_and_times(decoded: DataFrame, path: str, kind: str = "parquet") -> None:
    """service_name and timestamp of decoded payloads, missing times as 0; in CSV missing names are empty."""
    rows = names_and_times(decoded)
    if kind == "csv":
        rows.fillna("", ["service_name"]).write.mode("overwrite").csv(path, header=True)
    else:
        rows.write.mode("overwrite").parquet(path)


def names_and_times(decoded: DataFrame) -> DataFrame:
    return decoded.select("service_name", F.coalesce("timestamp", F.lit(0)).alias("timestamp"))
