"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

UTTERANCES = "text string, emotion string, sentiment string, path string"


def read_utterances(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str = UTTERANCES, stream: bool = False, **options) -> DataFrame:
    """Labelled utterances, as a batch or as a stream, with a declared schema."""
    reader = spark.readStream if stream else spark.read
    return reader.format(fmt).options(**options).schema(schema).load(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; blank and malformed lines are skipped."""
    return spark.read.option("mode", "DROPMALFORMED").schema(schema).json(path)


def read_predictions(spark: SparkSession, path: str, schema: StructType | str, multi_line: bool = False) -> DataFrame:
    """A prediction table in CSV with a header.

    multi_line reads texts with line breaks, each file in one task; without it large files are split.
    """
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multi_line).schema(schema).csv(path)


def write_features(df: DataFrame, path: str, by: str = "split", rows_per_file: int = 1_000_000) -> None:
    """One folder per split, in files of bounded size.

    Rows are rebalanced by split: small parts of a split share a task, and a large one is dealt to as
    many tasks as its size asks for (spark.sql.adaptive.advisoryPartitionSizeInBytes each).
    """
    spread = df.sparkSession.sql(f"SELECT /*+ REBALANCE(`{by}`) */ * FROM {{df}}", df=df)
    spread.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(by).parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str) -> DataFrame:
    """df as a table in buckets by key, sorted in each, and the table.

    Tables in equally many buckets join on the key without a shuffle. A bucket is one task and one file,
    so buckets are as many as give files of a few hundred megabytes.
    """
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not done."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def append_done(df: DataFrame, path: str, run: str) -> None:
    """Adds finished rows to an output that pending() reads later.

    Each run has a folder of its own, which a repetition of the run replaces: rows are never doubled,
    and runs at the same time do not meet.
    """
    df.write.mode("overwrite").parquet(f"{path}/run={run}")


def read_done(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """What runs have finished; nothing if there was none."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def append_stream(stream: DataFrame, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] = lambda batch: batch, **trigger) -> StreamingQuery:
    """Works off a stream and adds each micro-batch to an output that pending() and read_done() read.

    A batch that was written and not acknowledged, as when the job dies in between, comes again with its number
    and replaces its folder, so no row is doubled and none is lost.
    """

    def write(batch: DataFrame, number: int) -> None:
        append_done(work(batch), path, f"{number:012d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def list_clips(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    """path and name of the files of a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name")).orderBy("name", "path")


def write_report(df: DataFrame, path: str) -> None:
    """A summary of a few rows as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_threshold(spark: SparkSession, path: str, default: float = 0.6, key: str = "threshold") -> DataFrame:
    """One row with the tuned threshold; the default when the file or the key is missing."""
    try:
        found = spark.read.json(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        found = spark.createDataFrame([], f"{key} double")
    value: Column = F.col(key).cast("double") if key in found.columns else F.lit(None).cast("double")
    return found.select(value.alias(key)).agg(F.coalesce(F.max(key), F.lit(float(default))).alias(key))
