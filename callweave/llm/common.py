"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import checkpoint_folder, checkpointed

__all__ = ["ARROW", "checkpointed", "crc_rest", "map_column", "remove_folder", "small_batches", "table", "text_bytes", "with_row_key", "written"]

#: Rows and bytes of one Arrow batch. Texts can be long, so a batch is bounded by both.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory that a Python worker needs for one batch of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(col: str) -> Column:
    """The UTF-8 bytes of a text."""
    return F.col(col).cast("string").cast("binary")


def map_column(
    df: DataFrame,
    value: Column,
    keep: list[str],
    outputs: dict[str, str],
    start: Callable[[], Callable[[pa.Array], list]],
) -> DataFrame:
    """Adds columns computed from one column in Arrow batches.

    start() runs once per task and returns a function from a batch of values to one list or
    Arrow array per output. The result has the kept columns, then the outputs; a kept column
    that has the name of an output gives way to it.
    """
    small_batches(df.sparkSession)
    keep = [c for c in keep if c not in outputs]
    held = [f"k{i}" for i in range(len(keep))]
    source = df.select(value.alias("v"), *[df[f"`{c}`"].alias(h) for c, h in zip(keep, held)])
    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    schema = ", ".join([f"`{h}` {types[h]}" for h in held] + [f"`{n}` {t}" for n, t in outputs.items()])
    kinds = [ARROW[t] for t in outputs.values()]
    names = held + list(outputs)

    def run(batches):
        work = start()
        for batch in batches:
            made = work(batch.column(0))
            made = [m if isinstance(m, (pa.Array, pa.ChunkedArray)) else pa.array(m, k) for m, k in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(i + 1) for i in range(len(held))] + made, names=names)

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(h).alias(c) for h, c in zip(held, keep)], *outputs)


ARROW = {
    "string": pa.string(),
    "binary": pa.binary(),
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "array<int>": pa.list_(pa.int32()),
    "array<bigint>": pa.list_(pa.int64()),
    "array<double>": pa.list_(pa.float64()),
}


def crc_rest(col: str, divisor: int) -> Column:
    """crc32 of an id written as text, modulo divisor."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(divisor))


def with_row_key(docs: DataFrame, from_files: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """docs under names of our own, with a key `row` that a row keeps however often it is read; and the names.

    from_files: docs is a plain reading of Parquet files. Its rows are known by file and place, and are
    read again where they are needed. Other rows are written once, whole, with a running number.
    """
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    columns = [docs[f"`{c}`"].alias(o) for c, o in own.items()]
    if from_files and "_metadata" not in {c.lower() for c in docs.columns}:
        place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        return docs.select(*columns, place.alias("row")), own
    return checkpointed(docs.select(*columns, F.monotonically_increasing_id().alias("row"))), own


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared checkpoint folder, and the folder of the table."""
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder wherever Spark keeps it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
