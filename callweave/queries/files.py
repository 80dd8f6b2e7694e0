"""Queries that write a table in a format to the shared folder and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.expr import checkpoint_folder
from ..operators import errors as E
from ..operators import features as J
from ..sources import io
from .batch_labels import _ALIGNED, attached, three_tables
from .batch_reports import report
from .registry import ORACLES, WITH_SCORES, query, rounded, scores, table


def new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/files-{uuid.uuid4().hex}"


@query("SELECT conv_id, turn, role, text FROM conversations WHERE turn % 7 <> 6")
def io2_read_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh line is cut in two and so is malformed."""
    folder = new_folder(spark)
    turns = table(spark, sf_dir, "conversations")
    line = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    turns.select(F.when(F.col("turn") % 7 == 6, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(folder)
    return io.read_jsonl(spark, folder, "conv_id bigint, turn bigint, role string, text string")


@query(f"{WITH_SCORES} SELECT audio_id, text, true_label, vader_compound FROM scores")
def io3_read_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark)
    scores(spark, sf_dir).select("audio_id", "text", "true_label", "vader_compound").write.option("header", True).option("escape", '"').csv(folder)
    return io.read_predictions(spark, folder, "audio_id string, text string, true_label string, vader_compound double", multi_line=True)


@query(f"{WITH_SCORES} SELECT split, audio_id, {', '.join(f'round({c}, 6) AS {c}' for c in K.FEATURES[:5])} FROM scores WHERE dialogue_id % 17 <> 0 AND utterance_id % 11 <> 5")
def io4_write_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark)
    io.write_features(attached(spark, sf_dir), folder)
    return rounded(spark.read.parquet(folder).select("split", "audio_id", *K.FEATURES[:5]), *K.FEATURES[:5])


def bucketed_features(spark: SparkSession, sf_dir: str, buckets: int = 8) -> DataFrame:
    """The feature rows from four bucketed tables."""
    folder = new_folder(spark)
    given = [*three_tables(spark, sf_dir), scores(spark, sf_dir).where(_ALIGNED).select("audio_id", *K.TEXT_COLUMNS)]
    held = [io.write_bucketed(d, f"{n}_{folder[-32:]}", "audio_id", buckets, f"{folder}/{n}") for d, n in zip(given, K.MODELS)]
    return J.attach_text_model(J.align_predictions(*held[:3]), held[3])


@query(f"{WITH_SCORES} SELECT split, audio_id, CAST(coalesce(truth, -1) AS INT) AS true_label_id, {', '.join(f'round({c}, 6) AS {c}' for c in K.FEATURES)} FROM scores WHERE {_ALIGNED}")
def j2_bucketed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score tables written in buckets and joined without a shuffle."""
    made = bucketed_features(spark, sf_dir)
    return rounded(made.select("split", "audio_id", "true_label_id", *K.FEATURES), *K.FEATURES)


@query("SELECT conv_id, turn, length(text) AS n FROM conversations")
def io5_resumed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns worked off as a stream, of which one micro-batch is repeated, then what is still pending."""
    folder = new_folder(spark)
    schema = "conv_id bigint, turn bigint, role string, text string"
    turns = io.read_utterances(spark, f"{sf_dir}/conversations.parquet*", schema=schema, stream=True)
    work = lambda d: d.where("conv_id % 4 <> 0").select("conv_id", "turn", F.length("text").alias("n"))
    for _ in range(2):  # the second time starts without the first one's acknowledgements
        io.append_stream(turns, f"{folder}/out", f"{folder}/{uuid.uuid4().hex}", work).awaitTermination()
    done = io.read_done(spark, f"{folder}/out", "conv_id bigint, turn bigint, n int")
    left = io.pending(table(spark, sf_dir, "conversations"), done, "conv_id").select("conv_id", "turn", F.length("text").alias("n"))
    io.append_done(left, f"{folder}/out", "rest")
    return io.read_done(spark, f"{folder}/out", "conv_id bigint, turn bigint, n int")


@query(f"SELECT threshold FROM ({ORACLES['e5_select_threshold']}) t")
def io7_report_and_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark)
    io.write_report(E.select_threshold(E.threshold_sweep(report(spark, sf_dir))), folder)
    return io.read_threshold(spark, folder)


@query("SELECT DISTINCT 'actor=' || CAST(doc_id % 91 AS VARCHAR) AS folder FROM documents")
def io6_list_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of the files, one per actor, that are written from the documents' clip names."""
    folder = new_folder(spark)
    names = table(spark, sf_dir, "documents").select((F.col("doc_id") % 91).alias("actor"), F.lit("x").alias("value"))
    names.repartition("actor").write.partitionBy("actor").text(folder)
    return io.list_clips(spark, folder, "*.txt").select(F.element_at(F.split("path", "/"), -2).alias("folder")).distinct()
