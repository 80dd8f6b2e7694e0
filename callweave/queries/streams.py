"""Queries that run a stream over a table until it is read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import checkpoint_folder
from ..operators import projection as P
from ..operators.fusion import late_fusion
from ..operators.handover import first_trigger
from ..sources.io import read_utterances
from ..streaming.live import ROCKSDB, stream_handover
from .registry import SCORES, WEIGHTS, fused


def scored_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as a stream of turns with fused probabilities."""
    turns = read_utterances(spark, f"{sf_dir}/conversations.parquet*", schema="conv_id bigint, turn bigint, role string, text string", stream=True)
    turns.createOrReplaceTempView("conversation_stream")
    rows = spark.sql(SCORES.format(conversations="conversation_stream"))
    whole = P.audio_probs(P.lexicon_probs(P.text_probs(rows)))
    whole = whole.withColumn("goemo_probs", P.goemo_probs_of([c for c in rows.columns if c != "goemo_surprise"], normalise=True))
    return late_fusion(whole, WEIGHTS)


def shuffled_stream(spark: SparkSession, sf_dir: str, files: int = 6) -> DataFrame:
    """Scored turns in an order that has nothing to do with their numbers, a file to a micro-batch."""
    folder = f"{checkpoint_folder(spark)}/turns-{uuid.uuid4().hex}"
    rows = fused(spark, sf_dir).select("dialogue_id", "utterance_id", "fused")
    rows.repartition(files, F.xxhash64("utterance_id", "dialogue_id")).write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run_to_end(spark: SparkSession, found: DataFrame) -> DataFrame:
    """What a stream gives until its source is read, written to the shared folder and read again."""
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    running = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode("append").start()
    running.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out")


def stream_triggers(spark: SparkSession, sf_dir: str, t: float, w: int) -> DataFrame:
    """The first trigger of every dialogue, written by a stream to the shared folder and read again."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return run_to_end(spark, stream_handover(scored_stream(spark, sf_dir), t, w, probs="fused"))


def late_triggers(spark: SparkSession, sf_dir: str, t: float, w: int) -> DataFrame:
    """The same from turns that come in any order over several micro-batches, the first two of each call as its history."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = fused(spark, sf_dir)
    later = shuffled_stream(spark, sf_dir).where("utterance_id >= 2")
    found = run_to_end(spark, stream_handover(later, t, w, probs="fused", first=0, history=rows.where("utterance_id < 2")))
    before = first_trigger(rows.where("utterance_id < 2"), t, w, probs="fused").where("trigger_utt >= 0")
    return found.unionByName(before.withColumn("trigger_utt", F.col("trigger_utt").cast("bigint")))
