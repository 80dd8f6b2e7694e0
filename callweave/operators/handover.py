"""When a conversation must go to a human: decisions per utterance and per call.

Probabilities come as an array `probs` in class order; null or missing ones count 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.expr import ratio

INSTANT, TREND = "instant_strong_emotion", "sustained_negative_trend"


def checked(t: float, w: int) -> None:
    if not 0 < t <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    if w < 1:
        raise ValueError("the window must hold one utterance at least")


def mass(probs: str, *classes: int) -> Column:
    parts = [F.coalesce(F.get(F.col(probs), c), F.lit(0.0)) for c in classes]
    return sum(parts[1:], parts[0])


def instant_decision(df: DataFrame, t: float = 0.6, probs: str = "probs") -> DataFrame:
    """Adds handover_score and handover."""
    return df.withColumn("handover_score", mass(probs, K.ANGER, K.FRUSTRATION)).withColumn("handover", F.col("handover_score") > t)


def rolling_negative(df: DataFrame, w: int = 3, dialogue: str = "dialogue_id", utterance: str = "utterance_id", probs: str = "probs") -> DataFrame:
    """Adds trend_score: the mean negative mass of the last w utterances, null before there are w."""
    frame = Window.partitionBy(dialogue).orderBy(utterance).rowsBetween(-(w - 1), 0)
    masses = df.withColumn("_mass", mass(probs, K.ANGER, K.FRUSTRATION, K.SADNESS))
    return masses.withColumn("trend_score", F.when(F.count("*").over(frame) == w, F.sum("_mass").over(frame) / w)).drop("_mass")


def handover_events(df: DataFrame, t: float = 0.6, w: int = 3, dialogue: str = "dialogue_id", utterance: str = "utterance_id", probs: str = "probs") -> DataFrame:
    """Adds position, the scores, handover and reason at every utterance."""
    checked(t, w)
    scored = rolling_negative(instant_decision(df, t, probs), w, dialogue, utterance, probs)
    trend = F.coalesce(F.col("trend_score") > t * 0.7, F.lit(False))
    position = F.row_number().over(Window.partitionBy(dialogue).orderBy(utterance)) - 1
    reason = F.when(F.col("handover"), INSTANT).when(trend, TREND).otherwise("ok")
    return scored.withColumn("position", position).withColumn("reason", reason).withColumn("handover", F.col("reason") != "ok")


def first_trigger(df: DataFrame, t: float = 0.6, w: int = 3, dialogue: str = "dialogue_id", utterance: str = "utterance_id", probs: str = "probs") -> DataFrame:
    """dialogue, trigger_utt (-1 for none) and trigger_reason (ok for none)."""
    events = handover_events(df, t, w, dialogue, utterance, probs)
    first = events.groupBy(dialogue).agg(F.min(F.when(F.col("handover"), F.struct("position", "reason"))).alias("f"))
    return first.select(dialogue, F.coalesce("f.position", F.lit(-1)).alias("trigger_utt"), F.coalesce("f.reason", F.lit("ok")).alias("trigger_reason"))


def replay_conversations(df: DataFrame, t: float = 0.6, w: int = 3, dialogue: str = "dialogue_id", utterance: str = "utterance_id", probs: str = "probs", truth: str = "truth") -> DataFrame:
    """One row per dialogue; the windows and the grouping share one shuffle."""
    negative = F.coalesce(F.col(truth).isin(K.ANGER, K.FRUSTRATION), F.lit(False))
    calls = (
        handover_events(df, t, w, dialogue, utterance, probs)
        .groupBy(dialogue)
        .agg(
            F.count("*").alias("length"),
            F.sum(negative.cast("bigint")).alias("n_negative_utts"),
            F.coalesce(F.min(F.when(negative, F.col("position"))), F.lit(-1)).alias("first_neg_utt"),
            F.min(F.when(F.col("handover"), F.struct("position", "reason"))).alias("f"),
        )
    )
    has, fired = F.col("n_negative_utts") > 0, F.col("f").isNotNull()
    return calls.select(
        dialogue,
        "length",
        has.alias("has_negative"),
        "n_negative_utts",
        "first_neg_utt",
        F.coalesce("f.position", F.lit(-1)).alias("trigger_utt"),
        F.coalesce("f.reason", F.lit("ok")).alias("trigger_reason"),
        (has & fired).alias("caught"),
        (~has & fired).alias("false_handover"),
        F.when(has & fired, F.col("f.position") - F.col("first_neg_utt")).alias("latency_utt"),
    )


def handover_summary(calls: DataFrame) -> DataFrame:
    """Counts, recall, precision, false rate, mean latency of caught calls, mean length."""
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    sums = calls.agg(
        F.count("*").alias("calls"),
        count(F.col("has_negative")).alias("with_negative"),
        count(~F.col("has_negative")).alias("clean"),
        count(F.col("caught")).alias("caught"),
        count(F.col("has_negative") & ~F.col("caught")).alias("missed"),
        count(F.col("false_handover")).alias("false_handovers"),
        count(F.col("trigger_utt") >= 0).alias("triggered"),
        F.avg(F.when(F.col("caught"), F.col("latency_utt"))).alias("mean_latency"),
        F.avg("length").alias("mean_length"),
    )
    return (
        sums.withColumn("recall", ratio(F.col("caught"), F.col("with_negative")))
        .withColumn("precision", ratio(F.col("caught"), F.col("triggered")))
        .withColumn("false_rate", ratio(F.col("false_handovers"), F.col("clean")))
    )


def reason_counts(calls: DataFrame) -> DataFrame:
    return calls.where("trigger_utt >= 0").groupBy("trigger_reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "trigger_reason")
