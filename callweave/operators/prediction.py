"""The whole decision on an utterance as one record: scores in, prediction and handover out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.expr import class_name
from .features import feature_vector
from .fusion import apply_meta, late_fusion
from .handover import checked, instant_decision


def predict_utterances(df: DataFrame, weights: dict[str, float] | None = None, model=None, threshold: float = 0.6, keys: Sequence[str] = (), text: str = "text", columns: Sequence[str] = K.FEATURES, timings: dict[str, str] | None = None) -> DataFrame:
    """keys, text, predicted_emotion, confidence, should_handover, handover_score, threshold, meta_probs and details.

    The class probabilities come from late fusion of the models' vectors by `weights`, or from a fitted
    Spark ML model over the feature columns; one of the two must be given. meta_probs is a struct with
    a field for each class, details one with what each model gave. A vector that is null leaves the
    prediction null and hands nothing over. timings, stage -> column of seconds, adds the struct timings
    with a field for each stage and their total; a stage that was not timed is null and adds nothing.
    """
    checked(threshold, 1)
    if (weights is None) == (model is None):
        raise ValueError("either weights or a model must be given")
    if weights is not None:
        scored, details = late_fusion(df, weights).withColumnRenamed("fused", "meta_probs"), [f"{m}_probs" for m in weights]
    else:
        scored, details = apply_meta(feature_vector(df, columns), model), [c for c in columns if c in df.columns]
    decided = instant_decision(scored, threshold, "meta_probs")
    named = F.struct(*[F.get("meta_probs", i).alias(c) for i, c in enumerate(K.CLASSES)])
    return decided.select(
        *keys,
        text,
        class_name(F.col("pred")).alias("predicted_emotion"),
        F.array_max("meta_probs").alias("confidence"),
        F.col("handover").alias("should_handover"),
        "handover_score",
        F.lit(float(threshold)).alias("threshold"),
        named.alias("meta_probs"),
        F.struct(*[F.col(c) for c in details]).alias("details"),
        *([timed(timings).alias("timings")] if timings else []),
    )


def timed(stages: dict[str, str]) -> Column:
    """A struct of the seconds of each stage, with their total."""
    seconds = {stage: F.col(f"`{c}`").cast("double") for stage, c in stages.items()}
    total = sum((F.coalesce(s, F.lit(0.0)) for s in seconds.values()), F.lit(0.0))
    return F.struct(*[s.alias(stage) for stage, s in seconds.items()], total.alias("total"))


def stage_seconds(records: DataFrame, *keys: str) -> DataFrame:
    """keys, stage, seconds of every stage that was timed, and of the total: what latency_summary reads."""
    stages = records.schema["timings"].dataType.fieldNames()
    rows = records.select(*keys, *[F.col(f"timings.`{s}`").alias(f"timings_{s}") for s in stages])
    made = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"`timings_{s}`").alias("seconds")) for s in stages])).alias("of")
    return rows.select(*keys, made).select(*keys, "of.stage", "of.seconds").where("seconds IS NOT NULL")
