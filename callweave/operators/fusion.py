"""Fusing the class probabilities of several models."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.expr import argmax
from .metrics import evaluate, fill_cells, summary_metrics


def filled(vector: Column) -> Column:
    """A vector of the five classes with 0 for what is missing, elements or all of it."""
    zeros = F.array(*[F.lit(0.0)] * len(K.CLASSES))
    return F.transform(F.slice(F.concat(F.coalesce(vector, zeros), zeros), 1, len(K.CLASSES)), lambda p: F.coalesce(F.nanvl(p.cast("double"), F.lit(0.0)), F.lit(0.0)))


def weighted(vectors: Sequence[Column], weights: Sequence[float]) -> Column:
    """The weighted sum of probability vectors, class by class, models in order.

    A missing score, alone or with its whole vector, counts 0; without any vector there is no sum.
    """
    given = F.coalesce(*vectors).isNotNull()
    vectors = [filled(v) for v in vectors]

    def plus(weight: float):
        return lambda total, p: total + F.lit(float(weight)) * p

    out = F.transform(vectors[0], lambda p: F.lit(float(weights[0])) * p)
    for vector, weight in zip(vectors[1:], weights[1:]):
        out = F.zip_with(out, vector, plus(weight))
    return F.when(given, out)


def text_ensemble(df: DataFrame, alpha: float = 0.5, beta: float = 0.3, gamma: float = 0.2) -> DataFrame:
    """Adds fused and pred from text_probs, goemo_probs and lexicon_probs."""
    fused = weighted([F.col("text_probs"), F.col("goemo_probs"), F.col("lexicon_probs")], [alpha, beta, gamma])
    return df.withColumn("fused", fused).withColumn("pred", argmax(F.col("fused")))


def late_fusion(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds fused, the weighted mean of `<model>_probs`, and pred."""
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("the sum of the weights must be positive")
    fused = weighted([F.col(f"{m}_probs") for m in weights], [w / total for w in weights.values()])
    return df.withColumn("fused", fused).withColumn("pred", argmax(F.col("fused")))


def grid_counts(df: DataFrame, models: Sequence[str], grid: list[tuple[float, ...]], truth: str = "truth") -> DataFrame:
    """grid_id, truth, pred, n: confusion counts of every grid point.

    A task counts all grid points over its rows and gives back the counts alone, so what is
    shuffled does not grow with the rows. Missing scores count 0; rows without any vector, or whose
    truth is no class, do not count.
    """
    points = np.array(grid, np.float64)
    size = len(K.CLASSES)

    def run(batches):
        counts = np.zeros((len(points), size, size), np.int64)
        for batch in batches:
            label = batch.column(0).to_numpy()
            probs = [batch.column(k + 1).flatten().to_numpy().reshape(-1, size) for k in range(len(models))]
            for g, point in enumerate(points):
                fused = point[0] * probs[0]
                for w, p in zip(point[1:], probs[1:]):
                    fused = fused + w * p
                counts[g] += np.bincount(label * size + fused.argmax(1), minlength=size * size).reshape(size, size)
        g, t, p = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(t, pa.int32()), pa.array(p, pa.int32()), pa.array(counts[g, t, p], pa.int64())], names=["grid_id", "truth", "pred", "n"])

    whole = F.col(truth).cast("int").between(0, size - 1) & F.coalesce(*[F.col(f"{m}_probs") for m in models]).isNotNull()
    rows = df.where(whole).select(F.col(truth).cast("int").alias("truth"), *[filled(F.col(f"{m}_probs")).alias(f"{m}_probs") for m in models])
    made = rows.mapInArrow(run, "grid_id int, truth int, pred int, n bigint")
    return made.groupBy("grid_id", "truth", "pred").agg(F.sum("n").alias("n"))


def best_point(df: DataFrame, models: Sequence[str], grid: list[tuple[float, ...]], names: Sequence[str], truth: str = "truth", scale: bool = False) -> DataFrame:
    """The first grid point of the best weighted F1, to 12 places; scale makes the weights of a point sum to 1."""
    points = [tuple(w / sum(p) for w in p) for p in grid] if scale else grid
    counts = fill_cells(grid_counts(df, models, points, truth), ["grid_id"])
    scored = summary_metrics(counts, ["grid_id"]).select("grid_id", "weighted_f1")
    best = scored.orderBy(F.desc(F.round("weighted_f1", 12)), "grid_id").limit(1)
    return best.select("grid_id", "weighted_f1", *[F.get(F.lit([float(p[k]) for p in grid]), F.col("grid_id")).alias(n) for k, n in enumerate(names)])


def text_grid() -> list[tuple[float, float, float]]:
    """Points (alpha, beta, gamma) with gamma = 1 - alpha - beta that is not negative."""
    return [(a, b, 1 - a - b) for a in K.TEXT_ALPHAS for b in K.TEXT_BETAS if 1 - a - b >= 0]


def tune_text_weights(df: DataFrame, truth: str = "truth") -> DataFrame:
    return best_point(df, ("text", "goemo", "lexicon"), text_grid(), ("alpha", "beta", "gamma"), truth)


def tune_late_weights(df: DataFrame, truth: str = "truth") -> DataFrame:
    grid = list(product(K.FUSION_LEVELS, repeat=len(K.MODELS)))
    return best_point(df, K.MODELS, grid, [f"w_{m}" for m in K.MODELS], truth, scale=True)


def majority_vote(df: DataFrame, order: Sequence[str] = K.MODELS) -> DataFrame:
    """Adds pred: the class of most votes; among equals the one of the first model in order."""
    votes = F.array(*[argmax(F.col(f"{m}_probs")) for m in order])

    def first_of_most(votes: Column) -> Column:
        # The vote of model i wins against later ones unless they have more votes.
        ranked = F.transform(votes, lambda v, i: F.struct(F.size(F.filter(votes, lambda x: x == v)).alias("n"), (-i).alias("first"), v.alias("class")))
        return F.array_max(ranked)["class"]

    # The votes are named once, so that a filter on pred does not repeat them for each vote in the plan.
    return df.withColumn("pred", F.get(F.transform(F.array(votes), first_of_most), 0))


def model_predictions(df: DataFrame, models: Sequence[str] = K.MODELS, truth: str = "truth") -> DataFrame:
    """model, truth, pred for each model of each row."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), argmax(F.col(f"{m}_probs")).alias("pred")) for m in models]))
    return df.select(F.col(truth).alias("truth"), each.alias("m")).select("m.model", "truth", "m.pred")


def rank_models(df: DataFrame, models: Sequence[str] = K.MODELS, truth: str = "truth") -> DataFrame:
    """model, weighted_f1, rank: models by weighted F1 to 12 places, in their own order on ties."""
    own = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model"))
    scored = evaluate(model_predictions(df, models, truth), ["model"])
    return scored.select("model", "weighted_f1", F.row_number().over(Window.orderBy(F.desc(F.round("weighted_f1", 12)), own)).alias("rank"))


def compare_strategies(strategies: dict[str, DataFrame], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Metrics of every strategy."""
    tagged = [d.select(F.lit(n).alias("strategy"), F.col(truth).alias("truth"), F.col(pred).alias("pred")) for n, d in strategies.items()]
    whole = tagged[0]
    for other in tagged[1:]:
        whole = whole.unionByName(other)
    return evaluate(whole, ["strategy"])


def apply_meta(df: DataFrame, model, features: str = "features", prefix: str = "meta") -> DataFrame:
    """Adds meta_probs, pred and confidence from a fitted Spark ML model over a features array."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = df.withColumn("_features", array_to_vector(F.col(features)))
    scored = model.transform(ready)
    probs = vector_to_array("probability").alias(f"{prefix}_probs")
    return scored.select(*df.columns, probs).withColumn("pred", argmax(F.col(f"{prefix}_probs"))).withColumn("confidence", F.array_max(f"{prefix}_probs"))
