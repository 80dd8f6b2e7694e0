"""How far annotators agree with the truth and with each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.expr import class_id, ranked, ratio, seeded
from .metrics import confusion_matrix


def stratified_sample(df: DataFrame, label: str, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """n rows: of each label max(1, n // labels) in seeded order, the rest from all others."""
    order = [seeded(seed, *[F.col(k) for k in keys]), *[F.col(k) for k in keys]]
    numbered = ranked(df, [label], order, "_at")
    labels = df.agg(F.count_distinct(label).alias("_labels"))
    per = F.greatest(F.lit(1), F.floor(F.lit(n) / F.greatest("_labels", F.lit(1))))
    # One row is broadcast; at most n + labels rows are sorted by the limit.
    chosen = numbered.join(F.broadcast(labels)).withColumn("_late", F.col("_at") >= per)
    return chosen.orderBy("_late", *order).limit(n).select(*df.columns)


def extend_sheet(sheet: DataFrame, picks: DataFrame, key: str = "audio_id") -> DataFrame:
    """The sheet and the picks that it lacks."""
    new = picks.join(sheet.select(key), key, "left_anti")
    return sheet.unionByName(new, allowMissingColumns=True)


def annotations_long(sheet: DataFrame, key: str = "audio_id", truth: str = "label_truth") -> DataFrame:
    """key, truth, annotator, place, label: one row per annotation with a valid label."""
    columns = [c for c in sheet.columns if c.startswith("annotator_")]
    if not columns:
        return sheet.select(key, truth, F.lit("").alias("annotator"), F.lit(0).alias("place"), F.lit("").alias("label")).where(F.lit(False))
    long = sheet.select(key, truth, *columns).unpivot([key, truth], columns, "annotator", "label")
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("annotator")).cast("int") - 1
    named = long.select(key, truth, F.substring_index("annotator", "annotator_", -1).alias("annotator"), place.alias("place"), "label")
    return named.where(F.col("label").isin(*K.CLASSES))


def kappa(pairs: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """by, n, accuracy, kappa of two labels per row, over rows where both are classes."""
    counts = pairs.where(F.col(a).isin(*K.CLASSES) & F.col(b).isin(*K.CLASSES)).groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    sides = F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("c")), F.struct(F.lit("b").alias("side"), F.col("b").alias("c"))))
    marginals = counts.select("*", sides.alias("s")).groupBy(*by, F.col("s.c").alias("c")).agg(
        F.sum(F.when(F.col("s.side") == "a", F.col("n")).otherwise(0)).alias("na"), F.sum(F.when(F.col("s.side") == "b", F.col("n")).otherwise(0)).alias("nb"))
    chance = marginals.groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("chance"))
    sums = counts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    joined = sums.join(chance, list(by))
    # Whole numbers up to one division: kappa = (n * same - chance) / (n * n - chance).
    square = F.col("n") * F.col("n")
    return joined.select(*by, "n", ratio(F.col("same"), F.col("n")).alias("accuracy"), ratio(F.col("n") * F.col("same") - F.col("chance"), square - F.col("chance")).alias("kappa"))


def agreement_with_truth(long: DataFrame, truth: str = "label_truth") -> DataFrame:
    """annotator, n, accuracy, kappa."""
    return kappa(long, ["annotator"], truth, "label")


def annotator_confusion(long: DataFrame, truth: str = "label_truth") -> DataFrame:
    """annotator, truth, pred, n: the confusion counts of each annotator against the truth."""
    ids = long.select("annotator", class_id(F.col(truth)).alias("truth"), class_id(F.col("label")).alias("pred"))
    return confusion_matrix(ids.where("truth >= 0 AND pred >= 0"), ["annotator"])


def pairwise_kappa(long: DataFrame, key: str = "audio_id") -> DataFrame:
    """annotator_a, annotator_b, n, accuracy, kappa of every pair on the items of both."""
    a = long.select(key, F.col("annotator").alias("annotator_a"), F.col("label").alias("la"), F.col("place").alias("pa"))
    b = long.select(key, F.col("annotator").alias("annotator_b"), F.col("label").alias("lb"), F.col("place").alias("pb"))
    return kappa(a.join(b, key).where("pa < pb"), ["annotator_a", "annotator_b"], "la", "lb")


def majority_recall(long: DataFrame, key: str = "audio_id", truth: str = "label_truth") -> DataFrame:
    """class, n, hits, recall of the annotators' majority; ties go to the first annotator's label."""
    votes = long.groupBy(key, truth, "label").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    mode = votes.groupBy(key, truth).agg(F.max_by("label", F.struct("n", -F.col("first"))).alias("mode"))
    sums = mode.groupBy(F.col(truth).alias("class")).agg(F.count("*").alias("n"), F.sum((F.col("mode") == F.col(truth)).cast("bigint")).alias("hits"))
    every = long.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in K.CLASSES])).alias("class"))
    whole = every.join(sums, "class", "left").fillna(0, ["n", "hits"])
    return whole.select("class", "n", "hits", ratio(F.col("hits"), F.col("n")).alias("recall"))
