"""Learned fusion with Spark ML: candidates, resampling, calibration, ablation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.expr import argmax, checkpointed, ranked, seeded, seeded_int
from .boosting import Boosted, Perceptron, apply_probabilities, fit_boosted, fit_perceptron
from .features import feature_columns, feature_vector
from .metrics import evaluate, sample_weights
from .neighbours import nearest_in_class

#: Component subsets of the ablation.
ABLATIONS = {
    "Full": ("text", "goemo", "lexicon", "audio"),
    "No lexicon": ("text", "goemo", "audio"),
    "No goemo": ("text", "lexicon", "audio"),
    "No audio": ("text", "goemo", "lexicon"),
    "No text": ("goemo", "lexicon", "audio"),
    "Only text": ("text",),
    "Only audio": ("audio",),
    "Only goemo": ("goemo",),
    "Only lexicon": ("lexicon",),
}


def with_vectors(df: DataFrame, columns: Sequence[str] = K.FEATURES, truth: str = "truth") -> DataFrame:
    """Adds what the estimators read: vector, label and weight (balanced over classes)."""
    rows = feature_vector(df.where(F.col(truth).isNotNull()), columns, "_array")
    return sample_weights(rows.withColumn("vector", array_to_vector("_array")).withColumn("label", F.col(truth).cast("double")), truth).drop("_array")


def logistic(rows: int) -> LogisticRegression:
    """Balanced multinomial regression with the penalty of C = 1."""
    return LogisticRegression(featuresCol="vector", labelCol="label", weightCol="weight", family="multinomial", standardization=False, regParam=1.0 / max(rows, 1), maxIter=200)


CANDIDATES = ("logistic", "boosted", "perceptron", "trees")


def candidates(rows: int, width: int, seed: int = 42) -> dict:
    """For each name a function from prepared rows to a fitted model.

    Regression, boosting and forest are balanced over classes; the perceptron takes rows as they come.
    """
    arrays = lambda d, weight: d.select(vector_to_array("vector").alias("features"), F.col("label").cast("int").alias("label"), weight.alias("weight"))
    return {
        "logistic": logistic(rows).fit,
        "boosted": lambda d: fit_boosted(arrays(d, F.col("weight")), width),
        "perceptron": lambda d: fit_perceptron(arrays(d, F.lit(1.0)), width, seed=seed)[0],
        "trees": RandomForestClassifier(featuresCol="vector", labelCol="label", weightCol="weight", numTrees=60, maxDepth=8, seed=seed).fit,
    }


def predict(model, df: DataFrame) -> DataFrame:
    """Adds probs and pred; classes that a model did not see have probability 0."""
    if isinstance(model, (Boosted, Perceptron)):
        return apply_probabilities(df.withColumn("features", vector_to_array("vector")), model).drop("features")
    probs = vector_to_array("probability")
    padded = F.slice(F.concat(probs, F.array_repeat(F.lit(0.0), len(K.CLASSES))), 1, len(K.CLASSES))
    return model.transform(df).withColumn("probs", padded).withColumn("pred", argmax(F.col("probs")))


def fit_candidates(train: DataFrame, val: DataFrame, test: DataFrame, columns: Sequence[str], truth: str, names: Sequence[str]) -> tuple[dict, DataFrame]:
    """The fitted models by name, and their metrics on val and test (model, split, ...)."""
    ready = {s: checkpointed(with_vectors(d, columns, truth)) for s, d in (("train", train), ("val", val), ("test", test))}
    made = candidates(ready["train"].count(), len(columns))
    fitted, parts = {}, []
    for name in names:
        fitted[name] = made[name](ready["train"])
        for split in ("val", "test"):
            scored = predict(fitted[name], ready[split])
            parts.append(scored.select(F.lit(name).alias("model"), F.lit(split).alias("split"), F.col(truth).alias("truth"), "pred"))
    whole = parts[0]
    for other in parts[1:]:
        whole = whole.unionByName(other)
    return fitted, checkpointed(evaluate(whole, ["model", "split"]))


def place_of(names: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), F.col("model"))


def train_meta(train: DataFrame, val: DataFrame, test: DataFrame, columns: Sequence[str] = K.FEATURES, truth: str = "truth", names: Sequence[str] = CANDIDATES):
    """(name, model, metrics): every candidate's metrics on val and test, and the best by val weighted F1."""
    fitted, metrics = fit_candidates(train, val, test, columns, truth, names)
    best = metrics.where(F.col("split") == "val").orderBy(F.desc("weighted_f1"), place_of(names)).first()["model"]
    return best, fitted[best], metrics


def train_balanced(train: DataFrame, val: DataFrame, test: DataFrame, key: str, columns: Sequence[str] = K.FEATURES, truth: str = "truth", names: Sequence[str] = CANDIDATES[:3], floor: float = 0.55, k: int = 5, seed: int = 42):
    """(name, calibrated, metrics): training that favours frustration, as one operation.

    SMOTE raises every class of train; the candidates are fitted on it; the best by frustration recall
    above the floor of weighted F1 on val is taken and calibrated on val. calibrated: the rows of test
    with probs, calibrated and pred, the largest calibrated class. metrics: all candidates on val and
    test, and the calibrated model on test under the split `calibrated`.
    """
    raised = smote(train.where(F.col(truth).isNotNull()), columns, truth, key, k, seed)
    rows = checkpointed(raised.select(F.col("label").alias(truth), *[F.get("features", i).alias(c) for i, c in enumerate(columns)]))
    fitted, metrics = fit_candidates(rows, val, test, columns, truth, names)
    summary = metrics.where(F.col("split") == "val").select(place_of(names).alias("place"), "model", "weighted_f1", "frustration_recall", "frustration_f1")
    best = select_with_floor(summary, floor).first()["model"]
    scored = [predict(fitted[best], with_vectors(d, columns, truth)).drop("rawPrediction", "probability", "prediction") for d in (val, test)]
    calibrated = calibrate(scored[0], scored[1], "probs", truth).withColumn("pred", argmax(F.col("calibrated"))).drop("vector", "label", "weight")
    final = evaluate(calibrated.select(F.lit(best).alias("model"), F.lit("calibrated").alias("split"), F.col(truth).alias("truth"), "pred"), ["model", "split"])
    return best, calibrated, metrics.unionByName(final)


def smote(df: DataFrame, columns: Sequence[str], label: str, key: str, k: int = 5, seed: int = 42, block: int = 5000) -> DataFrame:
    """key, label, features (array) of all rows, and of new ones that raise every class to the largest.

    Each new row lies on the way from a row to one of its k nearest in the whole class, both drawn by
    seeded hashes. The nearest are exact, in cells of about `block` rows, of which those that cannot hold a
    neighbour are skipped. Keys are unique; a class of one row is its own neighbour.
    """
    rows = feature_vector(df, columns, "features").select(F.col(key).cast("string").alias("key"), F.col(label).cast("int").alias("label"), "features")
    numbered = ranked(rows, ["label"], [seeded(seed, F.col("key"))], "_at", "_n")
    # One row is one class.
    sizes = rows.groupBy(F.col("label").alias("l")).agg(F.count("*").alias("n")).select("l", F.max("n").over(Window.partitionBy()).alias("most"))
    numbered = numbered.join(F.broadcast(sizes), F.col("label") == F.col("l"))
    # Row `at` gives the new rows at, at + n, at + 2n, ... below most - n.
    missing = F.col("most") - F.col("_n")
    share = F.when(F.col("_at") < missing % F.col("_n"), 1).otherwise(0) + F.floor(missing / F.col("_n"))
    held = checkpointed(numbered.select("key", "label", "features", share.cast("int").alias("share"), (missing > 0).alias("short"), F.col("_at").alias("at"), F.col("_n").alias("n")))
    best, _ = nearest_in_class(held.where("short").select("label", "key", "features", "at", "n", (F.col("share") > 0).alias("asks")), k, block)
    new = held.where("share > 0").join(best, ["label", "key"], "left").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("share") - 1)))
    pick = seeded_int(seed, F.col("key"), F.col("j"), F.lit("near")) % F.greatest(F.lit(1), F.size("near"))
    way = seeded_int(seed, F.col("key"), F.col("j"), F.lit("way")) / F.lit(float(2**32))
    drawn = new.select("label", "key", "features", "j", way.alias("way"), F.coalesce(F.get("near", pick.cast("int"))["other"], F.col("key")).alias("other"))
    to = held.select(F.col("label").alias("to_label"), F.col("key").alias("to_key"), F.col("features").alias("to"))
    joined = drawn.join(to, (F.col("label") == F.col("to_label")) & (F.col("other") == F.col("to_key")))
    between = F.zip_with("features", "to", lambda a, b: a + F.col("way") * (b - a))
    return held.select("key", "label", "features").unionByName(joined.select(F.concat("key", F.lit("+"), F.col("j").cast("string")).alias("key"), "label", between.alias("features")))


def select_with_floor(summary: DataFrame, floor: float = 0.55) -> DataFrame:
    """The candidate of best frustration recall with weighted F1 at the floor; else of best frustration F1.

    summary: place, model, weighted_f1, frustration_recall, frustration_f1 on validation.
    """
    fits = F.col("weighted_f1") >= floor
    return summary.orderBy(F.desc(fits), F.desc(F.when(fits, F.col("frustration_recall")).otherwise(F.col("frustration_f1"))), "place").limit(1).withColumn("met_floor", fits)


def calibrate(val: DataFrame, test: DataFrame, probs: str = "probs", truth: str = "truth") -> DataFrame:
    """test with calibrated: isotonic per class, fitted one against the rest on val, rows scaled to 1.

    A row that gets 0 for every class gets equal shares.
    """
    out, parts = test, []
    for k in range(len(K.CLASSES)):
        rows = val.where(F.col(truth).isNotNull()).select(F.get(F.col(probs), k).alias("_f"), (F.col(truth) == k).cast("double").alias("_y"))
        model = IsotonicRegression(featuresCol="_f", labelCol="_y", predictionCol=f"_c{k}").fit(rows)
        out = model.transform(out.withColumn("_f", F.get(F.col(probs), k))).drop("_f")
        parts.append(F.col(f"_c{k}"))
    total = sum(parts[1:], parts[0])
    scaled = F.array(*[F.when(total > 0, p / F.when(total > 0, total)).otherwise(1.0 / len(parts)) for p in parts])
    return out.withColumn("calibrated", scaled).drop(*[f"_c{k}" for k in range(len(K.CLASSES))])


def ablation(train: DataFrame, test: DataFrame, truth: str = "truth", subsets: dict = ABLATIONS) -> DataFrame:
    """Metrics on test of one balanced logistic regression per component subset, best first."""
    rows, parts = train.count(), None
    for name, components in subsets.items():
        columns = feature_columns(components)
        model = logistic(rows).fit(with_vectors(train, columns, truth))
        scored = predict(model, with_vectors(test, columns, truth)).select(F.lit(name).alias("configuration"), F.col(truth).alias("truth"), "pred")
        parts = scored if parts is None else parts.unionByName(scored)
    return evaluate(parts, ["configuration"]).orderBy(F.desc("weighted_f1"), "configuration")


def ablation_deltas(results: DataFrame, full: str = "Full") -> DataFrame:
    """How weighted F1 and frustration recall change when a component is left out."""
    whole = Window.partitionBy()
    of = lambda c: F.max(F.when(F.col("configuration") == full, F.col(c))).over(whole)
    deltas = results.select("configuration", (F.col("weighted_f1") - of("weighted_f1")).alias("delta_weighted_f1"), (F.col("frustration_recall") - of("frustration_recall")).alias("delta_frustration_recall"))
    return deltas.where(F.col("configuration").startswith("No "))


def balanced_resample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """As many rows as df, drawn with replacement with weight 1 / rows of their class; with draw, their number.

    Each draw names a class, all alike, and a place in it by seeded hashes. Rows are ranked within
    their class and joined with the draws that name them. One row is one class. Rows without a label are
    a class too, the last one, so the draws of the others do not depend on whether it is kept.
    """
    rows = ranked(df, [label], [F.col(key)], "_at", "_n")
    rows = checkpointed(rows)
    sizes = rows.groupBy(F.col(label).alias("_l")).agg(F.max("_n").alias("_size"))
    placed = checkpointed(sizes.withColumn("_place", F.row_number().over(Window.orderBy(F.asc_nulls_last("_l"))) - 1))
    total = placed.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("n"), F.count("*").alias("classes")).first()
    bits = lambda what: F.conv(F.substring(seeded(seed, F.col("draw"), F.lit(what)), 1, 13), 16, 10).cast("bigint")
    draws = df.sparkSession.range(total["n"]).select(F.col("id").alias("draw")).select("draw", (bits("class") % max(total["classes"], 1)).alias("_p"), (bits("row") / F.lit(float(2**52))).alias("_u"))
    chosen = draws.join(F.broadcast(placed), F.col("_p") == F.col("_place")).select("draw", "_l", F.floor(F.col("_u") * F.col("_size")).alias("_to"))
    joined = rows.join(chosen, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_at") == F.col("_to")))
    return joined.select(*df.columns, "draw")
