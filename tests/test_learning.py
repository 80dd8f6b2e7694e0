"""Learned fusion on tables whose right answer is known."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.functions import constants as K
from callweave.functions.expr import argmax
from callweave.operators import features, fusion, learning, metrics, prediction


def separable(spark, n, seed, informative=K.FEATURES[:5]):
    """Rows of five classes: the informative columns name the class, all others are noise."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        truth = i % 5
        values = [(1.0 if k % 5 == truth else 0.0) + rng.uniform(-0.1, 0.1) if c in informative else rng.uniform(0, 1) for k, c in enumerate(K.FEATURES)]
        rows.append((i, truth, *values))
    return spark.createDataFrame(rows, ", ".join(["vec_id bigint", "truth int", *[f"{c} double" for c in K.FEATURES]])).coalesce(2)


@pytest.fixture(scope="module")
def parts(spark):
    return [separable(spark, n, s) for n, s in ((200, 1), (60, 2), (60, 3))]


def test_every_candidate_learns_a_separable_table(parts):
    best, model, table = learning.train_meta(*parts)
    found = {(r["model"], r["split"]): r for r in table.collect()}
    assert len(found) == 8 and all(r["n"] == 60 for r in found.values())
    assert all(found["logistic", s]["weighted_f1"] == pytest.approx(1.0) and found["trees", s]["weighted_f1"] > 0.9 for s in ("val", "test"))
    top = max(r["weighted_f1"] for (m, s), r in found.items() if s == "val")
    assert best == next(m for m in ("logistic", "boosted", "perceptron", "trees") if found[m, "val"]["weighted_f1"] == top)
    again = learning.predict(model, learning.with_vectors(parts[2]))
    assert metrics.evaluate(again).first()["weighted_f1"] == pytest.approx(1.0)


def test_ablation_finds_the_component_that_decides(parts):
    found = {r["configuration"]: r["weighted_f1"] for r in learning.ablation(parts[0], parts[2]).collect()}
    assert set(found) == set(learning.ABLATIONS)
    assert all(f == pytest.approx(1.0) for n, f in found.items() if "text" in learning.ABLATIONS[n])
    assert all(f < 0.5 for n, f in found.items() if "text" not in learning.ABLATIONS[n])


def test_apply_meta_gives_the_probabilities_of_the_model(parts):
    train, _, test = parts
    ready = learning.with_vectors(train)
    model = learning.logistic(ready.count()).setFeaturesCol("_features").fit(ready.withColumnRenamed("vector", "_features"))
    weights, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    rows = fusion.apply_meta(features.feature_vector(test), model).collect()
    for r in rows:
        logits = weights @ np.array(r["features"]) + intercepts
        want = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
        assert r["meta_probs"] == pytest.approx(want.tolist(), abs=1e-9)
        assert r["pred"] == want.argmax() == r["truth"] and r["confidence"] == pytest.approx(want.max())
    records = prediction.predict_utterances(test.withColumn("text", F.lit("x")), model=model, threshold=0.5, keys=["vec_id"]).collect()
    assert {r["vec_id"]: r["predicted_emotion"] for r in records} == {r["vec_id"]: K.CLASSES[r["truth"]] for r in rows}
    assert all(r["should_handover"] == (r["predicted_emotion"] in ("anger", "frustration")) for r in records)


def test_balanced_training_raises_the_rare_class(spark, parts):
    train = parts[0].where("truth <> 1 OR vec_id < 30")
    best, calibrated, table = learning.train_balanced(train, parts[1], parts[2], "vec_id")
    found = {(r["model"], r["split"]): r for r in table.collect()}
    assert set(found) == {(m, s) for m in ("logistic", "boosted", "perceptron") for s in ("val", "test")} | {(best, "calibrated")}
    assert all(r["weighted_f1"] > 0.95 and r["frustration_recall"] > 0.9 for r in found.values())
    rows = calibrated.collect()
    assert len(rows) == 60 and all(sum(r["calibrated"]) == pytest.approx(1) for r in rows)
    assert found[best, "calibrated"]["accuracy"] == pytest.approx(sum(r["pred"] == r["truth"] for r in rows) / 60)


def test_calibration_equals_pooled_means(spark):
    rows = [([s, 1 - s, 0.0, 0.0, 0.0], y) for s, y in ((0.1, 1), (0.2, 0), (0.3, 1), (0.6, 0), (0.7, 1), (0.9, 0))]
    df = spark.createDataFrame(rows, "probs array<double>, truth int")
    found = {r["probs"][0]: r["calibrated"] for r in learning.calibrate(df, df).collect()}
    # Isotonic means of class 0 by its score: 0, (1 0) -> 0.5, (1 0) -> 0.5, 1; class 1 is its mirror image.
    for s, want in ((0.1, 0.0), (0.2, 0.5), (0.3, 0.5), (0.6, 0.5), (0.7, 0.5), (0.9, 1.0)):
        assert found[s] == pytest.approx([want, 1 - want, 0, 0, 0])


def test_smote_goes_to_the_nearest_of_the_whole_class(spark):
    rng = np.random.default_rng(2)
    small, large = rng.normal(size=(60, 2)), rng.normal(size=(400, 2)) + 50
    rows = [(i, 1, *map(float, x)) for i, x in enumerate(small)] + [(1000 + i, 0, *map(float, x)) for i, x in enumerate(large)]
    df = spark.createDataFrame(rows, "id int, y int, a double, b double")
    made = learning.smote(df, ["a", "b"], "y", "id", k=3, block=16).collect()
    assert sum(r["label"] == 1 for r in made) == sum(r["label"] == 0 for r in made) == 400 and len({r["key"] for r in made}) == 800
    assert sorted(r["key"] for r in made if "+" not in r["key"]) == sorted(str(r[0]) for r in rows)
    for r in made:
        if "+" in r["key"]:
            base, new = small[int(r["key"].split("+")[0])], np.array(r["features"])
            near = np.argsort(((small - base) ** 2).sum(1))[1:4]
            ways = [(np.dot(new - base, small[j] - base) / np.dot(small[j] - base, small[j] - base), j) for j in near]
            assert any(-1e-9 <= w <= 1 and np.allclose(base + w * (small[j] - base), new) for w, j in ways)


def test_smote_of_a_single_row_repeats_it(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0), (2, 0, 3.0), (3, 1, 9.0)], "id int, y int, x double")
    assert sorted(r["features"][0] for r in learning.smote(df, ["x"], "y", "id").where("label = 1").collect()) == [9.0] * 3


def test_resampling_draws_with_replacement(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") < 3600, 0).otherwise(F.col("id") % 4 + 1).alias("y"))
    made = learning.balanced_resample(df, "y", "id")
    counts = {r["y"]: r["n"] for r in made.groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert sum(counts.values()) == 4000 and all(abs(n - 800) < 120 for n in counts.values())
    copies = made.groupBy("y", "id").count().groupBy("y").agg(F.max("count").alias("most"), F.count("*").alias("rows")).collect()
    by = {r["y"]: r for r in copies}
    assert by[0]["most"] >= 2 and by[0]["rows"] < counts[0]  # rows of the large class are drawn twice too
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, learning.balanced_resample(df.repartition(7), "y", "id").collect()))
    assert learning.balanced_resample(df.limit(0), "y", "id").count() == 0


def test_records_hold_scores_and_decision(spark):
    row = ("k", "hello", [0.5, 0.2, 0.1, 0.1, 0.1], [0.3, 0.4, 0.1, 0.1, 0.1])
    df = spark.createDataFrame([row, ("n", None, None, None)], "audio_id string, text string, text_probs array<double>, audio_probs array<double>")
    found = {r["audio_id"]: r for r in prediction.predict_utterances(df, {"text": 1.0, "audio": 1.0}, threshold=0.6, keys=["audio_id"]).collect()}
    one = found["k"]
    assert (one["text"], one["predicted_emotion"], one["should_handover"], one["threshold"]) == ("hello", "anger", True, 0.6)
    assert one["confidence"] == pytest.approx(0.4) and one["handover_score"] == pytest.approx(0.7)
    assert one["meta_probs"].asDict() == pytest.approx(dict(zip(K.CLASSES, [0.4, 0.3, 0.1, 0.1, 0.1])))
    assert one["details"]["text_probs"] == row[2] and one["details"]["audio_probs"] == row[3]
    assert found["n"]["predicted_emotion"] is None and found["n"]["should_handover"] is False
    with pytest.raises(ValueError):
        prediction.predict_utterances(df)


def test_argmax_of_calibrated_ties_is_the_first(spark):
    assert spark.createDataFrame([([0.5, 0.5, 0.0],)], "p array<double>").select(argmax(F.col("p"))).first()[0] == 0


def test_smote_needs_few_rows_of_a_large_class(spark):
    df = spark.createDataFrame([(i, 0 if i < 40 else 1, float(i)) for i in range(70)], "id int, y int, x double")
    made = learning.smote(df, ["x"], "y", "id", k=2, block=4).collect()
    new = [r for r in made if "+" in r["key"]]
    assert len(made) == 80 and len(new) == 10 and all(r["label"] == 1 and r["key"].endswith("+0") for r in new)
    assert all(abs(r["features"][0] - int(r["key"].split("+")[0])) <= 2 for r in new)
