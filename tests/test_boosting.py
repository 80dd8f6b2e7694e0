"""Boosting, the perceptron and exact neighbours against single-process versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.operators import boosting, learning, neighbours
from callweave.operators.features import feature_vector

SCHEMA = "id int, features array<double>, label int, weight double"


def table(spark, x, y, weight=None):
    weight = np.ones(len(y)) if weight is None else weight
    return spark.createDataFrame([(i, v.tolist(), int(t), float(w)) for i, (v, t, w) in enumerate(zip(x, y, weight))], SCHEMA)


def additive(seed, n=600):
    """A class by the sum of eight features, which no single shallow tree follows."""
    x = np.random.default_rng(seed).integers(0, 2, (n, 8)).astype(float)
    return x, np.clip(x.sum(1).astype(int) - 2, 0, 4)


def hits(df, model):
    rows = boosting.apply_probabilities(df, model).collect()
    assert all(sum(r["probs"]) == pytest.approx(1) for r in rows)
    return np.mean([r["pred"] == r["label"] for r in rows])


def test_boosting_follows_sums_that_a_forest_of_equal_depth_does_not(spark):
    (x, y), (u, v) = additive(1), additive(2, 300)
    train, test = table(spark, x, y).repartition(3), table(spark, u, v).repartition(2)
    model = boosting.fit_boosted(train, 8, rounds=40, depth=2, rate=0.5, bins=8)
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    ready = [d.withColumn("vector", array_to_vector("features")) for d in (train, test)]
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=60, maxDepth=2, seed=1).fit(ready[0]).transform(ready[1])
    of_forest = forest.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert hits(test, model) > 0.8 > of_forest + 0.15


def slow_boosted_split(x, y, weight, cuts, penalty, least):
    """The first split of the tree of each class, found one cut at a time."""
    out = []
    for k in range(5):
        g, h = weight * (0.2 - (y == k)), weight * 0.16
        best = (1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            for c in cuts[f]:
                left = x[:, f] <= c
                gl, hl, ga, ha = g[left].sum(), h[left].sum(), g.sum(), h.sum()
                if min(hl, ha - hl) >= least:
                    gain = gl**2 / (hl + penalty) + (ga - gl) ** 2 / (ha - hl + penalty) - ga**2 / (ha + penalty)
                    if gain > best[0] + 1e-12:
                        best = (gain, f, c)
        out.append(best[1:])
    return out


def test_splits_and_weights_equal_a_plain_search(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 6, (200, 3)).astype(float), rng.integers(0, 5, 200)
    weight = np.where(y == 1, 4.0, 1.0)
    model = boosting.fit_boosted(table(spark, x, y, weight).repartition(4), 3, rounds=1, depth=1, bins=16)
    cuts = [np.unique(np.percentile(x[:, f], np.arange(1, 16) / 16 * 100, method="inverted_cdf")) for f in range(3)]
    want = slow_boosted_split(x, y, weight, cuts, 1.0, 1.0)
    for k, tree in enumerate(model.rounds[0]):
        assert (tree.feature[0], tree.cut[0]) == want[k]
        if want[k][0] >= 0:
            left = x[:, want[k][0]] <= want[k][1]
            g, h = weight * (0.2 - (y == k)), weight * 0.16
            assert tree.value[1] == pytest.approx(-g[left].sum() / (h[left].sum() + 1)) and tree.value[2] == pytest.approx(-g[~left].sum() / (h[~left].sum() + 1))
    heavy = boosting.fit_boosted(table(spark, x[:, :1] * 0, y % 2, np.where(y % 2, 9.0, 1.0)), 1, rounds=3, depth=1)
    assert heavy.probabilities(np.zeros((1, 1)))[0].argmax() == 1  # nothing to split on: the heavy class wins


def plain_perceptron(x, y, held, hidden, rounds, rate, penalty):
    model = boosting.start_perceptron(x.shape[1], hidden)
    flat = np.concatenate([p.ravel() for layer in model.layers for p in layer])
    shapes, m, s = [p.shape for layer in model.layers for p in layer], 0, 0
    scores = []
    for step in range(1, rounds + 1):
        parts, at = [], 0
        for shape in shapes:
            parts.append(flat[at : at + np.prod(shape)].reshape(shape))
            at += np.prod(shape)
        model = boosting.Perceptron(list(zip(parts[::2], parts[1::2])))
        scores.append(np.log(model.probabilities(x[held])[np.arange(held.sum()), y[held]]).mean())
        _, gradients = model.gradients(x[~held], y[~held], np.ones((~held).sum()))
        g = np.concatenate([v.ravel() for v in gradients]) / (~held).sum() + penalty * flat
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g**2
        flat = flat - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return scores


@pytest.mark.parametrize("parts", [1, 5])
def test_perceptron_equals_one_process(spark, parts):
    x, y = additive(5, 200)
    df = table(spark, x, y).repartition(parts)
    model, scores = boosting.fit_perceptron(df, 8, hidden=(7,), rounds=6, patience=99, key="id")
    held = np.zeros(200, bool)
    held[[r["id"] for r in df.where(boosting.seeded_int(42, F.col("id")) % 10 == 0).collect()]] = True
    assert scores == pytest.approx(plain_perceptron(x, y, held, (7,), 6, 0.02, 1e-4)) and 5 < held.sum() < 40


def test_perceptron_stops_and_keeps_its_best(spark):
    x, y = additive(6, 300)
    model, scores = boosting.fit_perceptron(table(spark, x, y), 8, hidden=(16,), rounds=60, rate=0.2, patience=4, key="id")
    best = int(np.argmax(scores))
    assert len(scores) <= 60 and (len(scores) == 60 or len(scores) - 1 - best >= 4)
    grads = model.gradients(x[:5], y[:5], np.ones(5))[1]
    model.layers[0][0][2, 3] += 1e-6
    up = model.gradients(x[:5], y[:5], np.ones(5))[0]
    model.layers[0][0][2, 3] -= 2e-6
    assert grads[0][2, 3] == pytest.approx((up - model.gradients(x[:5], y[:5], np.ones(5))[0]) / 2e-6, abs=1e-5)


def test_neighbours_are_exact_and_cells_are_skipped(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 4)) * 30
    x = np.concatenate([centres[rng.integers(0, 12, 500)] + rng.normal(size=(500, 4)), np.repeat(centres[:1], 80, axis=0), rng.normal(size=(120, 4))])
    label = np.r_[np.zeros(580, int), np.ones(120, int)]
    rows = []
    for c in (0, 1):
        mine = np.flatnonzero(label == c)
        rows += [(c, f"k{i:04}", x[i].tolist(), int(at), len(mine), bool(i % 3 == 0)) for at, i in enumerate(rng.permutation(mine))]
    df = spark.createDataFrame(rows, "label int, key string, features array<double>, at int, n int, asks boolean").repartition(3)
    near, visits = neighbours.nearest_in_class(df, 4, block=30)
    found = {r["key"]: [(round(g["gap"], 6), g["other"]) for g in r["near"]] for r in near.collect()}
    asked = [r for r in rows if r[5]]
    assert set(found) == {r[1] for r in asked}
    for c, key, v, *_ in asked:
        gaps = sorted((round(float(neighbours.distances(np.array([v]), np.array([r[2]]))[0, 0]), 6), r[1]) for r in rows if r[0] == c and r[1] != key)
        assert [g for g, _ in found[key]] == pytest.approx([g for g, _ in gaps[:4]], abs=1e-5)
    of_large = visits.where("label = 0").count()
    parts = 580 // 30
    assert of_large < 0.4 * parts * sum(r[0] == 0 for r in asked)  # most parts are skipped


def test_four_candidates_are_tried(spark):
    assert learning.CANDIDATES == ("logistic", "boosted", "perceptron", "trees")
    assert set(learning.candidates(10, 4)) == set(learning.CANDIDATES)
    assert feature_vector(spark.createDataFrame([(1.0,)], "vader_pos double")).count() == 1
