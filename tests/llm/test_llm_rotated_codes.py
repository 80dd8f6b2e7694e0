"""Nearest neighbours against brute force; recall on vectors of several shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.llm import rotated_codes
from callweave.llm.rotated_codes import fit_centres, nearest_vectors, rotation, usable

SCHEMA = "vec_id bigint, embedding array<double>"


def slow(ids, x, k=20, every=20):
    out = {}
    for i in range(len(ids)):
        if ids[i] % every == 0:
            score = np.cumsum(x * x[i], axis=1)[:, -1]
            order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
            out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def shapes():
    random = np.random.default_rng(5)
    centres = random.normal(size=(12, 32)) * 3
    yield "off centre", random.normal(size=(1500, 32)) + 4
    yield "clustered", centres[random.integers(0, 12, 1500)] + random.normal(size=(1500, 32)) * 0.3
    yield "lengths", random.normal(size=(1500, 32)) * random.lognormal(0, 1, (1500, 1))
    yield "few dimensions", random.normal(size=(800, 3))
    yield "one dimension", random.normal(size=(300, 1))
    yield "copies", np.repeat(random.normal(size=(40, 16)), 30, axis=0)


@pytest.mark.parametrize("name,x", list(shapes()), ids=lambda v: v if isinstance(v, str) else "")
def test_recall_and_scores(spark, monkeypatch, name, x):
    monkeypatch.setattr(rotated_codes, "GROUP_QUERIES", 16)
    ids = np.random.default_rng(6).permutation(len(x)) + 1
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], SCHEMA)
    got, want = result(nearest_vectors(df, part_rows=200)), slow(ids, x)
    assert got.keys() == want.keys()
    assert all(len(got[q]) == len(want[q]) for q in want)
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)  # ids with their scores, equal to the last bit
    assert hits >= 0.99 * sum(map(len, want.values()))
    if name == "copies":
        assert got == want  # equal scores go to the smaller ids


def test_odd_vectors(spark):
    rows = [(20, [1.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (40, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [2.0, 4.0]), (8, [1.0, 2.0, 0.0]), (9, [-1.0, -2.0]), (7, [2.0, 4.0]), (None, [5.0, 5.0]), (60, [1.0, 0.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", row string, part int")
    got = result(nearest_vectors(df))
    assert got == {20: [(7, 10.0), (7, 10.0), (9, -5.0)], 60: [(8, 1.0)]}
    assert nearest_vectors(df.limit(0)).collect() == []
    one = nearest_vectors(df.where("vec_id = 20"))
    assert one.collect() == [] and one.columns == ["query_id", "rank", "vec_id", "score"]
    large = spark.createDataFrame([(20, [1e200, 1e200]), (1, [1e200, 1.0]), (2, [1.0, 1.0])], SCHEMA)
    assert [i for i, _ in result(nearest_vectors(large))[20]] == [1, 2]


def test_other_queries_and_sizes(spark):
    x = np.random.default_rng(8).normal(size=(60, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    got = result(nearest_vectors(df, F.col("id") == 3, k=5))
    assert list(got) == [3] and got[3] == slow(np.arange(60), x, 5, 1)[3]


def test_index_is_fitted_on_a_bounded_sample(spark):
    x = np.random.default_rng(9).normal(size=(3000, 8))
    vectors = usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA), "vec_id", "embedding")
    assert {d: len(c) for d, c in fit_centres(vectors, sample_rows=320).items()} == {8: 20}
    turn = rotation(8)
    assert np.allclose(turn @ turn.T, np.eye(8)) and (turn == rotation(8)).all()
