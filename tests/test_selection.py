"""Exact percentiles by selection, and word edits by bits."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callweave.functions.quantiles import percentiles
from callweave.operators import metrics


def test_a_million_distinct_values_of_one_stage(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("s").alias("stage"), (F.pmod(F.col("id") * 7919, F.lit(n)) + 0.25).alias("latency_ms"))
    made = metrics.latency_summary(df)
    row = made.first()
    assert (row["n"], row["median"], row["max"]) == (n, (n - 1) / 2 + 0.25, n - 1 + 0.25)
    assert row["p90"] == pytest.approx(0.9 * (n - 1) + 0.25, abs=1e-6)
    plan = made._jdf.queryExecution().toString()
    assert "ObjectHashAggregate" not in plan and "percentile(" not in plan


@pytest.mark.parametrize("few", [4, 4096])
def test_percentiles_of_hard_values(spark, few):
    rng = np.random.default_rng(1)
    groups = {
        "long tail": np.exp(rng.normal(0, 60, 500)),
        "signs": rng.normal(0, 1, 301) * 10.0 ** rng.integers(-12, 12, 301),
        "hot": np.concatenate([np.full(400, 3.0), rng.uniform(0, 6, 101)]),
        "one": np.array([5.0]),
        "two": np.array([-1.0, 2.0]),
        "large": np.array([1e308, -1e308, 1.0, 0.0]),
        "tiny": np.array([5e-324, 0.0, -5e-324, 1e-320]),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [(None, 1.0), (None, 3.0), ("none", None), ("none", float("nan")), ("one", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    shares = {"least": 0.0, "low": 0.1, "median": 0.5, "high": 0.9, "most": 1.0}
    found = {r["g"]: r for r in percentiles(df, "x", shares, ["g"], bins=8, few=few).collect()}
    assert set(found) == {*groups, None} and found[None]["median"] == 2.0
    for g, xs in groups.items():
        ordered = sorted(xs)
        for name, q in shares.items():
            at = q * (len(xs) - 1)
            low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
            assert found[g][name] == low + (high - low) * (at - np.floor(at)), (g, name)
    assert percentiles(df.where("g = 'none'"), "x", shares, ["g"]).count() == 0
    whole = percentiles(df.where("g = 'hot'"), "x", {"median": 0.5}).collect()
    assert [r["median"] for r in whole] == [3.0]


def slow_edits(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, line[0] = line[0], i
        for j, y in enumerate(b, 1):
            corner, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, corner + (x != y))
    return line[-1]


def test_edits_of_many_pairs():
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choice("abcde") for _ in range(n))
    sizes = [0, 1, 2, 5, 9, 20, 63, 64, 65]
    pairs = [(words(rng.choice(sizes[:6])), words(rng.choice(sizes[:6]))) for _ in range(10_000)] + [(words(a), words(b)) for a in sizes for b in (*sizes, 130)] + [(words(200), words(190)), (None, "a"), ("a", None), (None, None)]
    made = metrics.edit_distances(pd.Series([p[0] for p in pairs]), pd.Series([p[1] for p in pairs]))
    want = [(slow_edits((a or "").split(), (b or "").split()), len((a or "").split())) for a, b in pairs]
    assert list(made.itertuples(index=False, name=None)) == want
    assert len(metrics.edit_distances(pd.Series([], dtype=object), pd.Series([], dtype=object))) == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), max_size=70), st.lists(st.sampled_from("abc"), max_size=70)), min_size=1, max_size=5))
def test_edits_by_bits(pairs):
    made = metrics.edit_distances(pd.Series([" ".join(a) for a, _ in pairs]), pd.Series([" ".join(b) for _, b in pairs]))
    assert made["edits"].tolist() == [slow_edits(a, b) for a, b in pairs]


def test_long_texts_cost_one_step_for_a_word(spark):
    text = " ".join(str(i % 977) for i in range(6000))
    df = spark.createDataFrame([(text, text + " more"), (text, text[4:])], "ref string, hyp string")
    assert tuple(metrics.word_error_rate(df).first())[:2] == (3, 12000)
