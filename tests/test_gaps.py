"""Scores with gaps: missing vectors, elements, scores and truths; answers of unusual types; columns of unusual names."""

import numpy as np
import pytest
from compare import assert_same, connect
from pyspark.sql import functions as F

from callweave.functions.expr import argmax, own_prefix, ranked
from callweave.operators import curation, errors, features, fusion, handover, learning, metrics, projection
from callweave.queries import ORACLES, QUERIES
from callweave.queries.registry import WEIGHTS, probs

VECTORS = "id int, truth int, text_probs array<double>, goemo_probs array<double>, lexicon_probs array<double>, audio_probs array<double>"


def test_sweep_equals_single_thresholds_with_gaps(spark):
    rows = [(None, 1), (0.9, 1), (0.1, 3), (None, 3), (float("nan"), 0), (0.5, 0), (0.5000001, 2), (0.31, None), (0.7, -1)]
    df = spark.createDataFrame(rows, "p_handover double, truth int")
    sweep = {r["threshold"]: tuple(r) for r in errors.threshold_sweep(df).collect()}
    assert len(sweep) == 41
    for t in (0.3, 0.31, 0.5, 0.7):
        assert sweep[t] == tuple(errors.evaluate_threshold(df, t).first())
    assert sweep[0.5][1:5] == (1, 2, 3, 2)


def test_reports_and_decisions_read_the_same_score(spark):
    df = spark.createDataFrame([(1, [0.7, None, 0.1, 0.1, 0.1]), (1, None), (1, [0.2, 0.3])], "truth int, probs array<double>")
    both = handover.instant_decision(errors.error_report(df), 0.6).select("p_handover", "handover_score", "tier").collect()
    assert [r["p_handover"] for r in both] == [r["handover_score"] for r in both] == [0.7, 0.0, 0.5]
    assert both[1]["tier"] == "A_FN_frustration"  # not predicted, so missed


def vectors(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        own = [rng.dirichlet(np.ones(5) * 0.6).tolist() for _ in range(4)]
        if i % 5 == 0:
            own[i % 4] = None
        if i % 7 == 0 and own[1]:
            own[1][i % 5] = None
        rows.append((i, [i % 5, -1, None, 7][0 if i % 9 else i // 9 % 4], *own))
    rows.append((99, 0, None, None, None, None))
    return rows, spark.createDataFrame(rows, VECTORS).repartition(3)


def test_grids_read_missing_scores_as_zero(spark):
    rows, df = vectors(spark)
    grid = [(0.5, 0.3, 0.1, 0.1), (0.0, 0.0, 0.0, 1.0), (0.1, 0.2, 0.3, 0.4)]
    found = {(r["grid_id"], r["truth"], r["pred"]): r["n"] for r in fusion.grid_counts(df, ("text", "goemo", "lexicon", "audio"), grid).collect()}
    want = {}
    for _, truth, *own in rows:
        if truth in range(5) and any(own):
            filled = np.array([[0.0 if x is None else x for x in (v or [0.0] * 5)] for v in own])
            for g, weights in enumerate(grid):
                key = (g, truth, int((np.array(weights)[:, None] * filled).sum(0).argmax()))
                want[key] = want.get(key, 0) + 1
    assert found == want
    assert fusion.tune_late_weights(df).count() == fusion.tune_text_weights(df).count() == 1
    late = {r["id"]: r["fused"] for r in fusion.late_fusion(df, {"text": 1.0, "audio": 1.0}).collect()}
    assert late[99] is None and all(len(v) == 5 for k, v in late.items() if k != 99)


def test_projections_of_missing_scores(spark):
    df = spark.createDataFrame([(None, None, None, None, None), (0.5, 0.2, None, 0.1, None)], "vader_compound double, sb_ang double, sb_hap double, sb_sad double, sb_neu double")
    rows = projection.audio_class(projection.audio_probs(projection.lexicon_probs(projection.lexicon_class(df)))).collect()
    assert all(rows[0][c] is None for c in ("lexicon_probs", "audio_probs", "predicted_class"))
    assert rows[1]["audio_probs"] == [0.2, 0.0, 0.1, 0.0, 0.0] and rows[1]["predicted_class"] == "anger"
    goemo = spark.createDataFrame([(None, 0.4), (None, None)], "goemo_anger double, goemo_joy double")
    assert [r["goemo_probs"] for r in projection.goemo_probs(goemo, normalise=True).collect()] == [[0.0, 0.0, 0.0, 0.0, 1.0], None]


#: As a plain reader of JSON takes them: score, intensity_obs, natural, reason.
ANSWERS = [
    ('{"score": "4", "intensity_obs": 3}', (4, 3, True, "")),
    ('{"score": 4, "natural": "yes"}', (4, 0, True, "")),
    ('{"verdict": 1}', (0, 0, True, "")),
    ('{"score": 4.9, "natural": 0, "reason": "x"}', (4, 0, False, "x")),
    ('{"score": true, "natural": "", "intensity_obs": -2}', (1, -2, False, "")),
    ('{"natural": null, "reason": null}', (0, 0, False, "None")),
    ('{"natural": [], "score": 1}', (1, 0, False, "")),
    ('{"natural": {"a": 1}, "score": " 5 "}', (5, 0, True, "")),
    ('{"natural": "false", "score": [3]}', (0, 0, True, "")),
    ('{"natural": false, "score": "many"}', (0, 0, False, "")),
    ("```json\n{\"score\": 2}\n```", (2, 0, True, "")),
    ('Sure: {"score": 3, "reason": "fine"} ok', (3, 0, True, "fine")),
    ("{}", None), ("[1]", None), ("no", None), ("", None), (None, None), ('{"score": ', None), ("4", None),
]


def test_answers_of_any_type(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(ANSWERS)], "id int, response string")
    for r in curation.parse_judge_json(df).collect():
        want = ANSWERS[r["id"]][1]
        assert r["parsed"] == (want is not None), ANSWERS[r["id"]]
        assert (want or (None,) * 4) == (r["score"], r["intensity_obs"], r["natural"], r["reason"]), ANSWERS[r["id"]]


def test_own_columns_give_way_to_given_ones(spark):
    df = spark.createDataFrame([(i, i % 2, "p", "some text of five words") for i in range(9)], "id int, _part int, _clean string, text string")
    rows = ranked(df, ["_part"], [F.col("id")], "rank", "size").collect()
    assert all(r["_part"] == r["id"] % 2 and r["rank"] == r["id"] // 2 and r["size"] == 5 - r["_part"] for r in rows)
    kept = curation.heuristic_reason(df).first()
    assert kept["_clean"] == "p" and kept["reason"] == "ok"
    assert own_prefix(["a", "__B", "_x"]) == "___"


def test_texts_that_are_missing_match_each_other(spark):
    base = spark.createDataFrame([(1, None, "a"), (2, "t", None), (3, "t", "a")], "id int, text string, true_label string")
    other = spark.createDataFrame([(1, None, "a", 0.1), (2, "t", None, 0.2), (3, "t", "a", 0.3), (4, "t", "a", 0.4)], "id int, text string, true_label string, x double")
    assert sorted((r["id"], r["x"]) for r in features.join_on_text(base, other, key="id").collect()) == [(1, 0.1), (2, 0.2), (3, 0.3)]


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Calls whose turns repeat few texts, so that rows with every gap share text and label with others."""
    path = str(tmp_path_factory.mktemp("repeated"))
    rows = [(c, t, None if t == 4 else "user", None if (c + t) % 29 == 0 else f"text {c % 3}") for c in range(60) for t in range(5)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.mark.parametrize("name", ["j4_join_on_text", "g10_balanced_resample"])
def test_repeated_texts_and_missing_labels_equal_sql(spark, repeated, name):
    assert_same(QUERIES[name](spark, repeated), connect(repeated), ORACLES[name])


def test_the_first_score_of_a_text_is_taken(spark):
    base = spark.createDataFrame([(1, "t", "a"), (2, "u", "a")], "id int, text string, true_label string")
    other = spark.createDataFrame([(1, "t", "a", None), (2, "t", "a", 0.2), (3, "t", "a", 0.3), (4, "u", "a", None)], "id int, text string, true_label string, x double")
    assert sorted((r["id"], r["x"]) for r in features.join_on_text(base, other, key="id").collect()) == [(1, 0.2), (2, None)]


def test_rows_without_a_label_are_drawn_as_the_last_class(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 3) for i in range(300)], "id int, y int")
    made = learning.balanced_resample(df, "y", "id").collect()
    assert len(made) == 300
    labelled = learning.balanced_resample(df.fillna({"y": 3}), "y", "id").collect()  # as the last label
    assert sorted((r["id"], r["draw"]) for r in made) == sorted((r["id"], r["draw"]) for r in labelled)


def filters(df):
    """The filters of the optimized plan, as text."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter")]


def test_metrics_do_not_filter_what_is_predicted(spark, repeated):
    rows = probs(spark, repeated)
    made = fusion.compare_strategies({"late": fusion.late_fusion(rows, WEIGHTS), "vote": fusion.majority_vote(rows)})
    assert not [f for f in filters(made) if "conv_id" in f]  # nothing that is computed from the scan's columns


def test_a_filter_on_the_vote_names_each_vector_once(spark, repeated):
    def named(df):
        return sum(f.count("conv_id") for f in filters(df))

    rows = probs(spark, repeated)
    each = sum(named(rows.where(argmax(F.col(f"{m}_probs")).isNotNull())) for m in ("text", "goemo", "lexicon", "audio"))
    assert 0 < named(fusion.majority_vote(rows).where("pred IS NOT NULL")) <= each


def test_groups_without_a_truth_or_a_prediction_have_no_cells(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", None, 1), ("a", 2, None), ("b", None, 3), ("b", 3, None), ("c", -1, 0), (None, 0, 0)], "g string, truth int, pred int")
    cells = metrics.confusion_matrix(df, ["g"]).collect()
    assert sorted((str(r["g"]), r["truth"], r["pred"], r["n"]) for r in cells if r["n"]) == [("None", 0, 0, 1), ("a", 1, 1, 1)]
    assert len(cells) == 75  # of a, c and the group without a name
    assert metrics.confusion_matrix(df.limit(0), ["g"]).count() == 0
    assert {r["n"] for r in metrics.confusion_matrix(df.where("g = 'b'")).collect()} == {0}
