"""The rules that are easy to get wrong, on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from callweave.functions.expr import argmax, ranked, round_binary
from callweave.operators import agreement, curation, errors, features, fusion, handover, labels, learning, metrics, prediction, projection
from callweave.plans import sampling
from callweave.sources import io
from callweave.streaming.live import ROCKSDB, stream_handover


def column(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()]


def test_argmax_takes_the_first_largest(spark):
    df = spark.createDataFrame([([0.2] * 5,), ([0.1, 0.4, 0.4, 0.1, 0.0],)], "p array<double>")
    assert column(df.select(argmax(F.col("p")).alias("a")), "a") == [0, 1]


@pytest.mark.parametrize("compound, hard, soft", [(-0.31, "anger", 0), (-0.3, "sadness", 2), (-0.05, "sadness", 3), (0.1, "neutral", 3), (0.2, "neutral", 4), (0.3, "neutral", 4), (0.31, "satisfaction", 4)])
def test_lexicon_edges(spark, compound, hard, soft):
    row = projection.lexicon_probs(projection.lexicon_class(spark.createDataFrame([(compound,)], "vader_compound double"))).first()
    assert row["predicted_class"] == hard
    assert max(range(5), key=lambda k: (row["lexicon_probs"][k], -k)) == soft


def call(spark, *probs, utterances=None):
    ids = utterances or range(len(probs))
    return spark.createDataFrame([(1, u, p, 0) for u, p in zip(ids, probs)], "dialogue_id int, utterance_id int, probs array<double>, truth int")


def test_trend_needs_a_full_window(spark):
    sad = [0.1, 0.1, 0.7, 0.1, 0.0]
    assert column(handover.first_trigger(call(spark, sad, sad), 0.6, 3), "trigger_utt") == [-1]
    assert column(handover.first_trigger(call(spark, sad, sad, sad), 0.6, 3), "trigger_utt", "trigger_reason") == [(2, "sustained_negative_trend")]


def test_threshold_is_strict_and_instant_names_the_reason(spark):
    at = [0.3, 0.0, 0.0, 0.7, 0.0]
    assert column(handover.first_trigger(call(spark, at), 0.3, 3), "trigger_utt") == [-1]
    strong = [0.9, 0.0, 0.1, 0.0, 0.0]
    assert column(handover.first_trigger(call(spark, strong, strong, strong), 0.9, 3), "trigger_reason") == ["sustained_negative_trend"]
    assert column(handover.first_trigger(call(spark, at, at, strong), 0.5, 3), "trigger_utt", "trigger_reason") == [(2, "instant_strong_emotion")]


def test_positions_ignore_gaps_and_nulls_count_zero(spark):
    calm, strong = [0.0, 0.0, 0.0, 1.0, 0.0], [0.9, None, 0.0, 0.1, 0.0]
    assert column(handover.first_trigger(call(spark, calm, calm, strong, utterances=[0, 2, 5]), 0.6, 3), "trigger_utt") == [2]


def test_handover_parameters_are_checked(spark):
    for t, w in ((0, 3), (1.1, 3), (0.5, 0)):
        with pytest.raises(ValueError):
            handover.handover_events(call(spark, [1.0, 0.0, 0.0, 0.0, 0.0]), t, w)


def test_latency_is_negative_when_the_trigger_comes_first(spark):
    rows = [(7, u, [0.9, 0.0, 0.0, 0.1, 0.0] if u == 2 else [0.0, 0.0, 0.0, 1.0, 0.0], 0 if u == 14 else 3) for u in range(15)]
    made = handover.replay_conversations(spark.createDataFrame(rows, "dialogue_id int, utterance_id int, probs array<double>, truth int"), 0.6, 3)
    assert column(made, "first_neg_utt", "trigger_utt", "latency_utt") == [(14, 2, -12)]


def test_macro_f1_is_over_classes_that_occur(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 0)], "truth int, pred int")
    row = metrics.evaluate(df).first()
    assert row["macro_f1"] == pytest.approx((2 / 3 + 1 + 1 + 0) / 4) and row["accuracy"] == 0.75
    assert metrics.confusion_matrix(df).count() == 25


def test_vote_ties_go_to_the_best_model(spark):
    one = lambda k: [1.0 if i == k else 0.0 for i in range(5)]
    df = spark.createDataFrame([(one(1), one(2), one(2), one(1))], "text_probs array<double>, goemo_probs array<double>, lexicon_probs array<double>, audio_probs array<double>")
    assert column(fusion.majority_vote(df), "pred") == [1]
    assert column(fusion.majority_vote(df, ("goemo", "text", "lexicon", "audio")), "pred") == [2]


def test_fusion_weights_must_be_positive(spark):
    with pytest.raises(ValueError):
        fusion.late_fusion(spark.createDataFrame([([0.2] * 5,)], "text_probs array<double>"), {"text": 0.0})


def test_split_rounds_half_to_even(spark):
    df = spark.range(1235).select(F.col("id"), F.lit("x").alias("label"))
    counts = {r["split"]: r["count"] for r in labels.stratified_split(df, "label", ["id"]).groupBy("split").count().collect()}
    assert counts == {"test": 124, "val": 124, "train": 987}


def test_ranks_do_not_depend_on_partitions(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"))
    made = ranked(df.repartition(7), ["g"], [F.col("id")])
    assert made.where("rank <> id div 3").count() == 0 and made.count() == 500


def test_first_failing_rule_is_reported(spark):
    cases = {
        "": "empty",
        "two words": "too_short(2w)",
        " ".join(["w"] * 61): "too_long(61w)",
        "this is a nice day \U0001f600": "emoji",
        '"this is a quoted line"': "wrapped_in_quotes",
        "well the customer is not amused": "banned_phrase('the customer')",
        "my style: rather loud today": "axis_leak",
        "nothing is wrong with this": "ok",
    }
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    assert {r["text"]: r["reason"] for r in curation.heuristic_reason(df).collect()} == cases


def test_normalise_is_idempotent(spark):
    df = spark.createDataFrame([(" “Hi” — it’s…  ​ok\t ",), (None,)], "text string")
    once = curation.normalise_text(df)
    assert column(once, "text") == ['"Hi" - it\'s... ok', ""]
    assert column(curation.normalise_text(once), "text") == column(once, "text")


def test_judge_answers(spark):
    answers = ['```json\n{"score": 4, "intensity_obs": 2}\n```', 'sure: {"score": 5} bye', "no", '{"score": ', None]
    made = curation.parse_judge_json(spark.createDataFrame([(a,) for a in answers], "response string"))
    assert column(made, "parsed", "score", "natural") == [(True, 4, True), (True, 5, True), (False, None, None), (False, None, None), (False, None, None)]


def test_filter_keeps_every_row_once_and_the_latest_verdict_counts(spark):
    df = spark.createDataFrame([(1, "this is a good line"), (2, "short"), (3, "this one has no verdict")], "id int, text string")
    verdicts = spark.createDataFrame([(1, False, "low_judge_score(1)", 1, 1, True, 1.0), (1, True, "", 5, 2, True, 2.0)], "id int, ok boolean, fail_reason string, score int, intensity_obs int, natural boolean, ts double")
    made = {r["id"]: (r["kept"], r["reject_reason"]) for r in curation.apply_filter(df, verdicts).collect()}
    assert made == {1: (True, None), 2: (False, "too_short(1w)"), 3: (False, "judge_no_verdict")}


def test_threshold_falls_back_to_f1(spark):
    df = spark.createDataFrame([(0.5, 3), (0.6, 3), (0.65, 0)], "p_handover double, truth int")
    sweep = errors.threshold_sweep(df)
    assert sweep.count() == 41 and sweep.where("TP + FP + FN + TN <> 3").count() == 0
    assert errors.select_threshold(sweep, 0.5).first()["threshold"] == 0.6
    none = errors.select_threshold(errors.threshold_sweep(df.where("truth = 3")), 0.5).first()
    assert none["threshold"] == 0.3 and not none["met_floor"]


def test_sweep_agrees_with_single_thresholds(spark):
    df = spark.range(300).select((F.col("id") % 101 / 100).alias("p_handover"), (F.col("id") % 5).cast("int").alias("truth"))
    sweep = {r["threshold"]: r for r in errors.threshold_sweep(df).collect()}
    for t in (0.3, 0.35, 0.57, 0.7):
        assert errors.evaluate_threshold(df, t).first().asDict() == pytest.approx(sweep[t].asDict())


def test_kappa_of_one_class_is_zero(spark):
    df = spark.createDataFrame([(1, "anger", "a", 0, "anger"), (2, "anger", "a", 0, "anger")], "audio_id int, label_truth string, annotator string, place int, label string")
    assert column(agreement.agreement_with_truth(df), "accuracy", "kappa") == [(1.0, 0.0)]


def test_combination_space_and_rules(spark):
    rules = sampling.rules_table(spark)
    assert {r["label"]: r["combinations"] for r in sampling.combination_space(rules).collect()} == {"anger": 2880, "frustration": 4608, "sadness": 2304, "neutral": 720, "satisfaction": 1152}
    df = spark.createDataFrame([("anger",)] * 3, "label string")
    assert {r["label"]: r["n"] for r in sampling.class_deficit(df, 10, {"anger": 5}, 0.5).collect()} == {"anger": 2, "frustration": 0, "sadness": 0, "neutral": 0, "satisfaction": 0}


def test_prompt_hash_equals_python(spark):
    import hashlib

    point = {"label": "anger", "intensity": 3, "cause": "wait_time", "style": "sarcastic", "persona": "business_user", "turn_position": "opening"}
    df = spark.createDataFrame([(0, *point.values())], "idx bigint, label string, intensity int, cause string, style string, persona string, turn_position string")
    row = sampling.generation_plan(df).first()
    assert row["prompt_hash"] == "sha1:" + hashlib.sha1(json.dumps(point, sort_keys=True).encode()).hexdigest()[:16]
    assert row["id"] == "anger_00000"


def test_keys_that_do_not_parse_are_errors(spark):
    df = spark.createDataFrame([("nothing",)], "path string")
    with pytest.raises(Exception, match="no dialogue key"):
        labels.parse_dialogue_key(df).collect()
    with pytest.raises(Exception, match="no split"):
        labels.split_from_id(df, "path").collect()


def test_groups_never_cross_splits(spark):
    df = spark.createDataFrame([(a, i) for a in ("1051", "1085", "1001") for i in range(3)], "actor_id string, i int")
    assert labels.group_disjoint_split(df).groupBy("actor_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_missing_text_columns_and_counts_are_errors(spark):
    a = spark.createDataFrame([("train_1", "x", "anger")], "audio_id string, text string, true_label string")
    with pytest.raises(KeyError):
        features.attach_text_model(a, spark.createDataFrame([("train_1",)], "audio_id string"))


def test_deduplication_keeps_one_row_of_each_text(spark):
    rows = [(1, "a b"), (1, "A b"), (None, "c d"), (7, "e"), (7, "e"), (3, " e "), (None, "e"), (2, "f"), (2, "f ")]
    df = spark.createDataFrame(rows, "ts int, text string").repartition(4)
    found = sorted(column(curation.dedupe_text(df, "ts"), "ts", "text"), key=str)
    assert sorted(t.strip() for _, t in found) == ["A b", "a b", "c d", "e", "f"] and (3, " e ") in found and (None, "c d") in found
    keyed = curation.dedupe_text(df.withColumn("k", F.when(F.col("ts") == 3, 1)), "ts", ["k"])
    assert sorted(t.strip() for t in column(keyed, "text")) == ["A b", "a b", "c d", "e", "e", "f"]
    assert curation.dedupe_text(df.limit(0), "ts").count() == 0


def test_word_edits_equal_a_slow_recursion(spark):
    import random

    def slow(a, b):
        if not a or not b:
            return len(a) + len(b)
        return min(slow(a[1:], b) + 1, slow(a, b[1:]) + 1, slow(a[1:], b[1:]) + (a[0] != b[0]))

    rng = random.Random(5)
    pairs = [[" ".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(2)] for _ in range(40)]
    row = metrics.word_error_rate(spark.createDataFrame(pairs, "ref string, hyp string")).first()
    edits, words = sum(slow(a.split(), b.split()) for a, b in pairs), sum(len(a.split()) for a, _ in pairs)
    assert (row["edits"], row["words"]) == (edits, words) and row["wer"] == pytest.approx(edits / words)


def test_histogram_has_every_bin(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 0.5), (None, 2.0), ("b", None)], "true_label string, vader_compound double")
    made = metrics.score_histogram(df, bins=4).collect()
    counts = {(r["true_label"], r["bin"]): r["n"] for r in made}
    assert len(made) == 12 and sum(counts.values()) == 4
    assert [counts["a", k] for k in range(4)] == [1, 0, 0, 1] and counts["b", 2] == 1


def test_models_come_best_first(spark):
    df = spark.createDataFrame([(m, t, t if m == "good" else 0) for m in ("bad", "good") for t in range(5)], "model string, truth int, pred int")
    assert column(metrics.model_comparison(df, "bad"), "model") == ["good", "bad"]


def test_a_cluster_must_name_its_checkpoint_folder():
    from types import SimpleNamespace

    from callweave.functions.expr import checkpoint_folder

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None, getConf=lambda: {})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_folder(SimpleNamespace(sparkContext=context))


def test_word_error_rate(spark):
    df = spark.createDataFrame([("a b c d", "a x c"), ("e f", "e f"), (None, "x")], "ref string, hyp string")
    row = metrics.word_error_rate(df).first()
    assert (row["edits"], row["words"], row["passed"]) == (3, 6, False)


def test_best_epoch_stops_after_patience(spark):
    df = spark.createDataFrame([("r", e, s) for e, s in enumerate([0.1, 0.3, 0.2, 0.3, 0.9], 1)], "run string, epoch int, val_wf1 double")
    assert column(metrics.best_epoch(df, 2), "best_epoch", "stop_epoch", "best_score") == [(2, 4, 0.3)]
    assert column(metrics.best_epoch(df, 4), "best_epoch", "stop_epoch") == [(5, None)]


def test_calibration_rows_sum_to_one(spark):
    rows = [([0.2, 0.2, 0.2, 0.2, 0.2], 0), ([0.8, 0.1, 0.1, 0.0, 0.0], 0), ([0.0, 0.0, 0.0, 0.0, 1.0], 4)]
    df = spark.createDataFrame(rows, "probs array<double>, truth int")
    assert all(sum(r["calibrated"]) == pytest.approx(1) for r in learning.calibrate(df, df).collect())


def test_smote_fills_every_class(spark):
    df = spark.createDataFrame([(i, 0 if i < 20 else 1, float(i)) for i in range(27)], "id int, y int, x double")
    made = learning.smote(df, ["x"], "y", "id")
    assert {r["label"]: r["count"] for r in made.groupBy("label").count().collect()} == {0: 20, 1: 20}
    low, high = made.where("label = 1").select(F.min(F.get("features", 0)), F.max(F.get("features", 0))).first()
    assert 20 <= low and high <= 26


def test_files_round_trip(spark, tmp_path):
    assert io.read_threshold(spark, str(tmp_path / "none.json"), 0.6).first()["threshold"] == 0.6
    io.write_report(spark.createDataFrame([(0.3,)], "threshold double"), str(tmp_path / "t"))
    assert io.read_threshold(spark, str(tmp_path / "t")).first()["threshold"] == 0.3
    io.write_report(spark.createDataFrame([(1,)], "other int"), str(tmp_path / "o"))
    assert io.read_threshold(spark, str(tmp_path / "o"), 0.5).first()["threshold"] == 0.5
    (tmp_path / "x.jsonl").write_text('{"id": "a", "n": 1}\n\nbroken\n{"id": "b", "n": 2}\n')
    assert sorted(column(io.read_jsonl(spark, str(tmp_path / "x.jsonl"), "id string, n int"), "id")) == ["a", "b"]
    (tmp_path / "p.csv").write_text('text,score\n"a, ""b""",0.5\n')
    assert column(io.read_predictions(spark, str(tmp_path / "p.csv"), "text string, score double"), "text", "score") == [('a, "b"', 0.5)]
    for name in ("b.wav", "a.wav", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert column(io.list_clips(spark, str(tmp_path)), "name") == ["a.wav", "b.wav"]
    io.write_features(spark.createDataFrame([("train", 1), ("val", 2)], "split string, x int"), str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).where("split = 'val'").count() == 1


def test_stream_equals_batch_over_micro_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    calm, sad, strong = [0.0, 0.0, 0.0, 1.0, 0.0], [0.1, 0.1, 0.6, 0.2, 0.0], [0.9, 0.0, 0.0, 0.1, 0.0]
    calls = {1: [calm, sad, sad, sad, strong], 2: [calm, strong, strong], 3: [calm] * 4}
    rows = [(d, u, p) for d, ps in calls.items() for u, p in enumerate(ps)]
    schema = "dialogue_id int, utterance_id int, probs array<double>"
    df = spark.createDataFrame(rows, schema)
    for part in range(5):
        df.where(F.col("utterance_id") == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stream_handover(stream, 0.6, 3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    out.awaitTermination()
    live = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = sorted(tuple(r) for r in handover.first_trigger(df, 0.6, 3).where("trigger_utt >= 0").collect())
    assert live == batch


def test_manifest_rows_have_all_fields(spark):
    axes = ", ".join(f"{a} string" for a in sampling.AXES)
    rows = [("a", "anger", 0, "t", "5", "c", "s", "p", "u", "alloy", "sha1:0", 4, True), ("b", "anger", 0, None, "5", "c", "s", "p", "u", "ash", "sha1:1", None, None), ("failed", "anger", 0, "t", "5", "c", "s", "p", "u", "ash", "sha1:1", 1, False)]
    records = spark.createDataFrame(rows, f"id string, label string, label_id int, text string, {axes}, voice string, instruction_hash string, judge_score int, judge_natural boolean")
    clips = spark.createDataFrame([("a", 0.0625, 16000, "x\\y\\a.wav", 1.0), ("a", 8.1225, 16000, "x\\y\\a2.wav", 2.0), ("b", None, None, None, None), ("other", 1.0, 1, "o", 1.0)], "id string, duration_sec double, sample_rate int, audio_path string, ts double")
    made = sampling.manifest_rows(records, clips, "m")
    assert len(made.columns) == 19
    found = {r["audio_id"]: r for r in made.collect()}
    assert set(found) == {"a", "b"}
    one, two = found["a"], found["b"]
    assert (one["duration_sec"], one["sample_rate"], one["audio_path"], one["ts"], one["model"]) == (round(8.1225, 3), 16000, "x/y/a2.wav", 2.0, "m")
    assert (one["judge_score"], one["judge_intensity_obs"], one["judge_natural"]) == ("4", "", "True")
    assert (two["judge_score"], two["judge_natural"], two["duration_sec"], two["audio_path"], two["text"]) == ("", "", None, None, None)
    assert sampling.manifest_rows(records.limit(0), clips, "m").count() == 0


def test_rounding_is_that_of_the_double(spark):
    values = [k / 16000 for k in range(0, 400000, 8)] + [0.0625, -0.0625, 0.1875, -1.0005, 2.675, 1e11 + 0.0005, 3e15, -0.0004]
    found = spark.createDataFrame([(v,) for v in values], "x double").select("x", round_binary(F.col("x"), 3).alias("y")).collect()
    assert all(r["y"] == round(r["x"], 3) for r in found)
    assert spark.sql("SELECT CAST(NULL AS DOUBLE) AS x, CAST('NaN' AS DOUBLE) AS n").select(round_binary(F.col("x"), 3), round_binary(F.col("n"), 3)).first()[0] is None


def test_timings_of_records(spark):
    df = spark.createDataFrame([("k", "t", [0.5, 0.2, 0.1, 0.1, 0.1], 0.5, None), ("l", "t", None, 1.0, 0.25)], "audio_id string, text string, text_probs array<double>, a double, b double")
    records = prediction.predict_utterances(df, {"text": 1.0}, keys=["audio_id"], timings={"asr": "a", "text": "b"})
    found = {r["audio_id"]: r["timings"].asDict() for r in records.collect()}
    assert found == {"k": {"asr": 0.5, "text": None, "total": 0.5}, "l": {"asr": 1.0, "text": 0.25, "total": 1.25}}
    assert {tuple(r) for r in prediction.stage_seconds(records, "audio_id").collect()} == {("k", "asr", 0.5), ("k", "total", 0.5), ("l", "asr", 1.0), ("l", "text", 0.25), ("l", "total", 1.25)}
