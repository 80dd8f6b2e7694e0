"""Published results, re-computed from the rows or counts that they sum up."""

import pytest
from pyspark.sql import functions as F

from callweave.operators import errors, handover, labels, metrics

#: Weighted F1 on validation after each epoch of a published training run.
VAL_WF1 = [0.00335, 0.00335, 0.00336, 0.17575, 0.21566, 0.35689, 0.43734, 0.48190, 0.49515, 0.53759, 0.57127, 0.56082, 0.59107, 0.56649, 0.62097, 0.58559, 0.56423, 0.58598, 0.58845, 0.59676, 0.57977, 0.58825, 0.61155]
#: From each threshold (in hundredths) to the next, true and false positives and frustration recall.
PLATEAUS = [(30, 111, 65, 0.5), (33, 110, 65, 0.475), (36, 108, 65, 0.475), (37, 107, 64, 0.475), (39, 107, 63, 0.475), (40, 107, 62, 0.475), (41, 106, 62, 0.45), (43, 106, 60, 0.45), (48, 105, 60, 0.425), (50, 104, 60, 0.425), (51, 104, 59, 0.425), (52, 104, 58, 0.425), (53, 104, 57, 0.425), (54, 104, 56, 0.425), (55, 102, 56, 0.425), (59, 100, 55, 0.4), (64, 100, 54, 0.4), (65, 99, 54, 0.4), (67, 98, 54, 0.4), (68, 97, 54, 0.4), (70, 97, 53, 0.4)]
POSITIVE, NEGATIVE = 215, 743


def test_the_published_run_stops_eight_epochs_after_its_best(spark):
    df = spark.createDataFrame([("run", e, s) for e, s in enumerate(VAL_WF1, 1)], "run string, epoch int, val_wf1 double")
    assert tuple(metrics.best_epoch(df, 8).select("best_epoch", "stop_epoch").first()) == (15, 23)


def test_the_published_sweep_selects_its_threshold(spark):
    rows = []
    for t in range(30, 71):
        _, tp, fp, recall = max(p for p in PLATEAUS if p[0] <= t)
        rows.append((t / 100, tp, fp, POSITIVE - tp, NEGATIVE - fp, round(recall * 40), 40))
    counts = spark.createDataFrame(rows, "threshold double, TP long, FP long, FN long, TN long, frust_hits long, frust_rows long")
    sweep = errors.binary_metrics(counts)
    best = errors.select_threshold(sweep).first()
    assert (sweep.count(), best["threshold"], best["met_floor"]) == (41, 0.3, True)
    assert [round(best[c], 3) for c in ("handover_precision", "handover_recall", "handover_f1", "frustration_recall")] == [0.631, 0.516, 0.568, 0.5]


def test_the_published_replay_sums_up(spark):
    """279 calls: 151 of 170 negative ones caught, 83 utterances early in all; 49 of 109 clean ones handed over."""
    early = spark.range(151).select(F.lit(True).alias("has_negative"), F.lit(True).alias("caught"), F.lit(False).alias("false_handover"), F.lit(3).alias("trigger_utt"), F.when(F.col("id") < 83, -1).otherwise(0).alias("latency_utt"), F.lit("instant_strong_emotion").alias("trigger_reason"))
    missed = spark.range(19).selectExpr("true", "false", "false", "-1", "CAST(NULL AS INT)", "'ok'")
    wrong = spark.range(49).selectExpr("false", "false", "true", "2", "CAST(NULL AS INT)", "'sustained_negative_trend'")
    quiet = spark.range(60).selectExpr("false", "false", "false", "-1", "CAST(NULL AS INT)", "'ok'")
    calls = early.union(missed).union(wrong).union(quiet).withColumn("length", F.lit(8))
    row = handover.handover_summary(calls).first()
    assert [row[c] for c in ("calls", "with_negative", "clean", "caught", "missed", "false_handovers", "triggered")] == [279, 170, 109, 151, 19, 49, 200]
    assert [round(row[c], 4) for c in ("recall", "precision", "false_rate", "mean_latency")] == [0.8882, 0.755, 0.4495, -0.5497]
    assert {r["trigger_reason"]: r["n"] for r in handover.reason_counts(calls).collect()} == {"instant_strong_emotion": 151, "sustained_negative_trend": 49}


def test_the_published_split_sizes(spark):
    sizes = {"anger": 4494, "frustration": 5621, "sadness": 3673, "neutral": 1235, "satisfaction": 4257}
    df = None
    for name, n in sizes.items():
        part = spark.range(n).select(F.col("id"), F.lit(name).alias("label"))
        df = part if df is None else df.unionByName(part)
    counts = {r["split"]: r["count"] for r in labels.stratified_split(df, "label", ["label", "id"]).groupBy("split").count().collect()}
    assert sum(sizes.values()) == 19280 and counts == {"train": pytest.approx(15424, abs=2), "val": pytest.approx(1928, abs=2), "test": pytest.approx(1928, abs=2)}
