"""Errors, thresholds, handover and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import agreement as V
from ..operators import errors as E
from ..operators import handover as H
from .registry import NAME, WITH_FUSED, confusion_sql, fused, query, rounded, table
from .streams import late_triggers, stream_triggers

_REPORT = f"""{WITH_FUSED}, tiers AS (SELECT *, list_max(fused) AS confidence, fused[1] + fused[2] AS p_handover,
  CASE WHEN truth = pred THEN 'correct' WHEN truth = 1 THEN 'A_FN_frustration' WHEN pred = 1 THEN 'B_FP_frustration' WHEN truth IN (0, 1, 2) AND pred IN (0, 1, 2) THEN 'C_confusion_negatives' WHEN truth IN (0, 1, 2) AND pred = 3 THEN 'C_missed_negative_as_neutral' ELSE 'other' END AS tier FROM fused),
report AS (SELECT *, CAST(CASE substr(tier, 1, 2) WHEN 'A_' THEN 3 WHEN 'B_' THEN 2 WHEN 'C_' THEN 1 ELSE 0 END AS INT) AS severity FROM tiers)"""
_LINE = f"audio_id, CAST(pred AS INT) AS pred, {NAME.format('pred')} AS predicted_class, round(confidence, 6) AS confidence, round(p_handover, 6) AS p_handover, tier, severity"
LINE = ("audio_id", "pred", "predicted_class", "confidence", "p_handover", "tier", "severity")


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.error_report(fused(spark, sf_dir), "fused")


@query(f"{_REPORT} SELECT {_LINE} FROM report")
def e1_error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report(spark, sf_dir).select(*LINE), "confidence", "p_handover")


@query(f"{_REPORT} SELECT {_LINE} FROM report WHERE severity > 0 ORDER BY severity DESC, report.confidence DESC, audio_id LIMIT 20")
def e2_top_k_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.top_k_errors(report(spark, sf_dir), 20, "audio_id").select(*LINE), "confidence", "p_handover")


@query(f"{_REPORT} SELECT tier, severity, count(*) AS n FROM report WHERE tier <> 'correct' GROUP BY ALL")
def e3_tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tier_counts(report(spark, sf_dir))


_METRICS = ("handover_precision", "handover_recall", "handover_f1", "frustration_recall")
_SWEEP = f"""{_REPORT}, grid AS (SELECT unnest([{", ".join(f"{round(0.3 + i * 0.01, 4)!r}::DOUBLE" for i in range(41))}]) AS threshold),
marks AS (SELECT threshold, truth IN (0, 1) AS pos, truth = 1 AS frust, p_handover > threshold AS says FROM grid CROSS JOIN report),
sums AS (SELECT threshold, count(*) FILTER (pos AND says) AS TP, count(*) FILTER (NOT pos AND says) AS FP, count(*) FILTER (pos AND NOT says) AS FN, count(*) FILTER (NOT pos AND NOT says) AS TN, count(*) FILTER (frust AND says) AS fh, count(*) FILTER (frust) AS fr FROM marks GROUP BY threshold),
sweep AS (SELECT threshold, TP, FP, FN, TN, CASE WHEN TP + FP = 0 THEN 0 ELSE TP / (TP + FP) END AS handover_precision, CASE WHEN TP + FN = 0 THEN 0 ELSE TP / (TP + FN) END AS handover_recall,
  CASE WHEN 2 * TP + FP + FN = 0 THEN 0 ELSE 2 * TP / (2 * TP + FP + FN) END AS handover_f1, fh / greatest(fr, 1) AS frustration_recall FROM sums)"""
_SHOWN = "threshold, TP, FP, FN, TN, " + ", ".join(f"round({m}, 6) AS {m}" for m in _METRICS)


@query(f"{_SWEEP} SELECT {_SHOWN} FROM sweep")
def e4_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.threshold_sweep(report(spark, sf_dir)), *_METRICS)


@query(f"""{_SWEEP} SELECT {_SHOWN}, sweep.handover_precision > 0.5 AS met_floor FROM sweep ORDER BY sweep.handover_precision > 0.5 DESC, CASE WHEN sweep.handover_precision > 0.5 THEN sweep.frustration_recall ELSE sweep.handover_f1 END DESC,
CASE WHEN sweep.handover_precision > 0.5 THEN sweep.handover_recall END DESC, threshold LIMIT 1""")
def e5_select_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.select_threshold(E.threshold_sweep(report(spark, sf_dir))), *_METRICS)


@query(f"{_SWEEP} SELECT {_SHOWN} FROM sweep WHERE threshold = 0.5::DOUBLE")
def e6_evaluate_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.evaluate_threshold(report(spark, sf_dir), 0.5), *_METRICS)


T, W = 0.6, 3
_EVENTS = f"""{WITH_FUSED}, m AS (SELECT dialogue_id, utterance_id, truth, fused[1] + fused[2] AS instant, fused[1] + fused[2] + fused[3] AS mass, row_number() OVER d - 1 AS position FROM fused WINDOW d AS (PARTITION BY dialogue_id ORDER BY utterance_id)),
r AS (SELECT *, CASE WHEN count(*) OVER f = 3 THEN sum(mass) OVER f / 3 END AS trend FROM m WINDOW f AS (PARTITION BY dialogue_id ORDER BY utterance_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
events0 AS (SELECT *, CASE WHEN instant > 0.6::DOUBLE THEN 'instant_strong_emotion' WHEN trend > 0.6::DOUBLE * 0.7::DOUBLE THEN 'sustained_negative_trend' ELSE 'ok' END AS reason FROM r),
calls AS (SELECT dialogue_id, count(*) AS length, count(*) FILTER (truth IN (0, 1)) AS n_negative_utts, coalesce(min(position) FILTER (truth IN (0, 1)), -1) AS first_neg_utt,
  coalesce(min(position) FILTER (reason <> 'ok'), -1) AS trigger_utt, coalesce(arg_min(reason, position) FILTER (reason <> 'ok'), 'ok') AS trigger_reason FROM events0 GROUP BY dialogue_id),
replay AS (SELECT dialogue_id, length, n_negative_utts > 0 AS has_negative, n_negative_utts, CAST(first_neg_utt AS INT) AS first_neg_utt, CAST(trigger_utt AS INT) AS trigger_utt, trigger_reason, n_negative_utts > 0 AND trigger_utt >= 0 AS caught,
  n_negative_utts = 0 AND trigger_utt >= 0 AS false_handover, CAST(CASE WHEN n_negative_utts > 0 AND trigger_utt >= 0 THEN trigger_utt - first_neg_utt END AS DOUBLE) AS latency_utt FROM calls)"""


@query(f"{_EVENTS} SELECT dialogue_id, utterance_id, round(instant, 6) AS handover_score, instant > 0.6::DOUBLE AS handover FROM events0")
def h1_instant_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.instant_decision(fused(spark, sf_dir), T, "fused").select("dialogue_id", "utterance_id", "handover_score", "handover"), "handover_score")


@query(f"{_EVENTS} SELECT dialogue_id, utterance_id, round(trend, 6) AS trend_score FROM events0")
def h2_rolling_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.rolling_negative(fused(spark, sf_dir), W, probs="fused").select("dialogue_id", "utterance_id", "trend_score"), "trend_score")


@query(f"{_EVENTS} SELECT dialogue_id, utterance_id, CAST(position AS INT) AS position, reason <> 'ok' AS handover, reason FROM events0")
def h3_handover_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.handover_events(fused(spark, sf_dir), T, W, probs="fused").select("dialogue_id", "utterance_id", "position", "handover", "reason")


@query(f"{_EVENTS} SELECT dialogue_id, trigger_utt, trigger_reason FROM replay")
def h4_first_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.first_trigger(fused(spark, sf_dir), T, W, probs="fused")


@query(f"{_EVENTS} SELECT * FROM replay")
def h5_replay_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = H.replay_conversations(fused(spark, sf_dir), T, W, probs="fused")
    return calls.withColumn("latency_utt", F.col("latency_utt").cast("double"))


@query(f"""{_EVENTS}, s AS (SELECT count(*) AS calls, count(*) FILTER (has_negative) AS with_negative, count(*) FILTER (NOT has_negative) AS clean, count(*) FILTER (caught) AS caught, count(*) FILTER (has_negative AND NOT caught) AS missed,
  count(*) FILTER (false_handover) AS false_handovers, count(*) FILTER (trigger_utt >= 0) AS triggered, round(avg(latency_utt) FILTER (caught), 6) AS mean_latency, round(avg(length), 6) AS mean_length FROM replay)
SELECT *, round(caught / with_negative, 6) AS recall, round(caught / triggered, 6) AS precision, round(false_handovers / clean, 6) AS false_rate FROM s""")
def h6_handover_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.handover_summary(h5_replay_conversations(spark, sf_dir)), "mean_latency", "mean_length", "recall", "precision", "false_rate")


@query(f"{_EVENTS} SELECT trigger_reason, count(*) AS n FROM replay WHERE trigger_utt >= 0 GROUP BY 1")
def h7_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.reason_counts(h5_replay_conversations(spark, sf_dir))


@query(f"{_EVENTS} SELECT dialogue_id, CAST(trigger_utt AS BIGINT) AS trigger_utt, trigger_reason FROM replay WHERE trigger_utt >= 0")
def h8_stream_handover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_triggers(spark, sf_dir, T, W)


@query(f"{_EVENTS} SELECT dialogue_id, CAST(trigger_utt AS BIGINT) AS trigger_utt, trigger_reason FROM replay WHERE trigger_utt >= 0")
def h8_stream_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in any order over several micro-batches, after a history in a batch table."""
    return late_triggers(spark, sf_dir, T, W)


_SHEET = f"""SELECT doc_id AS audio_id, {NAME.format("doc_id % 5")} AS label_truth, """ + ", ".join(
    f"CASE WHEN (doc_id + {k}) % 11 <> 0 THEN {NAME.format(f'CASE WHEN (doc_id * {k}) % 10 < 3 THEN (doc_id % 5 + 1) % 5 ELSE doc_id % 5 END')} END AS annotator_{n}" for n, k in (("ana", 3), ("bea", 7), ("cai", 9))
)
_LONG = f"""WITH sheet AS ({_SHEET} FROM documents), long AS (SELECT audio_id, label_truth, 'ana' AS annotator, 0 AS place, annotator_ana AS label FROM sheet UNION ALL SELECT audio_id, label_truth, 'bea', 1, annotator_bea FROM sheet
  UNION ALL SELECT audio_id, label_truth, 'cai', 2, annotator_cai FROM sheet), valid AS (SELECT * FROM long WHERE label IS NOT NULL)"""


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SHEET + " FROM {documents}", documents=table(spark, sf_dir, "documents"))


def _kappa_sql(source: str, by: str) -> str:
    return f"""totals AS (SELECT {by}, count(*) AS n, count(*) FILTER (a = b) AS same FROM {source} GROUP BY ALL),
sides AS (SELECT {by}, a AS c, 1 AS na, 0 AS nb FROM {source} UNION ALL SELECT {by}, b, 0, 1 FROM {source}), margins AS (SELECT {by}, c, sum(na) AS na, sum(nb) AS nb FROM sides GROUP BY ALL), chances AS (SELECT {by}, sum(na * nb) AS chance FROM margins GROUP BY ALL)
SELECT {by}, n, round(same / n, 6) AS accuracy, round(CASE WHEN n * n = chance THEN 0 ELSE (n * same - chance) / (n * n - chance) END, 6) AS kappa FROM totals JOIN chances USING ({by})"""


@query("""WITH o AS (SELECT doc_id, doc_id % 5 AS label, md5('42|' || doc_id) AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, doc_id) - 1 AS place FROM o)
SELECT doc_id, label FROM r ORDER BY place >= greatest(1, 103 // (SELECT count(DISTINCT label) FROM o)), h, doc_id LIMIT 103""")
def v1_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 5).alias("label"))
    return V.stratified_sample(rows, "label", 103, ["doc_id"])


@query("SELECT doc_id AS audio_id, 'old' AS origin FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0")
def v2_extend_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("audio_id"))
    return V.extend_sheet(docs.where("audio_id % 3 = 0").withColumn("origin", F.lit("old")), docs.where("audio_id % 2 = 0").withColumn("origin", F.lit("new")))


@query(f"{_LONG} SELECT audio_id, label_truth, annotator, CAST(place AS INT) AS place, label FROM valid")
def v3_annotations_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.annotations_long(sheet(spark, sf_dir))


@query(f"{_LONG}, pairs AS (SELECT annotator, label_truth AS a, label AS b FROM valid), {_kappa_sql('pairs', 'annotator')}")
def v4_agreement_with_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.agreement_with_truth(V.annotations_long(sheet(spark, sf_dir))), "accuracy", "kappa")


_IDS = ", ".join(f"list_position({list(K.CLASSES)}, {c}) - 1 AS {n}" for c, n in (("label_truth", "truth"), ("label", "pred")))


@query(f"{_LONG}, marked AS (SELECT annotator, {_IDS} FROM valid), {confusion_sql('marked', 'annotator')} SELECT annotator, CAST(truth AS INT) AS truth, CAST(pred AS INT) AS pred, n FROM cells")
def v4_annotator_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.annotator_confusion(V.annotations_long(sheet(spark, sf_dir)))


@query(f"{_LONG}, pairs AS (SELECT x.annotator AS annotator_a, y.annotator AS annotator_b, x.label AS a, y.label AS b FROM valid x JOIN valid y USING (audio_id) WHERE x.place < y.place), {_kappa_sql('pairs', 'annotator_a, annotator_b')}")
def v5_pairwise_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.pairwise_kappa(V.annotations_long(sheet(spark, sf_dir))), "accuracy", "kappa")


@query(f"""{_LONG}, votes AS (SELECT audio_id, label_truth, label, count(*) AS n, min(place) AS first FROM valid GROUP BY ALL), modes AS (SELECT audio_id, label_truth, arg_max(label, n * 10 - first) AS mode FROM votes GROUP BY ALL)
SELECT label_truth AS class, count(*) AS n, count(*) FILTER (mode = label_truth) AS hits, round(count(*) FILTER (mode = label_truth) / count(*), 6) AS recall FROM modes GROUP BY 1""")
def v6_majority_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.majority_recall(V.annotations_long(sheet(spark, sf_dir))), "recall")


