"""Errors by severity, and the threshold of the handover score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.expr import argmax, class_name, own_prefix, ratio
from .handover import mass

NEGATIVE = (K.ANGER, K.FRUSTRATION, K.SADNESS)
#: The names of the tiers of errors.
CORRECT, MISSED_FRUSTRATION, FALSE_FRUSTRATION, AMONG_NEGATIVES, MISSED_NEGATIVE, OTHER = "correct", "A_FN_frustration", "B_FP_frustration", "C_confusion_negatives", "C_missed_negative_as_neutral", "other"


def error_report(df: DataFrame, probs: str = "probs", truth: str = "truth") -> DataFrame:
    """Adds pred, predicted_class, confidence, p_handover, severity and tier.

    p_handover is the handover score of the live decision, so missing scores count 0. A truth without a
    prediction is an error like any other: frustration is missed, other classes are `other`.
    """
    t = F.col(truth)

    def judged(p: Column) -> Column:
        """The prediction with the first tier that fits, and its severity."""
        cases = [
            (t == p, CORRECT, 0),
            (t == K.FRUSTRATION, MISSED_FRUSTRATION, 3),
            (p == K.FRUSTRATION, FALSE_FRUSTRATION, 2),
            (t.isin(*NEGATIVE) & p.isin(*NEGATIVE), AMONG_NEGATIVES, 1),
            (t.isin(*NEGATIVE) & (p == K.NEUTRAL), MISSED_NEGATIVE, 1),
        ]
        return F.coalesce(*[F.when(case, F.struct(F.lit(tier).alias("tier"), F.lit(severity).alias("severity"))) for case, tier, severity in cases], F.struct(F.lit(OTHER).alias("tier"), F.lit(0).alias("severity")))

    # The prediction is named once: a filter on the severity that Spark moves below would repeat what computes it in every case.
    own = f"{own_prefix(df.columns)}judged"
    both = F.get(F.transform(F.array(argmax(F.col(probs))), lambda p: F.struct(p.alias("pred"), judged(p).alias("of"))), 0)
    return (
        df.withColumn(own, both)
        .withColumn("pred", F.col(f"{own}.pred"))
        .withColumn("predicted_class", class_name(F.col("pred")))
        .withColumn("confidence", F.array_max(probs))
        .withColumn("p_handover", mass(probs, K.ANGER, K.FRUSTRATION))
        .withColumn("tier", F.col(f"{own}.of.tier"))
        .withColumn("severity", F.col(f"{own}.of.severity"))
        .drop(own)
    )


def top_k_errors(report: DataFrame, k: int = 20, *keys: str) -> DataFrame:
    """The k worst errors: most severe, then most confident, then by key."""
    return report.where("severity > 0").orderBy(F.desc("severity"), F.desc("confidence"), *keys).limit(k)


def tier_counts(report: DataFrame) -> DataFrame:
    return report.where(F.col("tier") != CORRECT).groupBy("tier", "severity").agg(F.count("*").alias("n"))


def binary_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and frustration recall from TP, FP, FN, TN, frust_hits, frust_rows."""
    precision, recall = ratio(F.col("TP"), F.col("TP") + F.col("FP")), ratio(F.col("TP"), F.col("TP") + F.col("FN"))
    return counts.select(
        "threshold",
        "TP",
        "FP",
        "FN",
        "TN",
        precision.alias("handover_precision"),
        recall.alias("handover_recall"),
        ratio(2 * F.col("TP"), 2 * F.col("TP") + F.col("FP") + F.col("FN")).alias("handover_f1"),
        (F.col("frust_hits") / F.greatest("frust_rows", F.lit(1))).alias("frustration_recall"),
    )


def threshold_sweep(df: DataFrame, lo: float = 0.30, hi: float = 0.70, step: float = 0.01, score: str = "p_handover", truth: str = "truth") -> DataFrame:
    """The binary metrics of every threshold.

    A row counts as positive below as many thresholds as its score exceeds. Rows are counted
    once by that number, and the counts are added up from the top. A score that is null or NaN
    exceeds none.
    """
    n = round((hi - lo) / step) + 1
    grid = [round(lo + i * step, 4) for i in range(n)]
    # The number of thresholds below the score: a guess by division, put right by comparison.
    levels = F.array(*[F.lit(t) for t in grid])
    guess = F.greatest(F.lit(0), F.least(F.lit(n), F.ceil((F.col(score) - lo) / step).cast("int")))
    fixed = F.when((guess < n) & (F.get(levels, guess) < F.col(score)), guess + 1).when((guess > 0) & (F.get(levels, guess - 1) >= F.col(score)), guess - 1).otherwise(guess)
    given = F.col(score).isNotNull() & ~F.isnan(score)
    rows = df.where(F.col(truth).isNotNull()).select(F.when(given, fixed).otherwise(0).alias("passed"), F.col(truth).isin(K.ANGER, K.FRUSTRATION).alias("pos"), (F.col(truth) == K.FRUSTRATION).alias("frust"))
    count = lambda c: F.sum(c.cast("bigint"))
    held = rows.groupBy("passed").agg(count(F.col("pos")).alias("pos"), count(~F.col("pos")).alias("neg"), count(F.col("frust")).alias("frust"))
    every = df.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("passed")).join(held, "passed", "left").fillna(0)
    # n + 1 rows: threshold i is exceeded by rows that pass more than i thresholds.
    above = Window.orderBy(F.desc("passed")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    over = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    counts = every.select(
        "passed",
        over("pos").alias("TP"),
        over("neg").alias("FP"),
        (F.sum("pos").over(whole) - over("pos")).alias("FN"),
        (F.sum("neg").over(whole) - over("neg")).alias("TN"),
        over("frust").alias("frust_hits"),
        F.sum("frust").over(whole).alias("frust_rows"),
    ).where(F.col("passed") < n)
    return binary_metrics(counts.withColumn("threshold", F.get(levels, F.col("passed"))))


def select_threshold(sweep: DataFrame, min_precision: float = 0.5) -> DataFrame:
    """The threshold of best frustration recall above the precision floor, else of best F1."""
    fits = F.col("handover_precision") > min_precision
    order = [F.desc(fits), F.desc(F.when(fits, F.col("frustration_recall")).otherwise(F.col("handover_f1"))), F.desc(F.when(fits, F.col("handover_recall"))), "threshold"]
    return sweep.orderBy(*order).limit(1).withColumn("met_floor", fits)


def evaluate_threshold(df: DataFrame, t: float, score: str = "p_handover", truth: str = "truth") -> DataFrame:
    """The binary metrics of one threshold; a score that is null or NaN does not exceed it."""
    pos, says = F.col(truth).isin(K.ANGER, K.FRUSTRATION), F.coalesce((F.col(score) > t) & ~F.isnan(score), F.lit(False))
    frust = F.col(truth) == K.FRUSTRATION
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    counts = df.where(F.col(truth).isNotNull()).agg(
        count(pos & says).alias("TP"), count(~pos & says).alias("FP"), count(pos & ~says).alias("FN"), count(~pos & ~says).alias("TN"),
        count(frust & says).alias("frust_hits"), count(frust).alias("frust_rows"),
    )
    return binary_metrics(counts.withColumn("threshold", F.lit(float(t))))
