"""Confusion counts, the metrics that follow from them, and reports."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.expr import broadcast_if_small, class_name, ratio
from ..functions.quantiles import percentiles


def confusion_matrix(df: DataFrame, by: Sequence[str] = (), truth: str = "truth", pred: str = "pred") -> DataFrame:
    """by, truth, pred, n for all 25 cells; rows without a truth or a prediction do not count.

    They are left out by their count, after the rows are grouped: a filter on a prediction goes down to
    the scan and there repeats all that the prediction is computed from, for each time it is named.
    """
    pairs = df.select(*by, F.col(truth).cast("int").alias("truth"), F.col(pred).cast("int").alias("pred"))
    whole = F.col("truth").isNotNull() & F.col("pred").isNotNull()
    counts = pairs.groupBy(*by, "truth", "pred").agg(F.count_if(whole).alias("n")).where("n > 0")
    return fill_cells(counts, by)


def fill_cells(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds the cells that are zero to by, truth, pred, n.

    A group has 25 counts at most, so they are gathered in one map and spread over the grid;
    what counted them runs once.
    """
    size = len(K.CLASSES)
    held = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(F.col("truth") * size + F.col("pred"), "n"))).alias("m"))
    cell = F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))).alias("cell")
    grid = held.select(*by, "m", cell)
    n = F.coalesce(F.try_element_at("m", F.col("cell")), F.lit(0).cast("bigint"))
    return grid.select(*by, F.floor(F.col("cell") / size).cast("int").alias("truth"), (F.col("cell") % size).alias("pred"), n.alias("n"))


def wide(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per truth, one column per prediction."""
    named = confusion.withColumn("pred", class_name(F.col("pred")))
    return named.groupBy(*by, "truth").pivot("pred", list(K.CLASSES)).agg(F.sum("n"))


def per_class_metrics(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every class; 0 where they are not defined."""
    marks = F.explode(F.array(F.struct(F.col("truth").alias("class_id"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")), F.struct(F.col("pred").alias("class_id"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"))))
    hit = F.when((F.col("truth") == F.col("pred")) & (F.col("m.support") > 0), F.col("n")).otherwise(0)
    sums = confusion.select("*", marks.alias("m")).groupBy(*by, F.col("m.class_id").alias("class_id")).agg(F.sum("m.support").alias("support"), F.sum("m.predicted").alias("predicted"), F.sum(hit).alias("hits"))
    p, r = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("support"))
    f1 = ratio(2 * F.col("hits"), F.col("predicted") + F.col("support"))
    return sums.select(*by, "class_id", class_name(F.col("class_id")).alias("class"), p.alias("precision"), r.alias("recall"), f1.alias("f1"), "support", "predicted", "hits")


def summary_metrics(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, weighted and macro F1, frustration recall.

    The macro mean is over the classes that occur as truth or as prediction.
    """
    seen = (F.col("support") + F.col("predicted")) > 0
    total = F.sum("support")
    return (
        per_class_metrics(confusion, by)
        .groupBy(*by)
        .agg(
            total.alias("n"),
            ratio(F.sum("hits"), total).alias("accuracy"),
            ratio(F.sum(F.col("f1") * F.col("support")), total).alias("weighted_f1"),
            F.coalesce(F.avg(F.when(seen, F.col("f1"))), F.lit(0.0)).alias("macro_f1"),
            F.max(F.when(F.col("class_id") == K.FRUSTRATION, F.col("recall"))).alias("frustration_recall"),
            F.max(F.when(F.col("class_id") == K.FRUSTRATION, F.col("f1"))).alias("frustration_f1"),
        )
    )


def evaluate(df: DataFrame, by: Sequence[str] = (), truth: str = "truth", pred: str = "pred") -> DataFrame:
    return summary_metrics(confusion_matrix(df, by, truth, pred), by)


def class_weights(df: DataFrame, label: str = "truth") -> DataFrame:
    """class_id, n, weight = total / (5 n), and the sampler's weight total / n; 1 for no rows."""
    counts = df.groupBy(F.col(label).cast("int").alias("class_id")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(len(K.CLASSES)).select(F.col("id").cast("int").alias("class_id"))
    whole = every.join(counts, "class_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy())
    weight = total / (len(K.CLASSES) * F.when(F.col("n") > 0, F.col("n")))
    return whole.select("class_id", "n", F.coalesce(weight, F.lit(1.0)).alias("weight"), F.coalesce(total / F.when(F.col("n") > 0, F.col("n")), F.lit(1.0)).alias("sampler_weight"))


def sample_weights(df: DataFrame, label: str = "truth") -> DataFrame:
    """Adds the weight of its class to every row; five rows are broadcast."""
    weights = class_weights(df, label).select(F.col("class_id").alias("_c"), "weight")
    return df.join(F.broadcast(weights), F.col(label) == F.col("_c"), "left").drop("_c")


def model_comparison(df: DataFrame, baseline: str, model: str = "model", truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Metrics of every model, best weighted F1 first, and how far it is from the baseline's."""
    made = evaluate(df, [model], truth, pred)
    base = F.max(F.when(F.col(model) == baseline, F.col("weighted_f1"))).over(Window.partitionBy())
    return made.withColumn("delta_weighted_f1", F.col("weighted_f1") - base).orderBy(F.desc("weighted_f1"), model)


def condition_report(df: DataFrame, by: Sequence[str] = ("condition", "dataset"), truth: str = "truth", pred: str = "pred") -> DataFrame:
    """n, F1 and the five recalls of every condition and data set."""
    cells = confusion_matrix(df, by, truth, pred)
    recalls = per_class_metrics(cells, by).groupBy(*by).pivot("class", list(K.CLASSES)).agg(F.max("recall"))
    named = recalls.select(*by, *[F.col(c).alias(f"recall_{c}") for c in K.CLASSES])
    return summary_metrics(cells, by).select(*by, "n", "weighted_f1", "macro_f1").join(named, list(by))


def score_histogram(df: DataFrame, col: str = "vader_compound", bins: int = 40, by: str = "true_label") -> DataFrame:
    """by, bin, lower, n, density of all equal bins between each group's least and largest score."""
    span = df.where(F.col(col).isNotNull()).groupBy(F.col(by).alias("_b")).agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count("*").alias("total"))
    # A group of one value gets bins around it.
    one = F.col("lo") == F.col("hi")
    span = span.select("_b", F.when(one, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(one, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), "total")
    place = F.least(F.lit(bins - 1), F.floor((F.col(col) - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))).cast("int")
    span = broadcast_if_small(span)
    joined = df.where(F.col(col).isNotNull()).join(span, F.col(by).eqNullSafe(F.col("_b")))
    counts = joined.groupBy(F.col("_b").alias("_c"), place.alias("_bin")).agg(F.count("*").alias("n"))
    # Bins without a row have n 0.
    every = span.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    whole = every.join(counts, F.col("_b").eqNullSafe(F.col("_c")) & (F.col("bin") == F.col("_bin")), "left")
    width, n = (F.col("hi") - F.col("lo")) / bins, F.coalesce("n", F.lit(0))
    return whole.select(F.col("_b").alias(by), "bin", (F.col("lo") + F.col("bin") * width).alias("lower"), n.alias("n"), (n / (F.col("total") * width)).alias("density"))


def best_epoch(history: DataFrame, patience: int, by: Sequence[str] = ("run",), epoch: str = "epoch", score: str = "val_wf1") -> DataFrame:
    """The best epoch of each run up to its stop, and the epoch at which it stops (null if it ran out)."""
    order = Window.partitionBy(*by).orderBy(epoch)
    best_before = F.max(score).over(order.rowsBetween(Window.unboundedPreceding, -1))
    better = best_before.isNull() | (F.col(score) > best_before)
    marked = history.withColumn("_better", better)
    last = F.max(F.when(F.col("_better"), F.col(epoch))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("_last", last).withColumn("_idle", F.col(epoch) - last)
    stop = F.min(F.when(F.col("_idle") >= patience, F.col(epoch))).over(Window.partitionBy(*by))
    ran = marked.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col(epoch) <= F.col("_stop")))
    return ran.groupBy(*by).agg(F.max("_last").alias("best_epoch"), F.max("_stop").alias("stop_epoch"), F.max(score).alias("best_score"))


def column_step(plus, minus, same, full):
    """The next column of the table of edit distances, as bits where it rises and falls by one.

    The bits of a column are its differences from row to row; `same` has the rows whose word equals the
    column's. Works on whole numbers of any length, and on arrays of 64 bits, many pairs at once.
    """
    diagonal = (((same & plus) + plus) ^ plus) | same | minus
    rise, fall = minus | (full & ~(diagonal | plus)), diagonal & plus
    rise, fall = (rise << 1) | 1, fall << 1
    return (fall | (full & ~(diagonal | rise))) & full, rise & diagonal & full


def long_distance(ref: np.ndarray, hyp: np.ndarray) -> int:
    """Edits between two texts of any number of words, given as word ids."""
    rows: dict[int, int] = {}
    for i, w in enumerate(ref.tolist()):
        rows[w] = rows.get(w, 0) | 1 << i
    full = (1 << len(ref)) - 1
    plus, minus = full, 0
    for w in hyp.tolist():
        plus, minus = column_step(plus, minus, rows.get(w, 0), full)
    return len(hyp) + plus.bit_count() - minus.bit_count()


def short_distances(refs: list[np.ndarray], hyps: list[np.ndarray]) -> np.ndarray:
    """Edits of many pairs at once, the shorter text of each with 64 words at most."""
    height, width = np.array([len(r) for r in refs], np.uint64), np.array([len(h) for h in hyps], np.int64)
    order = np.argsort(-width, kind="stable")
    table = np.full((len(refs), 64), -1, np.int64)
    for row, k in enumerate(order):
        table[row, : len(refs[k])] = refs[k]
    size = height[order]
    full = np.where(size == 0, np.uint64(0), ~np.uint64(0) >> (np.uint64(64) - np.maximum(size, np.uint64(1))))
    plus, minus = full.copy(), np.zeros_like(full)
    # Longest first, so that the pairs that still have words are the leading ones.
    going = np.searchsorted(-width[order], -np.arange(1, int(width.max(initial=0)) + 1), side="right")
    for j, n in enumerate(going.tolist()):
        word = np.array([hyps[k][j] for k in order[:n]])
        same = np.packbits(table[:n] == word[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
        plus[:n], minus[:n] = column_step(plus[:n], minus[:n], same & full[:n], full[:n])
    out = np.empty(len(refs), np.int64)
    out[order] = width[order] + np.bitwise_count(plus).astype(np.int64) - np.bitwise_count(minus).astype(np.int64)
    return out


def edit_distances(refs: pd.Series, hyps: pd.Series) -> pd.DataFrame:
    """Edits and reference words of each pair of texts, by words; null is an empty text.

    Columns of the table of distances are bits (64 rows of a pair in one step), so no pair of words is
    looked at by itself.
    """
    sides = [[x.split() for x in side.fillna("")] for side in (refs, hyps)]
    lengths = [[len(x) for x in side] for side in sides]
    ids = pd.factorize(np.array([w for side in sides for x in side for w in x], object))[0] if any(map(any, lengths)) else np.zeros(0, np.int64)
    parts = np.split(ids, np.cumsum(lengths[0] + lengths[1])[:-1]) if len(refs) else []
    pairs = [sorted(p, key=len) for p in zip(parts[: len(refs)], parts[len(refs) :])]  # the distance is the same both ways
    edits = np.zeros(len(pairs), np.int64)
    short = [k for k, p in enumerate(pairs) if len(p[0]) <= 64]
    if short:
        edits[short] = short_distances([pairs[k][0] for k in short], [pairs[k][1] for k in short])
    for k in set(range(len(pairs))) - set(short):
        edits[k] = long_distance(*pairs[k])
    return pd.DataFrame({"edits": edits, "words": np.array(lengths[0], np.int64)})


def word_error_rate(df: DataFrame, ref: str = "ref", hyp: str = "hyp", target: float = 0.15) -> DataFrame:
    """Summed word edits over summed reference words, and whether it is below the target."""
    measure = F.pandas_udf(edit_distances, "edits bigint, words bigint")
    sums = df.select(measure(ref, hyp).alias("m")).agg(F.sum("m.edits").alias("edits"), F.sum("m.words").alias("words"))
    return sums.withColumn("wer", ratio(F.col("edits"), F.col("words"))).withColumn("passed", F.col("wer") < target)


def latency_summary(df: DataFrame, target_ms: float = 2000.0, col: str = "latency_ms", by: Sequence[str] = ("stage",)) -> DataFrame:
    """n, mean, median, p90, max and the share under the target, per stage.

    Median and p90 are exact, by distributed selection: no task holds the values of a stage. Null and NaN do not count.
    """
    timed = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")))
    sums = timed.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(col).alias("mean"),
        F.max(col).alias("max"),
        (100 * F.avg((F.col(col) < target_ms).cast("double"))).alias("percent_under"),
        (F.avg(col) < target_ms).alias("passed"),
    )
    exact = percentiles(timed, col, {"median": 0.5, "p90": 0.9}, by).select(*[F.col(g).alias(f"q_{g}") for g in by], "median", "p90")
    on = F.lit(True)
    for g in by:
        on = on & F.col(g).eqNullSafe(F.col(f"q_{g}"))
    return sums.join(exact, on).select(*by, "n", "mean", "median", "p90", "max", "percent_under", "passed")
