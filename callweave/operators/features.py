"""Joins of score tables, and the feature row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.expr import class_id, ranked
from .labels import split_from_id


def align_predictions(lexicon: DataFrame, goemo: DataFrame, audio: DataFrame, key: str = "audio_id", position: Sequence[str] | None = None) -> DataFrame:
    """One row per utterance with the scores of three models and its split.

    Tables join on the key; given the columns of an order, on the place in that order, which
    cuts off what the shortest table lacks.
    """
    tables = [lexicon.select(key, "text", "true_label", *K.LEXICON_COLUMNS), goemo.select(key, *[c for c in goemo.columns if c.startswith("goemo_")]), audio.select(key, *K.AUDIO_COLUMNS)]
    on = key
    if position is not None:
        originals = [lexicon, goemo, audio]
        tables = [ranked(o, [], [F.col(c) for c in position], "_row").select("_row", *[c for c in t.columns if k == 2 or c != key]) for k, (o, t) in enumerate(zip(originals, tables))]
        on = "_row"
    joined = tables[0].join(tables[1], on).join(tables[2], on)
    return split_from_id(joined.drop("_row"), key)


def attach_text_model(aligned: DataFrame, preds: DataFrame, key: str = "audio_id") -> DataFrame:
    """The 19 features of every row with its label; other row counts per split are an error."""
    missing = [c for c in K.TEXT_COLUMNS if c not in preds.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    own, theirs = (split_from_id(d.select(key), key).select("split", F.lit(n).alias("side")) for d, n in ((aligned, "a"), (preds, "b")))
    counts = own.unionByName(theirs).groupBy("split").agg(F.count_if(F.col("side") == "a").alias("a"), F.count_if(F.col("side") == "b").alias("b"))
    differing = counts.where("a <> b").limit(3).collect()
    if differing:
        raise ValueError(f"row counts differ: {[tuple(r) for r in differing]}")
    joined = aligned.join(preds.select(key, *K.TEXT_COLUMNS), key)
    return joined.select(key, "text", "true_label", class_id(F.col("true_label")).alias("true_label_id"), "split", *K.FEATURES)


def feature_columns(components: Sequence[str] = tuple(K.COMPONENTS)) -> list[str]:
    """The columns of some components, in the order of the feature row."""
    chosen = {c for name in components for c in K.COMPONENTS[name]}
    return [c for c in K.FEATURES if c in chosen]


def feature_vector(df: DataFrame, cols: Sequence[str] = K.FEATURES, name: str = "features") -> DataFrame:
    """Adds an array of the features in their order; a score that is missing or null is 0."""
    return df.withColumn(name, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in cols]))


def join_on_text(base: DataFrame, *others: DataFrame, key: str, keys: Sequence[str] = ("text", "true_label")) -> DataFrame:
    """base with the columns of tables that share (text, true_label), one row per row of base.

    The other tables keep their first row of each text that has a score, or the first if none has.
    Rows without a text or a label match those without. The join is on a hash of the keys with
    a check of the keys themselves, so that long texts are not sorted.
    """
    out = base.withColumn("_h", F.xxhash64(*keys))
    for n, other in enumerate(others):
        rest = [c for c in other.columns if c not in keys and c != key]
        none = F.lit(True)
        for c in rest:
            none = none & F.col(c).isNull()
        order = F.struct(none.alias("none"), F.col(key).alias("key"))
        first = other.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias(f"_o{n}")).withColumn("_h", F.xxhash64(*keys))
        for k in keys:
            first = first.withColumnRenamed(k, f"_{k}{n}")
        on = (out["_h"] == first["_h"])
        for k in keys:  # rows without a text or a label match those without, as in a merge of tables
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}{n}"))
        out = out.join(first, on).select(out["*"], *[F.col(f"_o{n}.{c}").alias(c) for c in rest])
    return out.drop("_h")


def alignment_audit(a: DataFrame, b: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Rows of both tables, matched keys, keys of one table only, and texts that differ."""
    left, right = a.select(F.col(key).alias("k"), F.col(text).alias("ta"), F.lit(1).alias("ia")), b.select(F.col(key).alias("k"), F.col(text).alias("tb"), F.lit(1).alias("ib"))
    both = left.join(right, "k", "full_outer")
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    there, here = F.col("ia").isNotNull(), F.col("ib").isNotNull()
    return both.agg(
        count(there).alias("rows_a"),
        count(here).alias("rows_b"),
        count(there & here).alias("matched"),
        count(there & ~here).alias("only_a"),
        count(~there & here).alias("only_b"),
        count(there & here & ~F.col("ta").eqNullSafe(F.col("tb"))).alias("text_differs"),
    )
