"""Labels, keys and splits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.expr import class_id, literal_map, ranked, seeded, strip


def remap_labels(df: DataFrame, mapping: dict = K.EMOTIONS, col: str = "emotion", upper: bool = False) -> DataFrame:
    """Adds original_emotion, target_emotion and target_label; what is not mapped is DROP and -1."""
    source = F.upper(F.trim(col)) if upper else F.lower(F.trim(col))
    known = {k: v for k, v in mapping.items() if v is not None}
    target = F.coalesce(F.try_element_at(literal_map(known), source), F.lit("DROP"))
    return df.withColumn("original_emotion", F.col(col)).withColumn("target_emotion", target).withColumn("target_label", class_id(F.col("target_emotion")))


def drop_unmapped(df: DataFrame, col: str = "target_label") -> DataFrame:
    return df.where(F.col(col) != -1)


def acted_label_map(fear_as_frustration: bool = False, override: dict | None = None) -> dict:
    """The codes of acted clips and their classes."""
    return K.ACTED_EMOTIONS | ({"FEA": "frustration"} if fear_as_frustration else {}) | (override or {})


def parse_clip_name(df: DataFrame, col: str = "name") -> DataFrame:
    """Adds the four parts of a clip name and their meaning; other names are dropped."""
    base = F.regexp_replace(F.regexp_extract(col, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return (
        df.withColumn("_parts", F.split(base, "_"))
        .where(F.size("_parts") == 4)
        .withColumn("actor_id", F.col("_parts")[0])
        .withColumn("sentence_id", F.col("_parts")[1])
        .withColumn("emotion_code", F.upper(F.col("_parts")[2]))
        .withColumn("intensity_code", F.upper(F.col("_parts")[3]))
        .withColumn("intensity", F.coalesce(F.try_element_at(literal_map(K.INTENSITIES), F.col("intensity_code")), F.lit("unknown")))
        .withColumn("sentence", F.coalesce(F.try_element_at(literal_map(K.SENTENCES), F.col("sentence_id")), F.lit("")))
        .drop("_parts")
    )


def parse_dialogue_key(df: DataFrame, col: str = "path") -> DataFrame:
    """Adds dialogue_id and utterance_id from the first diaN_uttM; a path without is an error."""
    pattern = r"(?i)dia(\d+)_utt(\d+)"
    part = lambda k: F.regexp_extract(col, pattern, k)
    checked = F.when(part(1) != "", part(1)).otherwise(F.raise_error(F.concat(F.lit("no dialogue key in "), F.coalesce(F.col(col), F.lit("null")))))
    return df.withColumn("dialogue_id", checked.cast("int")).withColumn("utterance_id", part(2).cast("int"))


def split_from_id(df: DataFrame, col: str = "audio_id") -> DataFrame:
    """Adds the split that the id's prefix names; another prefix is an error."""
    prefix = F.lower(F.substring_index(col, "_", 1))
    named = reduce(lambda c, s: c.when(prefix.startswith(s), s), ("val", "test"), F.when(prefix.startswith("train"), "train"))
    return df.withColumn("split", named.otherwise(F.raise_error(F.concat(F.lit("no split in "), F.coalesce(F.col(col), F.lit("null"))))))


def assign_ids(df: DataFrame, split: str = "split", order_by: Sequence[str] = (), name: str = "audio_id") -> DataFrame:
    """Adds split_NNNNN, numbered from 0 within each split."""
    numbered = ranked(df, [split], [F.col(c) for c in order_by], "_at")
    return numbered.withColumn(name, F.concat(F.col(split), F.lit("_"), F.format_string("%05d", "_at"))).drop("_at")


def class_distribution(df: DataFrame, by: Sequence[str] = (), col: str = "target_label") -> DataFrame:
    """Rows and per cent of each class, zero classes too, in every group."""
    each = [F.count_if(F.col(col) == i).alias(f"n{i}") for i in range(len(K.CLASSES))]
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("class_id"), F.col(f"n{i}").alias("n")) for i in range(len(K.CLASSES))])).alias("c")
    whole = df.groupBy(*by).agg(*each).withColumn("total", sum((F.col(f"n{i}") for i in range(1, len(K.CLASSES))), F.col("n0"))).select(*by, "total", rows).select(*by, "total", "c.*")
    total = F.col("total")
    names = F.get(F.array(*[F.lit(c) for c in K.CLASSES]), F.col("class_id"))
    return whole.select(*by, "class_id", names.alias("class"), "n", F.when(total > 0, 100.0 * F.col("n") / total).otherwise(0.0).alias("percent"))


def join_demographics(df: DataFrame, actors: DataFrame, key: str = "actor_id") -> DataFrame:
    """Adds what is known of each actor; actors appear once in their table."""
    return df.join(actors.dropDuplicates([key]), key, "left")


def group_disjoint_split(df: DataFrame, group: str = "actor_id", val: Sequence[str] = K.VAL_ACTORS, test: Sequence[str] = K.TEST_ACTORS) -> DataFrame:
    """Adds a split in which no group is in two splits; the test set wins."""
    who = F.col(group)
    return df.withColumn("split", F.when(who.isin(*test), "test").when(who.isin(*val), "val").otherwise("train"))


def stratified_split(df: DataFrame, label: str, keys: Sequence[str], val_frac: float = 0.1, test_frac: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds a split: of each label in seeded order, first the test rows, then val, then train.

    Sizes are rounded half to even.
    """
    shuffled = ranked(df, [label], [seeded(seed, *[F.col(k) for k in keys]), *[F.col(k) for k in keys]], "_at", "_n")
    part = lambda frac: F.bround(F.col("_n") * F.lit(float(frac)))
    split = F.when(F.col("_at") < part(test_frac), "test").when(F.col("_at") < part(test_frac) + part(val_frac), "val").otherwise("train")
    return shuffled.select(*df.columns, split.alias("split"))


def combine_sources(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Both sets, tagged by source."""
    return real.withColumn("source", F.lit("real")).unionByName(synthetic.withColumn("source", F.lit("synthetic")), allowMissingColumns=True)


#: Training condition: (sources of training, source of validation, class weights or not).
CONDITIONS = {
    "real_only": (("real",), "real", True),
    "synthetic_only": (("synthetic",), "synthetic", True),
    "combined": (("real", "synthetic"), "real", False),
    "combined_weighted": (("real", "synthetic"), "real", True),
}


def training_condition(combined: DataFrame, name: str) -> tuple[DataFrame, DataFrame, bool]:
    """(train, val, class weights?) of a named condition, from rows with source and split."""
    sources, val, weighted = CONDITIONS[name]
    train = combined.where(F.col("source").isin(*sources) & (F.col("split") == "train"))
    return train, combined.where((F.col("source") == val) & (F.col("split") == "val")), weighted


def clean_training_text(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Trimmed texts that are not empty, of known labels, with label_id."""
    made = df.withColumn(text, strip(F.col(text))).withColumn("label_id", class_id(F.col(label)))
    return made.where((F.col(text) != "") & (F.col("label_id") >= 0))

