"""Model scores as probabilities of the five classes, and batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.expr import argmax, class_name, vector_of


def lexicon_class_of(compound: Column) -> Column:
    return F.when(compound < -0.3, "anger").when(compound <= -0.05, "sadness").when(compound <= 0.3, "neutral").when(compound.isNotNull(), "satisfaction")


def lexicon_class(df: DataFrame, col: str = "vader_compound") -> DataFrame:
    """Adds predicted_class by hard cuts of the compound score; without a score there is none."""
    return df.withColumn("predicted_class", lexicon_class_of(F.col(col)))


def lexicon_probs_of(compound: Column) -> Column:
    out = None
    for bound, inclusive, probs in K.LEXICON_BUCKETS:
        value = F.array(*[F.lit(p) for p in probs])
        if bound is None:
            return out.when(compound.isNotNull(), value)
        within = compound <= bound if inclusive else compound < bound
        out = F.when(within, value) if out is None else out.when(within, value)


def lexicon_probs(df: DataFrame, col: str = "vader_compound") -> DataFrame:
    return df.withColumn("lexicon_probs", lexicon_probs_of(F.col(col)))


def goemo_probs_of(columns: list[str], normalise: bool = False) -> Column:
    """Sums of the emotions of each class; a column or a value that is missing adds nothing.

    Without any value there is no vector.
    """
    parts, every = [], []
    for names in K.GOEMO_OF_CLASS.values():
        there = [F.col(f"goemo_{n}").cast("double") for n in names if f"goemo_{n}" in columns]
        every += there
        there = [F.coalesce(c, F.lit(0.0)) for c in there]
        parts.append(sum(there[1:], there[0]) if there else F.lit(0.0))
    sums = F.when(F.coalesce(*every).isNotNull(), F.array(*parts)) if every else F.array(*parts)
    if not normalise:
        return sums

    def scaled(sums: Column) -> Column:
        total = F.aggregate(sums, F.lit(0.0), lambda a, p: a + p)
        return F.transform(sums, lambda p: F.when(total == 0, p).otherwise(p / F.when(total != 0, total)))

    return F.get(F.transform(F.array(sums), lambda v: F.when(v.isNotNull(), scaled(v))), 0)


def goemo_probs(df: DataFrame, normalise: bool = False) -> DataFrame:
    return df.withColumn("goemo_probs", goemo_probs_of(df.columns, normalise))


def goemo_class(df: DataFrame) -> DataFrame:
    return df.withColumn("predicted_class", class_name(argmax(goemo_probs_of(df.columns))))


def audio_probs(df: DataFrame) -> DataFrame:
    """Adds audio_probs; the audio model has no frustration. A missing score counts 0, without any there is no vector."""
    of_class = {c: f"sb_{a}" for a, c in K.AUDIO_OF_CLASS.items()}
    return df.withColumn("audio_probs", vector_of([F.col(of_class[c]) if c in of_class else F.lit(None) for c in K.CLASSES]))


def audio_class(df: DataFrame) -> DataFrame:
    """Adds predicted_class: the first largest of the model's own four scores."""
    scores = vector_of([F.col(f"sb_{a}") for a in K.AUDIO_OF_CLASS])
    return df.withColumn("predicted_class", F.get(F.array(*[F.lit(c) for c in K.AUDIO_OF_CLASS.values()]), argmax(scores)))


def text_probs(df: DataFrame) -> DataFrame:
    """Adds text_probs; a missing score counts 0, without any there is no vector."""
    return df.withColumn("text_probs", vector_of([F.col(c) for c in K.TEXT_COLUMNS]))


def argmax_label(df: DataFrame, probs: str, prefix: str = "predicted") -> DataFrame:
    """Adds the id, name and probability of the first most likely class."""
    found = argmax(F.col(probs))
    return df.withColumn(f"{prefix}_class_id", found).withColumn(f"{prefix}_class", class_name(found)).withColumn("confidence", F.array_max(probs))


def score_table(df: DataFrame, scorer: Callable[[], Callable[[pd.Series], pd.DataFrame]], schema: str, text: str = "text", key: str = "id", batch_size: int = 256, batch_chars: int = 1 << 20, profile: ResourceProfile | None = None) -> DataFrame:
    """Scores a text column with a vectorized function that is made once per task.

    schema names what the scorer returns; the result has the key and these columns. A call of the
    scorer gets batch_size texts at most, and fewer where they have more than batch_chars characters
    together (a longer text comes alone), so its memory is bounded. With a profile the stage runs on
    executors and task slots of its own, such as those with an accelerator.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer()
        for batch in batches:
            for a, b in batch_cuts(batch[text].str.len().fillna(0).astype(int).tolist(), batch_size, batch_chars):
                part = batch.iloc[a:b]
                made = score(part[text].reset_index(drop=True))
                made.insert(0, key, part[key].to_numpy())
                yield made

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, {schema}", profile=profile)


def batch_cuts(sizes: Sequence[int], rows: int, total: int) -> list[tuple[int, int]]:
    """Ranges of at most `rows` rows whose sizes add up to at most `total`, or of one row."""
    cuts, start, held = [], 0, 0
    for i, size in enumerate(sizes):
        if i > start and (i - start >= rows or held + size > total):
            cuts.append((start, i))
            start, held = i, 0
        held += size
    return [*cuts, (start, len(sizes))] if len(sizes) else []
