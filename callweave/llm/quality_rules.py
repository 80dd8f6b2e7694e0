"""Quality rules with adaptive thresholds.

Every text is measured by small counts. Fixed base rules reject what is never text. All
other cutoffs come from the data: for each language and source, a quantile sketch per
measure gives a fence far above the usual values, and the fences are joined to the rows.

The sketch is a histogram of integers whose buckets keep their six leading bits, so that
a quantile is off by at most 1/32 of its value. Sketches merge by adding counts: groups
of fewer than MIN_GROUP rows use the merged sketch of their language, and languages of fewer
rows the merged sketch of everything. Counts do not depend on order or partitioning.

Defined cases: null and empty texts have no words and fail the base rules; null languages
and sources are groups of their own; an empty table gives an empty table; repeated rows
are judged one by one and weigh in the sketches one by one; texts of any length are read to their end; a value
on a fence is kept; further columns are ignored by the query and kept by the stage, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_column, text_bytes

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
WINDOW = 5
COUNTS = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint"}

MIN_GROUP = 200
#: Rows of fences that may be broadcast.
MAX_BROADCAST_GROUPS = 100_000
#: For each measure: value as an integer, and what a fence adds to the third quartile
#: besides REACH times the distance between the quartiles.
MEASURES = {
    "symbols": ("1000 * n_symbols div n_words", 100),
    "dup_lines": ("1000 * n_dup_lines div n_words", 30),
    # The mean of a few words strays: four over the root of their number is taken off.
    "word_length": ("CAST(greatest(0, 100 * word_chars / n_words - 400 / sqrt(n_words)) AS BIGINT)", 100),
}
REACH = 3


def repeated_words(words: list) -> int:
    """Words that lie in a window of five words which occurs twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    size = len(ids)
    key = w[:n]
    at = np.arange(n)
    # Windows are told apart word by word; those whose beginning is unique leave early.
    for k in range(1, WINDOW):
        key = key * size + w[at + k]
        if k == WINDOW - 1 or size > 1_000_000 or k == 2:
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            new = np.empty(len(ranked), bool)
            new[0] = True
            np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
            group = np.cumsum(new) - 1
            many = np.bincount(group) > 1
            stay = many[group]
            if not stay.any():
                return 0
            at, key = at[order[stay]], group[stay]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


def text_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, SPACES + CONTINUATION)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def count_texts(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns with the five counts of every text."""

    def start():
        return lambda batch: list(map(list, zip(*[text_counts(x) for x in batch.to_pylist()]))) or [[]] * len(COUNTS)

    return map_column(df, text_bytes(text_col), keep, COUNTS, start)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def bucket(value: str) -> str:
    """The lowest integer of a value's bucket, as SQL: six leading bits stay."""
    return f"CASE WHEN {value} < 64 THEN {value} ELSE shiftleft(shiftright({value}, CAST(floor(log2({value})) AS INT) - 5), CAST(floor(log2({value})) AS INT) - 5) END"


def sketches(counted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, bucket, n: a mergeable histogram of each measure over rows that pass the base rules."""
    values = ", ".join(f"named_struct('measure', '{m}', 'v', CAST({sql} AS BIGINT))" for m, (sql, _) in MEASURES.items())
    return (
        counted.where(~base_failed())
        .select(*keys, F.explode(F.expr(f"array({values})")).alias("x"))
        .select(*keys, F.col("x.measure").alias("measure"), F.expr(bucket("x.v")).alias("bucket"))
        .groupBy(*keys, "measure", "bucket")
        .agg(F.count("*").alias("n"))
    )


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rows, and a fence for each measure, from sketches merged to the keys."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    # A histogram has a few hundred buckets at most, whatever the number of rows.
    held = merged.groupBy(*keys, "measure").agg(F.sum("n").alias("rows"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("h"))

    def quantile(q: float) -> Column:
        walk = f"aggregate(h, named_struct('seen', 0L, 'at', CAST(NULL AS BIGINT)), (a, x) -> named_struct('seen', a.seen + x.n, 'at', coalesce(a.at, CASE WHEN a.seen + x.n >= {q} * rows THEN x.bucket END)), a -> a.at)"
        return F.expr(walk)

    limits = held.select(*keys, "measure", "rows", quantile(0.25).alias("q1"), quantile(0.75).alias("q3"))
    slack = F.create_map(*[F.lit(x) for m, (_, s) in MEASURES.items() for x in (m, s)])
    fence = F.col("q3") + REACH * (F.col("q3") - F.col("q1")) + slack[F.col("measure")]
    return limits.groupBy(*keys).agg(F.max("rows").alias("rows"), *[F.max(F.when(F.col("measure") == m, fence)).alias(f"max_{m}") for m in MEASURES])


def thresholds(counted: DataFrame) -> DataFrame:
    """q_lang, q_source and the fences that hold for this language and source."""
    own = checkpointed(sketches(counted, ["q_lang", "q_source"]))
    by_group, by_lang, by_all = fences(own, ["q_lang", "q_source"]), fences(own, ["q_lang"]), fences(own, [])
    names = [f"max_{m}" for m in MEASURES]
    lang = by_lang.select(F.col("q_lang").alias("l_lang"), F.col("rows").alias("l_rows"), *[F.col(n).alias(f"l_{n}") for n in names])
    whole = by_all.select(*[F.col(n).alias(f"a_{n}") for n in names])
    # The right side is one row.
    both = by_group.join(lang, by_group["q_lang"].eqNullSafe(lang["l_lang"]), "left").crossJoin(F.broadcast(whole))
    pick = lambda n: F.when(F.col("rows") >= MIN_GROUP, F.col(n)).when(F.col("l_rows") >= MIN_GROUP, F.col(f"l_{n}")).otherwise(F.col(f"a_{n}"))
    return checkpointed(both.select("q_lang", "q_source", *[pick(n).alias(n) for n in names]))


def judge(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds base_failed and kept to counted rows that carry q_lang and q_source."""
    small = limits.count() <= MAX_BROADCAST_GROUPS
    side = limits.select(F.col("q_lang").alias("t_lang"), F.col("q_source").alias("t_source"), *[f"max_{m}" for m in MEASURES])
    on = counted["q_lang"].eqNullSafe(side["t_lang"]) & counted["q_source"].eqNullSafe(side["t_source"])
    joined = counted.join(F.broadcast(side) if small else side, on, "left")
    within = F.lit(True)
    for m, (sql, _) in MEASURES.items():
        within = within & (F.expr(f"CASE WHEN n_words > 0 THEN {sql} END") <= F.col(f"max_{m}"))
    return joined.select(*counted.columns, base_failed().alias("base_failed"), (~base_failed() & F.coalesce(within, F.lit(True))).alias("kept"))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, the counts, base_failed and kept of every text."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("q_text"), F.col(lang_col).cast("string").alias("q_lang"), F.col(source_col).cast("string").alias("q_source"))
    counted = checkpointed(count_texts(rows, [id_col, "q_lang", "q_source"], "q_text"))
    return judge(counted, thresholds(counted)).drop("q_lang", "q_source")


def filter_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that are kept, with their columns.

    The texts are measured twice, once for the sketches and once for the verdict, since this
    is cheaper than a shuffle of the texts.
    """
    own = [f"own_{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[docs[f"`{c}`"].alias(o) for c, o in zip(docs.columns, own)], docs[text_col].alias("q_text"), docs[lang_col].cast("string").alias("q_lang"), docs[source_col].cast("string").alias("q_source"))
    limits = thresholds(count_texts(rows, ["q_lang", "q_source"], "q_text"))
    kept = judge(count_texts(rows, [*own, "q_lang", "q_source"], "q_text"), limits).where("kept")
    return kept.select(*[F.col(o).alias(c) for o, c in zip(own, docs.columns)])
