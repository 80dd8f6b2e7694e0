"""Text curation: normalise, reject with a reason, judge, filter, deduplicate."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.expr import own_prefix, ratio, seeded, strip, words


def normalised(text: Column) -> Column:
    """Plain punctuation, single spaces, no white space at the ends; null becomes empty.

    Most texts are plain already, so a look at their length or for two blanks saves the costly steps.
    """
    gone = [c for c, plain in K.PLAIN.items() if plain == ""]
    single = {c: plain for c, plain in K.PLAIN.items() if len(plain) == 1}
    whole = F.coalesce(text, F.lit(""))
    out = F.translate(whole, "".join([*single, *gone]), "".join(single.values()))
    for c, plain in K.PLAIN.items():
        if len(plain) > 1:
            out = F.replace(out, F.lit(c), F.lit(plain))
    out = F.when(beyond_ascii(whole), out).otherwise(whole)
    return strip(F.when(out.contains("\t") | out.contains("  "), F.regexp_replace(out, "[ \t]+", " ")).otherwise(out))


def beyond_ascii(text: Column) -> Column:
    """Whether a text has characters of more than one byte; all that PLAIN replaces, and emoji, are such."""
    return F.octet_length(text) > F.length(text)


def normalise_text(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn(col, normalised(F.col(col)))


def count_modified(df: DataFrame, col: str = "text") -> DataFrame:
    """n, and how many texts normalising changes."""
    changed = ~normalised(F.col(col)).eqNullSafe(F.col(col))
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(changed.cast("bigint")), F.lit(0)).alias("modified"))


#: Blocks of emoji, and the words that leak a label's axis into a text.
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F000}-\x{1F2FF}]"
AXES = ("label", "persona", "style", "cause", "intensity")
AXIS_LEAK = rf"(?iU)\b({'|'.join(AXES)})\b[: =]"


def with_reason(df: DataFrame, col: str, name: str) -> DataFrame:
    """Adds the first rule that a text fails, or ok.

    The stripped text, its words and its lower case are columns of their own, which the rules share.
    """
    p = own_prefix(df.columns)
    clean, n, low = (F.col(f"{p}{c}") for c in ("clean", "words", "low"))
    made = df.withColumn(f"{p}clean", strip(F.coalesce(F.col(col), F.lit("")))).withColumns({f"{p}words": F.size(F.split(clean, r"(?U)\s+")), f"{p}low": F.lower(clean)})
    quoted = lambda q: clean.startswith(q) & clean.endswith(q)
    out = (
        F.when(clean == "", "empty")
        .when(n < K.MIN_WORDS, F.format_string("too_short(%dw)", n))
        .when(n > K.MAX_WORDS, F.format_string("too_long(%dw)", n))
        .when(beyond_ascii(clean) & clean.rlike(EMOJI), "emoji")
        .when(quoted('"') | quoted("'"), "wrapped_in_quotes")
    )
    # A search for each phrase is much cheaper than one pattern of all; so is one for the leaking words,
    # which only the long s can spell otherwise.
    any_phrase = reduce(or_, [low.contains(p) for p in K.BANNED_PHRASES])
    any_axis = reduce(or_, [low.contains(w) for w in (*AXES, "\u017f")])
    first = F.coalesce(*[F.when(low.contains(p), F.lit(f"banned_phrase('{p}')")) for p in K.BANNED_PHRASES])
    whole = out.when(any_phrase, first).when(any_axis & clean.rlike(AXIS_LEAK), "axis_leak").otherwise("ok")
    return made.withColumn(name, whole).drop(f"{p}clean", f"{p}words", f"{p}low")


def heuristic_reason(df: DataFrame, col: str = "text") -> DataFrame:
    return with_reason(df, col, "reason")


def parse_judge_json(df: DataFrame, col: str = "response") -> DataFrame:
    """Adds parsed, score, intensity_obs, natural and reason from a judge's answer.

    Code fences are taken off; an answer that is no JSON object is searched for one. An empty object
    and one that names a field twice are no answer. Fields are read whatever their type is: a number
    is cut to an integer, text of an integer is that integer, true is 1, and what is missing or
    unreadable is 0; natural is what counts as true (a number but 0, a text, list or object with
    content), true when it is missing; the reason is cut to 200 characters.
    """
    text = strip(F.coalesce(F.col(col), F.lit("")))
    bare = F.when(text.startswith("```"), F.regexp_replace(F.regexp_replace(text, r"^```(json)?\s*", ""), r"\s*```$", "")).otherwise(text)
    block = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    read = lambda c: F.try_parse_json(c)
    kind = lambda v: F.schema_of_variant(v)
    filled = lambda v: F.when(kind(v).startswith("OBJECT<") & (kind(v) != "OBJECT<>"), v)
    p = own_prefix(df.columns)
    answer, types = F.col(f"{p}answer"), {f: F.col(f"{p}{f}") for f in ("score", "intensity_obs", "natural", "reason")}
    out = df.withColumn(f"{p}answer", F.coalesce(filled(read(bare)), filled(read(block))))
    out = out.withColumns({f"{p}{f}": kind(F.try_variant_get(answer, f"$.{f}", "variant")) for f in types})

    def number(field: str) -> Column:
        said, whole = F.try_variant_get(answer, f"$.{field}", "string"), F.try_variant_get(answer, f"$.{field}", "double")
        of_text = F.when(said.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(said).try_cast("int"))
        n = F.when(types[field] == "STRING", of_text).when(types[field] == "BOOLEAN", (said == "true").cast("int")).otherwise(whole.try_cast("int"))
        return F.when(answer.isNotNull(), F.coalesce(n, F.lit(0)))

    said, of = F.try_variant_get(answer, "$.natural", "string"), types["natural"]
    true = F.when(of.isNull(), True).when(of == "BOOLEAN", said == "true").when(of == "STRING", said != "").when(of == "VOID", False)
    true = true.when(of.startswith("ARRAY") | of.startswith("OBJECT"), ~said.isin("[]", "{}")).otherwise(F.try_variant_get(answer, "$.natural", "double") != 0)
    why = F.try_variant_get(answer, "$.reason", "string")
    reason = F.when(types["reason"] == "VOID", "None").when(types["reason"] == "BOOLEAN", F.initcap(why)).otherwise(F.coalesce(why, F.lit("")))
    values = {"score": number("score"), "intensity_obs": number("intensity_obs"), "natural": F.when(answer.isNotNull(), true), "reason": F.when(answer.isNotNull(), F.substring(reason, 1, 200))}
    kept = [c for c in df.columns if c not in (*values, "parsed")]
    return out.select(*kept, answer.isNotNull().alias("parsed"), *[v.alias(c) for c, v in values.items()])


def judge_verdict(df: DataFrame, score: str = "score", observed: str = "intensity_obs", claimed: str = "intensity") -> DataFrame:
    """Adds ok and fail_reason."""
    low = F.col(score) < K.MIN_SCORE
    off = F.abs(F.col(observed) - F.col(claimed)) > K.MAX_INTENSITY_GAP
    text = F.when(low, F.format_string("low_judge_score(%d)", score)).when(off, F.format_string("intensity_mismatch(%dvs%d)", observed, claimed)).otherwise("")
    return df.withColumn("ok", ~low & ~off).withColumn("fail_reason", text)


def apply_filter(df: DataFrame, verdicts: DataFrame | None = None, key: str = "id", col: str = "text", latest: str = "ts") -> DataFrame:
    """Adds kept, stage and reject_reason; with verdicts, the judge's columns too.

    Only texts that pass the heuristics go to the judge; of several verdicts the latest counts, and
    of several at that time the one of the largest hash.
    """
    checked = with_reason(df, col, "_reason")
    passed = F.col("_reason") == "ok"
    if verdicts is None:
        return checked.select(*df.columns, passed.alias("kept"), F.when(~passed, "heuristic").alias("stage"), F.when(~passed, F.col("_reason")).alias("reject_reason"))
    verdict = ("ok", "fail_reason", "score", "intensity_obs", "natural")
    last = F.max_by(F.struct(*verdict), F.struct(F.col(latest), F.xxhash64(*verdict)))
    judged = verdicts.groupBy(F.col(key).alias("_key")).agg(last.alias("_v"))
    joined = checked.join(judged, (F.col(key) == F.col("_key")) & passed, "left")
    why = F.when(~passed, F.col("_reason")).when(F.col("_v").isNull(), "judge_no_verdict").when(~F.col("_v.ok"), F.col("_v.fail_reason"))
    return joined.select(
        *df.columns,
        (passed & F.coalesce("_v.ok", F.lit(False))).alias("kept"),
        F.when(~passed, "heuristic").when(~F.coalesce("_v.ok", F.lit(False)), "judge").alias("stage"),
        why.alias("reject_reason"),
        F.col("_v.score").alias("judge_score"),
        F.col("_v.intensity_obs").alias("judge_intensity_obs"),
        F.col("_v.natural").alias("judge_natural"),
    )


def rejection_summary(filtered: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent reasons."""
    return filtered.where(~F.col("kept")).groupBy("reject_reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reject_reason").limit(k)


def retention_report(filtered: DataFrame, label: str = "label") -> DataFrame:
    """Rows and kept rows, overall and by label, and what is left after each stage."""
    rows, kept = F.count("*"), F.sum(F.col("kept").cast("bigint"))
    past = F.sum((~F.coalesce(F.col("stage") == "heuristic", F.lit(False))).cast("bigint"))
    aggs = [rows.alias("rows"), past.alias("past_heuristics"), kept.alias("kept")]
    parts = filtered.groupBy(F.col(label).cast("string").alias("label")).agg(*aggs)
    # The whole is the sum of the parts: both read one shuffle, and the texts are judged once.
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    whole = parts.agg(total("rows"), total("past_heuristics"), total("kept")).select(F.lit("all").alias("label"), "rows", "past_heuristics", "kept")
    return whole.unionByName(parts).withColumn("kept_percent", 100 * ratio(F.col("kept"), F.col("rows")))


def text_profile(df: DataFrame, col: str = "text") -> DataFrame:
    """Rows, empty texts, exact duplicates, and the words of the texts that are not empty."""
    clean = strip(F.coalesce(F.col(col), F.lit("")))
    n = F.when(clean != "", F.size(words(clean)))
    made = df.select(clean.alias("t"), n.alias("n"), F.xxhash64(clean).alias("h"), F.md5(clean).alias("m"))
    return made.agg(
        F.count("*").alias("rows"),
        F.sum((F.col("t") == "").cast("bigint")).alias("empty"),
        (F.count("*") - F.count_distinct("h", "m")).alias("duplicates"),
        F.min("n").cast("bigint").alias("min_words"),
        F.percentile("n", 0.5).alias("median_words"),
        F.avg("n").alias("mean_words"),
        F.max("n").cast("bigint").alias("max_words"),
    )


def dedupe_text(df: DataFrame, order_by: str, keys: Sequence[str] = (), col: str = "text") -> DataFrame:
    """One row of each normalised text, and of each value of keys if given: the first by order_by.

    Rows without order_by come last, and of rows that tie the one of the least hash stays. Each
    task keeps one row of a text before the shuffle, so that no task gathers the copies of a text.
    """
    order = F.struct(F.col(order_by).isNull(), F.col(order_by), F.xxhash64(*df.columns))
    first = F.min_by(F.struct(*df.columns), order).alias("_row")
    found = df.groupBy(F.sha2(normalised(F.col(col)), 256).alias("_h"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(first)
    return found.select(*[F.col("_row")[c].alias(c) for c in df.columns])


def peek(df: DataFrame, label: str, value, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """n seeded random rows of one class."""
    return df.where(F.col(label) == value).orderBy(seeded(seed, *[F.col(k) for k in keys]), *keys).limit(n)


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))
