"""What is registered, and the inputs that queries share.

The inputs are formulas over the given tables: whole numbers up to one division, so that
both engines compute the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace(", 6)", " + 1e-9::DOUBLE, 6)")
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A class name by its id, as SQL.
NAME = "CASE {} WHEN 0 THEN 'anger' WHEN 1 THEN 'frustration' WHEN 2 THEN 'sadness' WHEN 3 THEN 'neutral' WHEN 4 THEN 'satisfaction' END"


def _shares(model: int, names: list[str], classes: list[int]) -> tuple[str, str]:
    """SQL of raw weights w<model>_<k>, and of their shares under the given names."""
    raw = [f"(id * {101 + 17 * k} + pos * {53 + 29 * k + 7 * model} + len * {7 + k} + {model * 389}) % 997 + 1 + CASE WHEN c = {klass} THEN 4000 ELSE 0 END AS w{model}_{k}" for k, klass in enumerate(classes)]
    total = " + ".join(f"w{model}_{k}" for k in range(len(classes)))
    return ", ".join(raw), ", ".join(f"CAST(w{model}_{k} AS DOUBLE) / CAST({total} AS DOUBLE) AS {n}" for k, n in enumerate(names))


_TEXT = _shares(0, ["prob_anger", "prob_frust", "prob_sadne", "prob_neutr", "prob_satis"], [0, 1, 2, 3, 4])
_GOEMO = _shares(1, [f"goemo_{e}" for e in ("anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise")], [0, 1, 1, 4, 3, 2, 3])
_AUDIO = _shares(3, ["sb_ang", "sb_hap", "sb_sad", "sb_neu"], [0, 4, 2, 3])

def _gap(kind: int, value: str) -> str:
    return f"CASE WHEN gap = {kind} THEN NULL ELSE {value} END"


#: A score and its column name, with the gaps of its kind.
_LACKS = {**dict.fromkeys(["prob_anger", "prob_sadne", "prob_neutr", "prob_satis"], "gap = 0"), "prob_frust": "gap IN (0, 1)", "goemo_fear": "gap = 1", "sb_sad": "gap = 1"}


def _with_gaps(shares: str) -> str:
    parts = [p.rsplit(" AS ", 1) for p in shares.split(", ")]
    return ", ".join(f"CASE WHEN {_LACKS[n]} THEN NULL ELSE {x} END AS {n}" if n in _LACKS else f"{x} AS {n}" for x, n in parts)


#: One row per turn of conversations: keys, truth, split, and the scores of four models. One row in 13 has a
#: gap: no vector of the text model, single scores, no compound score, or a truth that is missing or none of the classes.
SCORES = f"""
SELECT id AS dialogue_id, pos AS utterance_id, text, truth, {NAME.format("truth")} AS true_label,
       CASE WHEN (id * 7 + pos) % 10 < 8 THEN 'train' WHEN (id * 7 + pos) % 10 = 8 THEN 'val' ELSE 'test' END AS split,
       CASE WHEN (id * 7 + pos) % 10 < 8 THEN 'train' WHEN (id * 7 + pos) % 10 = 8 THEN 'val' ELSE 'test' END || '_' || CAST(id * 1000 + pos AS STRING) AS audio_id,
       CASE WHEN pos % 2 = 0 THEN 'Data/Dia' ELSE 'data/dia' END || CAST(id AS STRING) || '_utt' || CAST(pos AS STRING) || '.flac' AS path,
       CASE (id * 7 + pos * 3 + len) % 7 WHEN 0 THEN ' Anger' WHEN 1 THEN 'disgust ' WHEN 2 THEN 'FEAR' WHEN 3 THEN 'joy' WHEN 4 THEN 'neutral' WHEN 5 THEN 'sadness' ELSE 'surprise' END AS emotion,
       {_gap(2, "CAST((id * 1009 + pos * 917 + len * 7) % 2001 - 1000 AS DOUBLE) / CAST(1000 AS DOUBLE)")} AS vader_compound,
       CAST((id * 3 + pos * 5 + len) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS vader_pos,
       CAST((id * 5 + pos * 7 + len) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS vader_neg,
       CAST((id * 7 + pos * 11 + len) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS vader_neu,
       {_with_gaps(_TEXT[1])}, {_with_gaps(_GOEMO[1])}, {_with_gaps(_AUDIO[1])}
FROM (SELECT *, CASE WHEN gap = 3 THEN CASE WHEN pos % 2 = 0 THEN -1 END WHEN (id + pos) % 4 = 0 THEN (c + 1) % 5 ELSE c END AS truth, {_TEXT[0]}, {_GOEMO[0]}, {_AUDIO[0]}
      FROM (SELECT *, CASE WHEN h < 3 THEN h WHEN h < 8 THEN 3 ELSE 4 END AS c, CASE WHEN (id * 3 + pos) % 13 = 0 THEN (id + pos) % 4 ELSE -1 END AS gap
            FROM (SELECT id, pos, len, text, (id * 31 + pos * 17 + len * 13) % 11 AS h
                  FROM (SELECT conv_id AS id, turn AS pos, length(coalesce(text, '')) AS len, text FROM {{conversations}}) t0) t1) t2) t3
"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SCORES, conversations=table(spark, sf_dir, "conversations"))


#: Late fusion weights of the queries, text, goemo, lexicon, audio; scaled to sum 1.
WEIGHTS = {"text": 0.5, "goemo": 0.5, "lexicon": 0.3, "audio": 0.5}
_SCALED = [w / sum(WEIGHTS.values()) for w in WEIGHTS.values()]

_LEXICON_SQL = """CASE WHEN vader_compound IS NULL THEN NULL WHEN vader_compound < -0.3::DOUBLE THEN [0.5, 0.3, 0.15, 0.05, 0.0]::DOUBLE[] WHEN vader_compound < -0.05::DOUBLE THEN [0.15, 0.25, 0.4, 0.2, 0.0]::DOUBLE[]
  WHEN vader_compound <= 0.1::DOUBLE THEN [0.0, 0.1, 0.15, 0.6, 0.15]::DOUBLE[] WHEN vader_compound <= 0.3::DOUBLE THEN [0.1, 0.0, 0.1, 0.35, 0.45]::DOUBLE[] ELSE [0.05, 0.0, 0.1, 0.25, 0.6]::DOUBLE[] END"""
_GOEMO_TOTAL = "(goemo_anger + (goemo_disgust + coalesce(goemo_fear, 0)) + goemo_sadness + goemo_neutral + goemo_joy)"


def vector_sql(names: list[str]) -> str:
    """A list of scores with 0 for missing ones, null without any."""
    return f"CASE WHEN coalesce({', '.join(n for n in names if n)}) IS NOT NULL THEN [{', '.join(f'coalesce({n}, 0.0::DOUBLE)' if n else '0.0::DOUBLE' for n in names)}] END"


def at(vector: str, k: int) -> str:
    """An element, from 1, or 0 where it is missing."""
    return f"coalesce({vector}[{k}], 0.0::DOUBLE)"


_FUSED = ", ".join(" + ".join(f"{w!r}::DOUBLE * {at(v, k)}" for w, v in zip(_SCALED, ("text_probs", "goemo_probs", "lexicon_probs", "audio_probs"))) for k in range(1, 6))

#: DuckDB: scores; probs with the four vectors; fused with the late fusion of them.
WITH_SCORES = f"WITH scores AS ({SCORES.format(conversations='conversations')})"
WITH_PROBS = f"""{WITH_SCORES}, probs AS (
  SELECT *, {vector_sql(K.TEXT_COLUMNS)} AS text_probs,
         [goemo_anger / {_GOEMO_TOTAL}, (goemo_disgust + coalesce(goemo_fear, 0)) / {_GOEMO_TOTAL}, goemo_sadness / {_GOEMO_TOTAL}, goemo_neutral / {_GOEMO_TOTAL}, goemo_joy / {_GOEMO_TOTAL}] AS goemo_probs,
         {_LEXICON_SQL} AS lexicon_probs, {vector_sql(["sb_ang", None, "sb_sad", "sb_neu", "sb_hap"])} AS audio_probs
  FROM scores)"""
WITH_FUSED = f"""{WITH_PROBS}, fused0 AS (SELECT *, [{_FUSED}] AS fused FROM probs),
fused AS (SELECT *, list_position(fused, list_max(fused)) - 1 AS pred FROM fused0)"""


def probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import projection as P

    rows = scores(spark, sf_dir)
    whole = P.audio_probs(P.lexicon_probs(P.text_probs(rows)))
    return whole.withColumn("goemo_probs", P.goemo_probs_of([c for c in rows.columns if c != "goemo_surprise"], normalise=True))


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.fusion import late_fusion

    return late_fusion(probs(spark, sf_dir), WEIGHTS)


#: Sentences of whole documents, some with a mark that curation looks for.
_MARKED = """CASE (doc_id + pos) % 12 WHEN 0 THEN '\u201c' || s || '\u2019s' WHEN 1 THEN s || ' \u2014 and\u2026' WHEN 2 THEN s || '\u00a0\u2009 x' WHEN 3 THEN 'zero\u200bwidth ' || s
  WHEN 4 THEN s || ' \U0001f600' WHEN 5 THEN '"' || s || '"' WHEN 6 THEN s || ' I''m sorry, but no' WHEN 7 THEN s || ' Style: x' WHEN 8 THEN '' WHEN 9 THEN 'two words' ELSE s END"""
_SENTENCE_COLUMNS = f"""SELECT doc_id * 1000000 + pos AS id, doc_id, pos, {NAME.format("(doc_id + pos) % 5")} AS label, CAST((doc_id + pos) % 5 AS INT) AS label_id,
  {_MARKED} AS text, CAST(1 + (doc_id * 17 + pos) % 5 AS INT) AS intensity, CAST(1 + (doc_id * 13 + pos * 3) % 5 AS INT) AS score, CAST(1 + (doc_id * 29 + pos * 5) % 5 AS INT) AS intensity_obs, CAST(doc_id % 7 AS INT) AS ts"""
SENTENCES = _SENTENCE_COLUMNS + " FROM (SELECT doc_id, pos, s FROM {documents} LATERAL VIEW posexplode(split(coalesce(text, ''), '[.] ')) x AS pos, s) t"
WITH_SENTENCES = f"""WITH sentences AS ({_SENTENCE_COLUMNS}
  FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS s FROM (SELECT doc_id, string_split(coalesce(text, ''), '. ') AS l FROM documents)))"""
#: DuckDB: plain is the normalised text, reason the first rule it fails.
_STRIP = "regexp_replace(regexp_replace({}, '^\\s+', ''), '\\s+$', '')"
_SINGLE = {c: plain for c, plain in K.PLAIN.items() if len(plain) == 1}
_FROM, _TO = "".join([*_SINGLE, *[c for c, plain in K.PLAIN.items() if not plain]]), "".join(_SINGLE.values()).replace("'", "''")
_PLAIN = _STRIP.format(f"regexp_replace(replace(translate(text, '{_FROM}', '{_TO}'), '\u2026', '...'), '[ \\t]+', ' ', 'g')")
_BANNED = " ".join("WHEN contains(lower(plain), '{0}') THEN 'banned_phrase(''{0}'')'".format(p.replace("'", "''")) for p in K.BANNED_PHRASES)
WITH_REASONS = f"""{WITH_SENTENCES}, plains AS (SELECT * REPLACE (text AS text), {_PLAIN} AS plain FROM sentences),
counted AS (SELECT *, len(list_filter(regexp_split_to_array(plain, '\\s+'), lambda x: x <> '')) AS nw FROM plains),
reasons AS (SELECT *, CASE WHEN plain = '' THEN 'empty' WHEN nw < 4 THEN 'too_short(' || nw || 'w)' WHEN nw > 60 THEN 'too_long(' || nw || 'w)'
  WHEN regexp_matches(plain, '[\\x{{1F300}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}\\x{{1F000}}-\\x{{1F2FF}}]') THEN 'emoji'
  WHEN (starts_with(plain, '"') AND ends_with(plain, '"')) OR (starts_with(plain, '''') AND ends_with(plain, '''')) THEN 'wrapped_in_quotes'
  {_BANNED} WHEN regexp_matches(plain, '(?i)\\b(label|persona|style|cause|intensity)\\b[: =]') THEN 'axis_leak' ELSE 'ok' END AS reason FROM counted)"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SENTENCES, documents=table(spark, sf_dir, "documents"))


def plain_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.curation import normalise_text

    return normalise_text(sentences(spark, sf_dir))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to six places, at the edge of a query.

    The engines round decimal ties apart, so both sides first add a billionth.
    """
    return df.withColumns({c: six(F.col(c)) for c in columns})


def six(x: Column) -> Column:
    return F.round(x + F.lit(1e-9), 6)


def confusion_sql(source: str, by: str = "", truth: str = "truth", pred: str = "pred") -> str:
    """DuckDB CTEs cells, classes and summary over a source, in groups of `by` (one column or none)."""
    g, on = (f"{by}, ", f"AND c.{by} IS NOT DISTINCT FROM k.{by}") if by else ("", "")
    groups = f"(SELECT DISTINCT {by} FROM {source})" if by else "(SELECT 1)"
    q = f"g.{by}, " if by else ""
    return f"""ids AS (SELECT range AS i FROM range(5)),
cells AS (SELECT {q}t.i AS truth, p.i AS pred, count(s.{truth}) AS n FROM {groups} g CROSS JOIN ids t CROSS JOIN ids p
  LEFT JOIN {source} s ON s.{truth} = t.i AND s.{pred} = p.i {f"AND s.{by} IS NOT DISTINCT FROM g.{by}" if by else ""} GROUP BY ALL),
classes AS (SELECT {g}i AS class_id, sum(CASE WHEN truth = i THEN n ELSE 0 END) AS support, sum(CASE WHEN pred = i THEN n ELSE 0 END) AS predicted,
  sum(CASE WHEN truth = i AND pred = i THEN n ELSE 0 END) AS hits FROM cells CROSS JOIN ids GROUP BY ALL),
scored AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall,
  CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * hits / (support + predicted) END AS f1 FROM classes),
summary AS (SELECT {g}CAST(sum(support) AS BIGINT) AS n, CASE WHEN sum(support) = 0 THEN 0 ELSE sum(hits) / sum(support) END AS accuracy, CASE WHEN sum(support) = 0 THEN 0 ELSE sum(f1 * support) / sum(support) END AS weighted_f1,
  coalesce(avg(CASE WHEN support + predicted > 0 THEN f1 END), 0) AS macro_f1, max(CASE WHEN class_id = 1 THEN recall END) AS frustration_recall, max(CASE WHEN class_id = 1 THEN f1 END) AS frustration_f1
  FROM scored GROUP BY ALL)"""
