"""Curation of texts and sampling plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import curation as T
from ..plans import sampling as G
from .registry import NAME, WITH_REASONS, WITH_SENTENCES, plain_sentences, query, rounded, sentences, table


@query(f"{WITH_REASONS} SELECT id, plain AS text FROM reasons")
def t1_normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_sentences(spark, sf_dir).select("id", "text")


@query(f"{WITH_REASONS} SELECT count(*) AS n, count(*) FILTER (plain <> text) AS modified FROM reasons")
def t2_count_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.count_modified(sentences(spark, sf_dir))


@query(f"{WITH_REASONS} SELECT id, reason FROM reasons")
def t3_heuristic_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.heuristic_reason(plain_sentences(spark, sf_dir)).select("id", "reason")


_ANSWERS = """SELECT id, CASE WHEN id % 35 = 5 THEN '{"score": "' || score || '", "intensity_obs": 3.7}' WHEN id % 35 = 15 THEN '{"score": ' || score || ', "natural": "yes", "intensity_obs": null}'
  WHEN id % 35 = 25 THEN '{"verdict": 1, "natural": 0, "reason": [1, "a"]}' WHEN id % 35 = 30 THEN '{}' ELSE CASE id % 5 WHEN 0 THEN '{"score": ' || score || ', "intensity_obs": ' || intensity_obs || ', "natural": false, "reason": "r' || id || '"}'
  WHEN 1 THEN '```json ' || '{"score": ' || score || '}' || ' ```' WHEN 2 THEN 'Verdict: {"score": ' || score || ', "reason": "x"} done' WHEN 3 THEN 'no verdict' ELSE '{"score": ' END END AS response, score, intensity_obs FROM {sentences}"""


#: Answers of other types than usual: text of a number, a text for natural, no field that is known, an empty object.
@query(f"""{WITH_SENTENCES} SELECT id, id % 5 < 3 AND id % 35 <> 30 AS parsed, CASE WHEN id % 35 = 25 THEN 0::DOUBLE WHEN id % 35 <> 30 AND id % 5 < 3 THEN score::DOUBLE END AS score,
  CASE id % 35 WHEN 5 THEN 3::DOUBLE WHEN 15 THEN 0::DOUBLE WHEN 25 THEN 0::DOUBLE WHEN 30 THEN NULL ELSE CASE WHEN id % 5 = 0 THEN intensity_obs::DOUBLE WHEN id % 5 < 3 THEN 0::DOUBLE END END AS intensity_obs,
  CASE id % 35 WHEN 5 THEN 'true' WHEN 15 THEN 'true' WHEN 25 THEN 'false' WHEN 30 THEN NULL ELSE CASE WHEN id % 5 = 0 THEN 'false' WHEN id % 5 < 3 THEN 'true' END END AS "natural",
  CASE id % 35 WHEN 5 THEN '' WHEN 15 THEN '' WHEN 25 THEN '[1,"a"]' WHEN 30 THEN NULL ELSE CASE id % 5 WHEN 0 THEN 'r' || id WHEN 1 THEN '' WHEN 2 THEN 'x' END END AS reason FROM sentences""")
def t4_parse_judge_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentences(spark, sf_dir)
    answer = F.expr(_ANSWERS.split("SELECT id, ")[1].split(" AS response")[0])
    parsed = T.parse_judge_json(rows.select("id", answer.alias("response"))).drop("response")
    return parsed.withColumns({"score": F.col("score").cast("double"), "intensity_obs": F.col("intensity_obs").cast("double"), "natural": F.col("natural").cast("string")})


_FAILS = "CASE WHEN score < 3 THEN 'low_judge_score(' || score || ')' WHEN abs(intensity_obs - intensity) > 2 THEN 'intensity_mismatch(' || intensity_obs || 'vs' || intensity || ')' ELSE '' END"


@query(f"{WITH_SENTENCES} SELECT id, score >= 3 AND abs(intensity_obs - intensity) <= 2 AS ok, {_FAILS} AS fail_reason FROM sentences")
def t5_judge_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.judge_verdict(sentences(spark, sf_dir)).select("id", "ok", "fail_reason")


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plain_sentences(spark, sf_dir)
    verdicts = T.judge_verdict(sentences(spark, sf_dir)).where("id % 10 <> 3").select("id", "ok", "fail_reason", "score", "intensity_obs", (F.col("id") % 2 == 0).alias("natural"), "ts")
    return T.apply_filter(rows.drop("score", "intensity_obs"), verdicts)


_WITH_FILTERED = f"""{WITH_REASONS}, filtered AS (SELECT id, label, reason = 'ok' AND id % 10 <> 3 AND score >= 3 AND abs(intensity_obs - intensity) <= 2 AS kept,
  CASE WHEN reason <> 'ok' THEN 'heuristic' WHEN id % 10 = 3 OR {_FAILS} <> '' THEN 'judge' END AS stage,
  CASE WHEN reason <> 'ok' THEN reason WHEN id % 10 = 3 THEN 'judge_no_verdict' WHEN {_FAILS} <> '' THEN {_FAILS} END AS reject_reason,
  CASE WHEN reason = 'ok' AND id % 10 <> 3 THEN score::DOUBLE END AS judge_score FROM reasons)"""


@query(f"{_WITH_FILTERED} SELECT * FROM filtered")
def t6_apply_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir).select("id", "label", "kept", "stage", "reject_reason", F.col("judge_score").cast("double").alias("judge_score"))


@query(f"{_WITH_FILTERED} SELECT reject_reason, count(*) AS n FROM filtered WHERE NOT kept GROUP BY ALL ORDER BY n DESC, reject_reason LIMIT 10")
def t7_rejection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.rejection_summary(filtered(spark, sf_dir))


@query(f"""{_WITH_FILTERED}, r AS (SELECT 'all' AS label, count(*) AS rows, count(*) FILTER (stage IS DISTINCT FROM 'heuristic') AS past_heuristics, count(*) FILTER (kept) AS kept FROM filtered
  UNION ALL SELECT label, count(*), count(*) FILTER (stage IS DISTINCT FROM 'heuristic'), count(*) FILTER (kept) FROM filtered GROUP BY label)
SELECT *, round(100 * kept / rows, 6) AS kept_percent FROM r""")
def t8_retention_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.retention_report(filtered(spark, sf_dir)), "kept_percent")


@query(f"""{WITH_REASONS}, n AS (SELECT plain, CASE WHEN plain <> '' THEN nw END AS nw FROM reasons)
SELECT count(*) AS rows, count(*) FILTER (plain = '') AS empty, count(*) - count(DISTINCT plain) AS duplicates, min(nw) AS min_words, quantile_cont(nw, 0.5)::DOUBLE AS median_words, round(avg(nw), 6) AS mean_words, max(nw) AS max_words FROM n""")
def t9_text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.text_profile(plain_sentences(spark, sf_dir)), "mean_words")


@query(f"{WITH_REASONS} SELECT id, text FROM reasons QUALIFY row_number() OVER (PARTITION BY plain ORDER BY id) = 1")
def t10_dedupe_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.dedupe_text(sentences(spark, sf_dir).select("id", "text"), "id")


@query(f"{WITH_SENTENCES} SELECT id, text FROM sentences WHERE label = 'frustration' ORDER BY md5('42|' || id), id LIMIT 25")
def t11_peek(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.peek(sentences(spark, sf_dir), "label", "frustration", 25, ["id"]).select("id", "text")


@query(f"{WITH_SENTENCES} SELECT label, count(*) AS n FROM sentences GROUP BY label")
def t11_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.label_counts(sentences(spark, sf_dir), "label")


#: The target grows with the table: a third of all sentences for each class.
_TARGET = "(SELECT CAST(count(*) // 3 AS BIGINT) FROM sentences)"


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentences(spark, sf_dir).select("label")
    return G.class_deficit(rows, rows.count() // 3, scale=0.25)


@query(f"{WITH_SENTENCES} SELECT label, count(*) AS have, CAST(round_even(greatest(0, {_TARGET} - count(*)) * 0.25, 0) AS BIGINT) AS n FROM sentences GROUP BY label")
def g1_class_deficit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir)


_RULES = ", ".join(
    f"('{c}', {list(i)}, {list(w)}, {list(s)})" for c, (i, w, s) in K.CLASS_RULES.items()
)


def _pick(values: str, axis: str) -> str:
    return f"{values}[('0x' || substr(md5('42|' || label || '|' || idx || '|{axis}'), 1, 8))::BIGINT % len({values}) + 1]"


_PERSONAS = "['young_informal', 'elderly_formal', 'business_user', 'technically_savvy', 'first_time_caller', 'regular_complainant']"
_TURNS = "['opening', 'mid_call', 'escalation', 'closing']"
_WITH_POINTS = f"""{WITH_SENTENCES}, plan AS (SELECT label, CAST(round_even(greatest(0, {_TARGET} - count(*)) * 0.25, 0) AS BIGINT) AS n FROM sentences GROUP BY label),
rules(label, intensities, causes, styles) AS (VALUES {_RULES}),
indexed AS (SELECT label, intensities, causes, styles, unnest(range(n)) AS idx FROM plan JOIN rules USING (label)),
points AS (SELECT label, idx, {_pick("intensities", "intensity")} AS intensity, {_pick("causes", "cause")} AS cause, {_pick("styles", "style")} AS style, {_pick(_PERSONAS, "persona")} AS persona, {_pick(_TURNS, "turn_position")} AS turn_position FROM indexed),
hashed AS (SELECT *, 'sha1:' || substr(sha1('{{"cause": "' || cause || '", "intensity": ' || intensity || ', "label": "' || label || '", "persona": "' || persona || '", "style": "' || style || '", "turn_position": "' || turn_position || '"}}'), 1, 16) AS prompt_hash FROM points)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sample_points(plan(spark, sf_dir), G.rules_table(spark))


@query(f"{_WITH_POINTS} SELECT * FROM points")
def g2_sample_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir)


@query(f"{_WITH_POINTS} SELECT label, CAST(len(intensities) * len(causes) * len(styles) * 24 AS BIGINT) AS combinations, n FROM rules JOIN plan USING (label)")
def g3_combination_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.combination_space(G.rules_table(spark)).join(plan(spark, sf_dir).select("label", "n"), "label")


@query(f"""{_WITH_POINTS} SELECT 'intensity' AS axis, count(DISTINCT intensity) AS seen, 5::BIGINT AS possible FROM points UNION ALL SELECT 'cause', count(DISTINCT cause), 16 FROM points UNION ALL SELECT 'style', count(DISTINCT style), 12 FROM points
UNION ALL SELECT 'persona', count(DISTINCT persona), 6 FROM points UNION ALL SELECT 'turn_position', count(DISTINCT turn_position), 4 FROM points""")
def g4_axis_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.axis_coverage(points(spark, sf_dir))


_SHORT = "CASE label WHEN 'anger' THEN 'anger' WHEN 'frustration' THEN 'frust' WHEN 'sadness' THEN 'sad' WHEN 'neutral' THEN 'neut' ELSE 'satis' END"
_PROMPT = """'Generate ONE customer-support utterance with these properties:' || chr(10) || '  Emotion: ' || label || chr(10) || '  Intensity: ' || CASE intensity WHEN 1 THEN 'very mild' WHEN 2 THEN 'mild' WHEN 3 THEN 'moderate' WHEN 4 THEN 'strong' ELSE 'extreme' END || ' (' || intensity || '/5)' || chr(10)
  || '  Cause / topic: ' || cause || chr(10) || '  Style: ' || style || chr(10) || '  Speaker persona: ' || persona || chr(10) || '  Turn position in call: ' || turn_position"""


@query(f"{_WITH_POINTS} SELECT {_SHORT} || '_' || printf('%05d', idx) AS id, label, {_PROMPT} AS prompt, prompt_hash FROM hashed")
def g5_generation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.generation_plan(points(spark, sf_dir)).select("id", "label", "prompt", "prompt_hash")


@query(f"{_WITH_POINTS} SELECT prompt_hash, count(*) AS n FROM hashed GROUP BY ALL HAVING count(*) > 1")
def g6_hash_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.hash_collisions(G.generation_plan(points(spark, sf_dir)))


@query(f"{WITH_SENTENCES} SELECT id, ['alloy', 'ash', 'ballad', 'coral', 'echo', 'fable', 'onyx', 'nova', 'sage', 'shimmer', 'verse'][(row_number() OVER (PARTITION BY label ORDER BY id) - 1) % 11 + 1] AS voice FROM sentences")
def g7_assign_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.assign_voices(sentences(spark, sf_dir).select("id", "label"), ["id"]).select("id", "voice")


def _sql_map(values: dict, key: str, other: str) -> str:
    quote = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"CASE {key} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in values.items()) + f" ELSE {other} END"


def _instruction_sql() -> str:
    return (
        f"{_sql_map(K.SPEECH_OF_CLASS, 'label', 'NULL')} || ' Intensity: ' || {_sql_map(K.TONES, 'intensity', repr('moderate'))} || ' (' || intensity || '/5). Style: ' || {_sql_map(K.STYLE_HINTS, 'style', 'style')} || '. Persona: ' || "
        f"{_sql_map(K.PERSONA_HINTS, 'persona', 'persona')} || '. Turn position: ' || {_sql_map(K.TURN_HINTS, 'turn_position', 'turn_position')} || '. {K.SPEECH_END}'"
    )


@query(f"{_WITH_POINTS}, t AS (SELECT label, idx, {_instruction_sql()} AS instruction FROM points) SELECT label, idx, instruction, 'sha1:' || substr(sha1(instruction), 1, 16) AS instruction_hash FROM t")
def g8_speech_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.speech_instructions(points(spark, sf_dir)).select("label", "idx", "instruction", "instruction_hash")


@query(f"""WITH m AS (SELECT {NAME.format("event_id % 5")} AS label, round_even(value, 3) AS d FROM events)
SELECT 'all' AS label, count(*) AS clips, round(avg(d), 6) AS mean_duration FROM m UNION ALL SELECT label, count(*), round(avg(d), 6) FROM m GROUP BY label""")
def g9_manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(G.class_of(F.col("event_id")).alias("label"), F.col("value").alias("duration_sec"))
    return rounded(G.manifest_summary(events), "mean_duration")


#: A clip for most sentences, two for some; the judge has no mark for every fifth.
_STYLES = str(list(K.STYLE_HINTS))
_RECORDS = """SELECT id, label, label_id, text, intensity, ts, 'cause_' || CAST(id % 16 AS STRING) AS cause, {styles} AS style, {personas} AS persona, {turns} AS turn_position,
  CASE WHEN id % 5 = 0 THEN NULL ELSE score END AS judge_score, CASE WHEN id % 7 > 0 THEN intensity_obs > 2 END AS judge_natural FROM {rows}"""
_CLIPS = """SELECT id, CAST((id * 37 % 9001) * 10 + id % 5 * 2 + again AS DOUBLE) / CAST(10000 AS DOUBLE) AS duration_sec, 16000 + again AS sample_rate, CAST(ts + again AS DOUBLE) AS ts,
  'data{slash}audio{slash}' || CAST(id AS STRING) || '_' || CAST(again AS STRING) || '.wav' AS audio_path FROM {rows} CROSS JOIN {attempts} WHERE id % 17 <> 3 AND (again = 0 OR id % 11 = 0)"""


def _spark_pick(values: list[str]) -> str:
    return f"element_at(array({', '.join(repr(v) for v in values)}), CAST(id % {len(values)} + 1 AS INT))"


def records_and_clips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = sentences(spark, sf_dir)
    records = spark.sql(_RECORDS.format(styles=_spark_pick(list(K.STYLE_HINTS)), personas=_spark_pick(list(K.PERSONAS)), turns=_spark_pick(list(K.TURNS)), rows="{rows}"), rows=rows)
    return records, spark.sql(_CLIPS.format(slash="\\\\", rows="{rows}", attempts="(VALUES (0), (1)) AS attempts(again)"), rows=rows)


@query(f"""{WITH_SENTENCES}, records AS ({_RECORDS.format(styles=f"{_STYLES}[id % len({_STYLES}) + 1]", personas=f"{_PERSONAS}[id % len({_PERSONAS}) + 1]", turns=f"{_TURNS}[id % len({_TURNS}) + 1]", rows="sentences")}),
attempts(again) AS (VALUES (0), (1)), clips AS ({_CLIPS.format(slash=chr(92), rows="sentences", attempts="attempts")}),
last_clips AS (SELECT * FROM clips QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, audio_path DESC) = 1),
spoken AS (SELECT *, ['alloy', 'ash', 'ballad', 'coral', 'echo', 'fable', 'onyx', 'nova', 'sage', 'shimmer', 'verse'][(row_number() OVER (PARTITION BY label ORDER BY id) - 1) % 11 + 1] AS voice, {_instruction_sql()} AS instruction FROM records)
SELECT r.id AS audio_id, label, label_id, text, intensity, cause, style, persona, turn_position, voice, 'sha1:' || substr(sha1(instruction), 1, 16) AS instruction_hash, CAST(printf('%.3f', duration_sec) AS DOUBLE) AS duration_sec, sample_rate,
  coalesce(CAST(judge_score AS VARCHAR), '') AS judge_score, '' AS judge_intensity_obs, CASE WHEN judge_natural IS NULL THEN '' WHEN judge_natural THEN 'True' ELSE 'False' END AS judge_natural,
  'tts' AS model, c.ts AS ts, replace(audio_path, chr(92), '/') AS audio_path FROM spoken r JOIN last_clips c USING (id)""")
def g11_manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, clips = records_and_clips(spark, sf_dir)
    return G.manifest_rows(G.speech_instructions(G.assign_voices(records, ["id"])), clips, "tts")
