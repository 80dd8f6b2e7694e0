"""How many utterances to generate, and with which properties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.expr import class_name, literal_map, ranked, round_binary, seeded_int

AXES = ("intensity", "cause", "style", "persona", "turn_position")


def class_deficit(df: DataFrame, target: int, overrides: dict[str, int] | None = None, scale: float = 1.0, label: str = "label") -> DataFrame:
    """label, have, n: how many rows each class needs; overrides replace all counts, absent classes get 0."""
    every = df.sparkSession.createDataFrame([(c,) for c in K.CLASSES], "label string")
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("have"))
    whole = every.join(counts, "label", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    if overrides is not None:
        need = F.coalesce(F.try_element_at(literal_map({c: overrides.get(c, 0) for c in K.CLASSES}), F.col("label")), F.lit(0))
    else:
        need = F.greatest(F.lit(0), F.lit(target) - F.col("have"))
    return whole.select("label", "have", F.bround(need * F.lit(float(scale))).cast("bigint").alias("n"))


def rules_table(spark: SparkSession, rules: dict = K.CLASS_RULES) -> DataFrame:
    """label, intensities, causes, styles."""
    return spark.createDataFrame([(c, list(i), list(w), list(s)) for c, (i, w, s) in rules.items()], "label string, intensities array<int>, causes array<string>, styles array<string>")


def sample_points(plan: DataFrame, rules: DataFrame, seed: int = 42) -> DataFrame:
    """label, idx and the five axes for n points of each class of plan (label, n).

    Every choice is a function of (seed, class, index, axis).
    """
    pick = lambda values, axis: F.element_at(values, (seeded_int(seed, F.col("label"), F.col("idx"), F.lit(axis)) % F.size(values) + 1).cast("int"))
    fixed = lambda values: F.array(*[F.lit(v) for v in values])
    points = plan.where("n > 0").join(F.broadcast(rules), "label").withColumn("idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    return points.select(
        "label",
        "idx",
        pick(F.col("intensities"), "intensity").alias("intensity"),
        pick(F.col("causes"), "cause").alias("cause"),
        pick(F.col("styles"), "style").alias("style"),
        pick(fixed(K.PERSONAS), "persona").alias("persona"),
        pick(fixed(K.TURNS), "turn_position").alias("turn_position"),
    )


def combination_space(rules: DataFrame) -> DataFrame:
    """label, combinations."""
    return rules.select("label", (F.size("intensities") * F.size("causes") * F.size("styles") * len(K.PERSONAS) * len(K.TURNS)).cast("bigint").alias("combinations"))


def axis_totals(rules: dict = K.CLASS_RULES) -> dict[str, int]:
    causes = {c for _, found, _ in rules.values() for c in found}
    styles = {s for _, _, found in rules.values() for s in found}
    return {"intensity": 5, "cause": len(causes), "style": len(styles), "persona": len(K.PERSONAS), "turn_position": len(K.TURNS)}


def axis_coverage(points: DataFrame, rules: dict = K.CLASS_RULES) -> DataFrame:
    """axis, seen, possible."""
    one = points.agg(*[F.count_distinct(a).alias(a) for a in AXES])
    totals = literal_map(axis_totals(rules))
    return one.unpivot([], list(AXES), "axis", "seen").select("axis", "seen", F.element_at(totals, F.col("axis")).cast("bigint").alias("possible"))


def point_json() -> Column:
    """The point as JSON with sorted keys and a space after every comma and colon."""
    text = lambda c: F.concat(F.lit(f'"{c}": "'), F.col(c), F.lit('"'))
    return F.concat(F.lit("{"), F.concat_ws(", ", text("cause"), F.concat(F.lit('"intensity": '), F.col("intensity").cast("string")), text("label"), text("persona"), text("style"), text("turn_position")), F.lit("}"))


def short_hash(text: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.substring(F.sha1(text.cast("binary")), 1, 16))


def generation_plan(points: DataFrame) -> DataFrame:
    """Adds id, prompt and prompt_hash to points."""
    word = F.element_at(literal_map(K.INTENSITY_WORDS), F.col("intensity"))
    # The lines of a prompt.
    lines = [
        F.lit("Generate ONE customer-support utterance with these properties:"),
        F.concat(F.lit("  Emotion: "), F.col("label")),
        F.concat(F.lit("  Intensity: "), word, F.lit(" ("), F.col("intensity").cast("string"), F.lit("/5)")),
        F.concat(F.lit("  Cause / topic: "), F.col("cause")),
        F.concat(F.lit("  Style: "), F.col("style")),
        F.concat(F.lit("  Speaker persona: "), F.col("persona")),
        F.concat(F.lit("  Turn position in call: "), F.col("turn_position")),
    ]
    name = F.concat(F.element_at(literal_map(K.SHORT_NAMES), F.col("label")), F.lit("_"), F.format_string("%05d", "idx"))
    return points.select(name.alias("id"), "*", F.concat_ws("\n", *lines).alias("prompt"), short_hash(point_json()).alias("prompt_hash"))


def hash_collisions(plan: DataFrame) -> DataFrame:
    """prompt_hash, n of the hashes that several points share."""
    return plan.groupBy("prompt_hash").agg(F.count("*").alias("n")).where("n > 1")


def assign_voices(df: DataFrame, order_by: Sequence[str], label: str = "label", voices: Sequence[str] = K.VOICES) -> DataFrame:
    """Adds voice: round-robin within each class in the given order."""
    numbered = ranked(df, [label], [F.col(c) for c in order_by], "_at")
    return numbered.withColumn("voice", F.element_at(F.array(*[F.lit(v) for v in voices]), (F.col("_at") % len(voices) + 1).cast("int"))).drop("_at")


def speech_instructions(df: DataFrame) -> DataFrame:
    """Adds instruction and instruction_hash; an unknown style, persona or turn stands for itself."""
    hint = lambda values, c: F.coalesce(F.try_element_at(literal_map(values), F.col(c)), F.col(c))
    tone = F.coalesce(F.try_element_at(literal_map(K.TONES), F.col("intensity")), F.lit("moderate"))
    text = F.concat_ws(
        " ",
        F.try_element_at(literal_map(K.SPEECH_OF_CLASS), F.col("label")),
        F.concat(F.lit("Intensity: "), tone, F.lit(" ("), F.col("intensity").cast("string"), F.lit("/5).")),
        F.concat(F.lit("Style: "), hint(K.STYLE_HINTS, "style"), F.lit(".")),
        F.concat(F.lit("Persona: "), hint(K.PERSONA_HINTS, "persona"), F.lit(".")),
        F.concat(F.lit("Turn position: "), hint(K.TURN_HINTS, "turn_position"), F.lit(".")),
        F.lit(K.SPEECH_END),
    )
    return df.withColumn("instruction", text).withColumn("instruction_hash", short_hash(F.col("instruction")))


JUDGE_COLUMNS = ("judge_score", "judge_intensity_obs", "judge_natural")


def manifest_rows(records: DataFrame, clips: DataFrame, model: str, key: str = "id") -> DataFrame:
    """One row of 19 fields for each voiced record: what was asked for, how it was spoken, and where the clip lies.

    records: the key, label, label_id, text, the axes, voice (assign_voices), instruction_hash
    (speech_instructions) and, if they were judged, judge_score, judge_intensity_obs and judge_natural.
    clips: the key, duration_sec, sample_rate, audio_path, ts. A record without a clip has failed and
    gets no row; of several clips of a key the last by (ts, path) counts. Marks are texts, as a
    manifest in CSV holds them: an absent column or a null mark is empty, a boolean is True or False.
    """

    def mark(c: str) -> Column:
        if c not in records.columns:
            return F.lit("").alias(c)
        text = F.col(f"`{c}`").cast("string")
        return F.coalesce(F.initcap(text) if dict(records.dtypes)[c] == "boolean" else text, F.lit("")).alias(c)

    last = clips.groupBy(F.col(key).alias("audio_id")).agg(F.max(F.struct("ts", "audio_path", "duration_sec", "sample_rate")).alias("clip"))
    asked = records.select(F.col(key).alias("audio_id"), "label", "label_id", "text", *AXES, "voice", "instruction_hash", *[mark(c) for c in JUDGE_COLUMNS])
    return asked.join(last, "audio_id").select(
        "audio_id",
        "label",
        "label_id",
        "text",
        *AXES,
        "voice",
        "instruction_hash",
        round_binary(F.col("clip.duration_sec").cast("double"), 3).alias("duration_sec"),
        F.col("clip.sample_rate").cast("int").alias("sample_rate"),
        *JUDGE_COLUMNS,
        F.lit(model).alias("model"),
        F.col("clip.ts").alias("ts"),
        F.replace(F.col("clip.audio_path"), F.lit("\\"), F.lit("/")).alias("audio_path"),
    )


def manifest_summary(df: DataFrame, label: str = "label", duration: str = "duration_sec") -> DataFrame:
    """label, clips, mean_duration of durations to three places; the row `all` is for all."""
    rows = df.select(F.col(label).alias("label"), F.bround(F.col(duration).cast("double"), 3).alias("d"))
    aggs = [F.count("*").alias("clips"), F.avg("d").alias("mean_duration")]
    return rows.agg(*aggs).select(F.lit("all").alias("label"), "clips", "mean_duration").unionByName(rows.groupBy("label").agg(*aggs))


def class_of(number: Column) -> Column:
    """The class that a number stands for, by its remainder."""
    return class_name((number % len(K.CLASSES)).cast("int"))
