"""Live decisions under any arrival, sinks that can be run again, and tables in buckets."""

import random

import pytest
from pyspark.sql import functions as F

from callweave.operators import features, handover, projection
from callweave.queries.files import bucketed_features
from callweave.sources import io
from callweave.streaming.live import ROCKSDB, FirstTrigger, stream_handover

SCHEMA = "dialogue_id int, utterance_id int, probs array<double>, fresh boolean"
CALM, SAD, STRONG = [0.0, 0.0, 0.0, 1.0, 0.0], [0.1, 0.1, 0.6, 0.2, 0.0], [0.9, 0.0, 0.0, 0.1, 0.0]


def live(spark, path, parts, **options):
    """What the stream gives, a part of rows to a micro-batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    out = stream_handover(stream, 0.6, 3, **options).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    out.awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(f"{path}/out").collect())


def calls(seed, count=12):
    rng = random.Random(seed)
    return [(d, u, rng.choice([CALM, CALM, SAD, SAD, [0.3, 0.2, 0.1, 0.4, 0.0], STRONG if rng.random() < 0.2 else CALM]), False) for d in range(count) for u in range(rng.randint(1, 9))]


def batch(spark, rows):
    found = handover.first_trigger(spark.createDataFrame(rows, SCHEMA), 0.6, 3).where("trigger_utt >= 0")
    return sorted(tuple(r) for r in found.collect())


def test_arrival_in_any_order(spark, tmp_path):
    rows = calls(1)
    shuffled = random.Random(2).sample(rows, len(rows))
    again = shuffled[: len(rows) // 3]  # some come twice
    parts = [shuffled[k::5] for k in range(5)] + [again]
    assert live(spark, tmp_path, parts, first=0) == batch(spark, rows)


def test_history_goes_on(spark, tmp_path):
    rows = calls(3)
    old = [r for r in rows if r[1] < 3]
    later = random.Random(4).sample([r for r in rows if r[1] >= 3], len(rows) - len(old))
    fired = {d for d, *_ in batch(spark, old)}
    got = live(spark, tmp_path, [later[0::2], later[1::2]], first=0, history=spark.createDataFrame(old, SCHEMA))
    assert got == [r for r in batch(spark, rows) if r[0] not in fired]


def test_a_reset_begins_a_new_conversation(spark, tmp_path):
    first, second = [CALM, SAD, SAD, SAD, STRONG], [SAD, CALM, CALM, CALM, STRONG]
    rows = [(1, u, p, u == 5) for u, p in enumerate(first + second)]
    got = live(spark, tmp_path, [rows[7:], rows[2:7], rows[:2]], first=0, reset="fresh")
    assert got == [(1, 2, "sustained_negative_trend"), (1, 4, "instant_strong_emotion")]


class Store:
    """State and timers of one key, in memory."""

    def __init__(self):
        self.value, self.map, self.timers = None, {}, []

    def getValueState(self, *_):
        store = self
        return type("Value", (), {"exists": lambda s: store.value is not None, "get": lambda s: store.value, "update": lambda s, v: setattr(store, "value", v), "clear": lambda s: setattr(store, "value", None)})()

    def getMapState(self, *_):
        m = self.map
        return type("Map", (), {"exists": lambda s: bool(m), "containsKey": lambda s, k: k in m, "getValue": lambda s, k: m[k], "updateValue": lambda s, k, v: m.__setitem__(k, v), "removeKey": lambda s, k: m.pop(k), "keys": lambda s: iter(list(m)), "clear": lambda s: m.clear()})()

    listTimers = lambda self: list(self.timers)
    deleteTimer = lambda self, t: self.timers.remove(t)
    registerTimer = lambda self, t: self.timers.append(t)


def test_gaps_are_not_waited_for_without_end():
    import pandas as pd

    store = Store()
    calm, strong = (0.0, 0.0, False), (0.9, 0.9, False)
    clock = lambda now: type("Clock", (), {"getCurrentProcessingTimeInMs": lambda s: now})()
    expired = lambda at: type("Expired", (), {"getExpiryTimeInMs": lambda s: at})()
    processor = FirstTrigger(0.6, 3, 0, gap_ms=100, idle_ms=1000)
    processor.init(store)
    frame = lambda *rows: iter([pd.DataFrame([(u, *v) for u, v in rows], columns=["utterance_id", "instant", "negative", "reset"])])
    assert next(processor.handleInputRows((7,), frame((3, strong), (0, calm)), clock(0))).empty  # 1 and 2 are missing
    assert sorted(store.timers) == [100, 1000]
    out = next(processor.handleExpiredTimer((7,), clock(100), expired(100)))
    assert out.values.tolist() == [[7, 1, "instant_strong_emotion"]] and not store.map
    assert store.timers == [1100]
    assert next(processor.handleInputRows((7,), frame((2, strong)), clock(200))).empty  # too late
    assert next(processor.handleExpiredTimer((7,), clock(1200), expired(1200))).empty and store.value is None


def test_a_batch_that_comes_again_doubles_nothing(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(source)
    seen = []

    def work(frame):
        seen.append(frame.count())
        if len(seen) == 2:
            return frame.select(F.when(F.col("id") >= 0, F.raise_error(F.lit("killed"))).cast("bigint").alias("id"))
        return frame

    with pytest.raises(Exception, match="killed"):
        io.append_stream(stream, out, str(tmp_path / "state"), work).awaitTermination()
    io.append_done(spark.range(10, 15), out, f"{1:012d}")  # written, but not acknowledged
    io.append_stream(stream, out, str(tmp_path / "state"), work).awaitTermination()
    done = io.read_done(spark, out, "id bigint")
    assert sorted(r["id"] for r in done.collect()) == list(range(30)) and len(seen) == 4
    assert io.pending(spark.range(35), done, "id").count() == 5
    assert io.read_done(spark, str(tmp_path / "none"), "id bigint").count() == 0


def test_a_split_is_many_files(spark, tmp_path):
    kept = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        rows = spark.range(0, 160_000, numPartitions=16).select("id", F.when(F.col("id") % 10 < 8, "train").when(F.col("id") % 10 == 8, "val").otherwise("test").alias("split"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
        io.write_features(rows, str(tmp_path / "f"), rows_per_file=30_000)
        files = {s: len(list((tmp_path / "f" / f"split={s}").glob("*.parquet"))) for s in ("train", "val", "test")}
        assert files["train"] >= 6 and 1 <= files["val"] <= 3 and files["train"] >= 2 * files["val"], files
        assert spark.read.parquet(str(tmp_path / "f")).groupBy("split").count().where("split = 'train'").first()["count"] == 128_000
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", kept)


def test_bucketed_tables_join_without_a_shuffle(spark, sf_dir):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = bucketed_features(spark, sf_dir)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan
        assert made.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_batches_hold_bounded_characters(spark):
    assert projection.batch_cuts([3, 3, 3, 50, 1, 1, 1, 1], 3, 6) == [(0, 2), (2, 3), (3, 4), (4, 7), (7, 8)]
    texts = ["x" * n for n in (10, 900, 5, 5, 2000, 1)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)

    def sizes():
        return lambda part: __import__("pandas").DataFrame({"chars": part.str.len().fillna(0).astype(int), "held": [int(part.str.len().fillna(0).sum())] * len(part)})

    rows = projection.score_table(df, sizes, "chars bigint, held bigint", batch_chars=1000).collect()
    assert sorted((r["id"], r["chars"]) for r in rows) == [(k, len(t or "")) for k, t in enumerate(texts)]
    assert all(r["held"] <= 1000 or r["held"] == r["chars"] for r in rows)


def test_scoring_has_a_profile_of_its_own(spark):
    from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests

    profile = ResourceProfileBuilder().require(TaskResourceRequests().cpus(2)).build
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    scored = projection.score_table(df, lambda: lambda t: t.str.len().to_frame("n"), "n bigint", profile=profile)
    held = scored._jdf.queryExecution().optimizedPlan().profile()
    assert held.isDefined() and held.get().taskResources().apply("cpus").amount() == 2.0


def test_alignment_counts_rows_in_one_pass(spark):
    a = spark.createDataFrame([("train_1", "t", "anger"), ("val_2", "u", None)], "audio_id string, text string, true_label string")
    preds = spark.createDataFrame([("train_1", *[0.2] * 5)], "audio_id string, prob_anger double, prob_frust double, prob_sadne double, prob_neutr double, prob_satis double")
    with pytest.raises(ValueError, match="val"):
        features.attach_text_model(a, preds)
