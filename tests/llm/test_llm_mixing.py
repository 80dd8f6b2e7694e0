import re

import pytest
from cases import no_documents, odd_documents
from pyspark.sql import functions as F

from callweave.llm import queries
from callweave.llm.mixing import PHI, POINT_BITS, mix_counts, mixed, point, take_documents


def slow_targets(sizes, weights, share, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, total = {}, set(), share * sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / open_weight for s in names}
        above = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


def check(docs, rows):
    sizes, source = {}, {}
    for r in docs.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
        source[r["doc_id"]] = (r["source"], n)
    targets = slow_targets(sizes, [3, 1, 2], 1.5, 2)
    taken = {}
    for r in rows:
        s, n = source[r["doc_id"]]
        assert r["size"] == n and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(targets[s])
        assert 0 <= r["taken"] <= 2 * n
        taken[s] = taken.get(s, 0) + r["taken"]
    for s, t in targets.items():
        assert abs(taken.get(s, 0) - t) <= 5 * 64, s


def test_query_equals_brute_force(spark, sf_dir):
    rows = queries.op5_source_mix(spark, sf_dir).collect()
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"), rows)
    again = queries.op5_source_mix(spark, sf_dir).repartition(5).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_hot_source_and_null_source(spark):
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"))
    check(df, mix_counts(df, [3, 1, 2]).collect())


def test_every_stretch_of_the_schedule_holds_the_shares(spark):
    df = spark.range(600).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 200).alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    sources, _, slots = mixed(df, [3, 1, 2], share=1.0)
    share = {r["m_key"]: r["target"] / r["total"] for r in sources.collect()}
    order = [r["m_key"] for r in slots.orderBy("slot").collect()]
    for start in range(0, len(order) - 100, 37):
        for key, part in share.items():
            assert abs(order[start : start + 100].count(key) - 100 * part) <= 4
    ranks = slots.groupBy("m_key").agg(F.min("rank").alias("lo"), (F.max("rank") + 1 - F.count_distinct("rank")).alias("gap")).collect()
    assert all(r["lo"] == 0 and r["gap"] == 0 for r in ranks)


def test_odd_documents(spark):
    rows = mix_counts(odd_documents(spark), [3, 1, 2]).collect()
    assert len(rows) == 10 and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mix_counts(no_documents(spark), [3, 1, 2]).count() == 0
    out = take_documents(odd_documents(spark), [3, 1, 2])
    assert out.columns == odd_documents(spark).columns and out.where("text IS NULL").count() == 0


def test_rows_without_an_id_of_their_own_are_taken(spark):
    ids = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 5).otherwise(F.col("id")).cast("bigint")
    df = spark.range(900).select(ids.alias("doc_id"), F.concat_ws(" ", F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")), "id").alias("text"), (F.col("id") % 3).cast("string").alias("source"), F.col("id").alias("row"))
    target = {r["m_source"]: r["target"] for r in mixed(df, [3, 1, 2])[0].collect()}
    out = take_documents(df, [3, 1, 2])
    assert out.columns == df.columns and out.groupBy("row").count().agg(F.max("count")).first()[0] <= 2
    taken = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(F.col("row") % 50 + 1).alias("n")).collect()}
    for source, wanted in target.items():
        assert abs(taken[source] - wanted) <= 0.1 * wanted, source


def test_points_stay_distinct_far_out(spark):
    far = spark.range(10**11, 10**11 + 200_000).select(point(F.col("id")).alias("p"))
    assert far.distinct().count() == 200_000
    some = [0, 1, 2, 10**6, 10**11, 10**15, 2**61]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in some], "i bigint").select(point(F.col("i"))).collect()]
    assert got == [(i + 1) * PHI % (1 << POINT_BITS) for i in some]
    cells = spark.range(10**11, 10**11 + 6400).groupBy(F.shiftright(point(F.col("id")), POINT_BITS - 6).alias("cell")).count().collect()
    assert len(cells) == 64 and all(98 <= r["count"] <= 102 for r in cells)  # low discrepancy there too


def test_many_sources_keep_their_share(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 * 800).cast("int")).alias("text"), (F.col("id") % 1500).cast("string").alias("source"))
    rows = mix_counts(docs, [3, 1, 2]).groupBy("size", "source_size", "target").agg(F.max("taken").alias("most"))
    assert rows.where("most > 2 * size").count() == 0
    whole = mix_counts(docs, [3, 1, 2]).agg(F.sum("taken"), F.sum("size")).first()
    assert abs(whole[0] - 1.5 * whole[1]) < 0.05 * whole[1]
