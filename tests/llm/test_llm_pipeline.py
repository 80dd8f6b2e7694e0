import corpus_pipeline
from test_llm_quality_rules import slow_verdicts
from test_llm_simhash import slow_components, slow_fingerprint

from callweave.llm import lang_id


def test_stages_equal_their_operators(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if name != "byte_bpe":
            assert after.columns == columns
            assert all(texts[r["doc_id"]] == r["text"] for r in after.collect())
        else:
            assert after.count() == docs.count()
        docs = after


def test_run_equals_its_stages(spark, sf_dir):
    """run's rows against stages judged one by one: by the network, plain lists, all pairs, and the mix's own counts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    of = {name: f for name, f in corpus_pipeline.STAGES}
    predicted = {r["doc_id"]: r for r in lang_id.predict_languages(docs).collect()}
    rows = [r for r in docs.collect() if predicted[r["doc_id"]]["lang_pred"] != "und" and predicted[r["doc_id"]]["score"] >= 0.3]
    rows = [r for r, (_, _, kept) in zip(rows, slow_verdicts([(r["lang"], r["source"], r["text"]) for r in rows])) if kept]
    label, least = slow_components([slow_fingerprint(r["text"]) for r in rows]), {}
    for r, c in zip(rows, label):
        least[c] = min(r["doc_id"], least.get(c, r["doc_id"]))
    rows = [r for r, c in zip(rows, label) if r["doc_id"] == least[c]]
    mixed = of["source_mix"](spark, spark.createDataFrame(rows, docs.schema), sf_dir)
    own = spark.createDataFrame([(r["doc_id"], r["text"]) for r in mixed.collect()], "doc_id bigint, text string")
    want = of["byte_bpe"](spark, own, sf_dir)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, want.collect()))


def test_language_stage_drops_what_has_no_language(spark):
    rows = [(i, "the sun is out and the birds sing in the old trees", "en") for i in range(20)] + [(100, "12345 --- 999", None), (101, None, "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r["doc_id"] for r in lang_id.filter_languages(df).collect()} == set(range(20))
