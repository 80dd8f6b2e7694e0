import math
import zlib

import numpy as np
import pytest
from cases import no_documents, odd_documents
from pyspark.sql import functions as F

from callweave.llm import lang_id, quality_mil, queries


def test_recurrent_gradients_equal_differences():
    random = np.random.default_rng(0)
    model = {k: v.astype(np.float64) for k, v in lang_id.start_values(3, 4).items()}
    bytes_in = random.integers(0, 256, (7, 5)).astype(np.intp)
    bytes_in[5:, 2] = lang_id.PAD
    valid = (bytes_in != lang_id.PAD)[:, :, None].astype(np.float32)
    labels = np.array([0, 1, 2, 1, 0])
    _, grads = lang_id.gradients(model, bytes_in, valid, labels)
    for name in model:
        at = tuple(random.integers(0, n) for n in model[name].shape)
        at = (at[0], int(bytes_in[1, 1]), at[2]) if name[0] == "x" else at
        kept, losses = model[name][at], []
        for step in (1e-3, -1e-3):
            model[name][at] = kept + step
            losses.append(lang_id.gradients(model, bytes_in, valid, labels)[0])
        model[name][at] = kept
        assert grads[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-3, abs=2e-4)


def test_attention_gradients_equal_differences():
    random = np.random.default_rng(0)
    model = quality_mil.start_values()
    model["e"] = model["e"] * 3
    features, counts, labels = random.normal(size=(6, quality_mil.FEATURES)), np.array([2, 1, 3]), np.array([1.0, 0.0, 1.0], np.float32)
    model = {k: v.astype(np.float64) for k, v in model.items()}

    def loss():
        p = quality_mil.forward(model, features, counts)[0]
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    grads = quality_mil.gradients(model, features, counts, labels)
    for name in model:
        at = tuple(random.integers(0, n) for n in model[name].shape)
        kept, losses = model[name][at], []
        for step in (1e-4, -1e-4):
            model[name][at] = kept + step
            losses.append(loss())
        model[name][at] = kept
        assert grads[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-4, rel=1e-2, abs=1e-5)


def test_scores_of_a_text_do_not_depend_on_its_batch():
    model = lang_id.start_values(3)
    texts = [b"a", b"some text " * 40, "é".encode() * 64, b"x" * 64]
    together = lang_id.document_probabilities(model, texts)
    assert np.allclose(together, [lang_id.document_probabilities(model, [t])[0] for t in texts], atol=1e-5)
    features, counts = quality_mil.passages([b"", b"one two two", b"y" * 2000])
    assert list(counts) == [1, 1, 4]
    for k, text in enumerate((b"", b"one two two", b"y" * 2000)):
        assert np.allclose(features[counts[:k].sum() : counts[: k + 1].sum()], quality_mil.passages([text])[0])


def test_language_query(spark, sf_dir):
    held = "/root/testdata/sf0.01"
    rows = queries.op7_language_id(spark, held).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{held}/documents.parquet").collect()}
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    tested = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(tested) / len(tested) >= 0.97


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(lang_id, "EPOCHS", 1)
    rows = [(100 * k + i, chr(0x4E00 + 20 * k) * 30, f"l{k:03d}") for k in range(90) for i in range(1 + k % 7)] + [(-1, "no language", None), (-2, None, "no text")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    want = [f"l{k:03d}" for k in range(90)]
    assert lang_id.learn(docs)[0] == want
    monkeypatch.setattr(lang_id, "SAMPLE_DOCS", 20)
    monkeypatch.setattr(lang_id, "LANG_DOCS", 0)
    assert {lang for lang, _ in lang_id.sample(docs, "doc_id", "text", "lang")} == set(want)
    model = lang_id.start_values(90)
    texts = [b"some text " * 40, b"a", b"x" * 64]
    assert np.allclose(lang_id.document_probabilities(model, texts).sum(1), 1, atol=1e-4)


def test_quality_query(spark, sf_dir):
    held = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.op3_quality_classifier(spark, held).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{held}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in rows.items())
    tested = [rows[i]["predicted"] == y for i, y in labels.items() if rows[i]["held_out"]]
    assert sum(tested) / len(tested) >= 0.95


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = lang_id.predict_languages(docs).collect()
    assert len(rows) == 10 and all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (2, 3, 5))
    assert lang_id.predict_languages(no_documents(spark)).count() == 0
    assert all(r["lang_pred"] == "und" for r in lang_id.predict_languages(docs.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")).collect())
    assert lang_id.filter_languages(docs).columns == docs.columns
    labels = spark.createDataFrame([(1, 1), (7, 0), (7, None), (8, 5)], "doc_id bigint, quality int")
    for known in (labels, labels.limit(0)):
        found = quality_mil.score_quality(docs, known).collect()
        assert len(found) == 10 and all(0 <= r["score"] <= 1 for r in found)
    assert quality_mil.score_quality(no_documents(spark), labels).count() == 0


def slow_language(model, text):
    """Mean probabilities over all bytes, one byte of one window at a time."""
    soft = lambda x: x / (1 + np.abs(x))
    total = 0
    for at in range(0, len(text), lang_id.WINDOW):
        window, states = text[at : at + lang_id.WINDOW], {}
        for side, order in (("f", range(len(window))), ("b", range(len(window) - 1, -1, -1))):
            rows, turn, state = model["x" + side].astype(float), model["u" + side].astype(float), np.zeros(lang_id.HIDDEN)
            for t in order:
                keep, reset = (0.5 + 0.5 * soft(rows[k, window[t]] + state @ turn[k]) for k in (0, 1))
                fresh = soft(rows[2, window[t]] + reset * (state @ turn[2]))
                state = keep * state + (1 - keep) * fresh
                states[side, t] = state
        for t in range(len(window)):
            logits = model["vf"] @ states["f", t] + model["vb"] @ states["b", t] + model["c"][:, 0]
            total = total + np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
    return total / len(text)


def test_language_query_equals_a_slow_forward_pass(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs, model = lang_id.learn(docs.where(~lang_id.held_out("doc_id")))
    texts, compared = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}, 0
    for r in queries.op7_language_id(spark, sf_dir).collect():
        text = texts[r["doc_id"]]
        if not any(c.isalpha() for c in text.decode()):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif len(text) < 1500:
            want = slow_language(model, text)
            assert r["score"] == pytest.approx(want.max(), abs=1e-4) and want[langs.index(r["lang_pred"])] == pytest.approx(want.max(), abs=1e-4)
            compared += 1
    assert compared > 40


def slow_quality(model, text):
    """The score of a text, one passage at a time."""
    data, size = text + b"\n", quality_mil.PASSAGE
    kind = [int(k) for k in quality_mil.class_table()[list(data)]]
    words, begin = [], None
    for k in range(len(data)):
        if kind[k] > 2 and begin is None:
            begin = k
        if kind[k] <= 2 and begin is not None:
            words.append((begin, data[begin:k]))
            begin = None
    codes, weights = [], []
    for at in range(0, len(data), size):
        n, row = len(data[at : at + size]), np.zeros(quality_mil.FEATURES)
        for k in range(at, at + n):
            row[kind[k] * quality_mil.N + (kind[k + 1] if k + 1 < len(data) else 1)] += 1 / n
        row[: quality_mil.N**2] **= 0.5
        own = [k for k, (b, _) in enumerate(words) if at <= b < at + n]
        some = max(1, len(own))
        for lag in (1, 2, 3):
            row[quality_mil.N**2 + lag - 1] = sum(k >= lag and words[k][1] == words[k - lag][1] for k in own) / some
        row[quality_mil.N**2 + 3 :] = len({words[k][1] for k in own}) / some, sum(len(words[k][1]) for k in own) / some / 10, math.log1p(len(own)) / 5
        code = np.tanh(((row - model["mean"]) / model["spread"]) @ model["e"] + model["d"])
        codes.append(code)
        weights.append((np.tanh(code @ model["v"]) / (1 + np.exp(-(code @ model["u"])))) @ model["w"])
    attention = np.exp(np.array(weights) - max(weights))
    bag = (attention / attention.sum()) @ np.array(codes)
    return 1 / (1 + math.exp(-(bag @ model["o"] + model["b"][0])))


def test_quality_query_equals_a_slow_forward_pass(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model, texts = quality_mil.learn(docs, labels), {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    rows = queries.op3_quality_classifier(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if len(texts[r["doc_id"]]) < 6000:
            assert r["score"] == pytest.approx(slow_quality(model, texts[r["doc_id"]]), abs=1e-3)


def test_an_id_that_repeats_does_not_fill_the_samples(spark):
    rng = np.random.default_rng(3)
    clean = lambda: " ".join(rng.choice(["river", "hill", "morning", "walked", "slowly", "over", "the"], 40))
    junk = lambda: " ".join(rng.choice(["$$", "##", "|>", "99", "%%*"], 40))
    learned = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 and zlib.crc32(str(i).encode()) % 3 != 1][:12]
    rows = [(i, clean() if k % 2 else junk(), "en" if k % 2 else "xx") for k, i in enumerate(learned)]
    docs = spark.createDataFrame(rows + [(learned[0], rows[0][1], "xx")] * 7000, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(learned)], "doc_id bigint, quality int")
    scores = {r["doc_id"]: r["score"] for r in quality_mil.score_quality(docs, labels).where("doc_id <> %d" % learned[0]).collect()}
    assert min(scores[i] for i in learned[1::2]) > 0.5 > max(scores[i] for i in learned[2::2])
    many = docs.unionByName(spark.range(1000, 1200).select(F.col("id").alias("doc_id"), F.lit("some text of a language").alias("text"), F.lit("xx").alias("lang")))
    drawn = [lang for lang, _ in lang_id.sample(many, "doc_id", "text", "lang")]
    assert drawn.count("xx") == 200 + 6 and drawn.count("en") == 6


def test_labels_of_absent_documents_do_not_use_up_the_sample(spark):
    texts = [("good words of a calm and even tale " * 6, 1), ("$$$ ### click click click $$$ " * 8, 0)]
    docs = spark.createDataFrame([(i, f"{texts[i % 2][0]} {i}") for i in range(400)], "doc_id bigint, text string")
    own = spark.range(400).select(F.col("id").alias("doc_id"), (1 - F.col("id") % 2).cast("int").alias("quality"))
    foreign = spark.range(10**6, 10**6 + 400_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("quality"))
    scored = quality_mil.score_quality(docs, own.unionByName(foreign)).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 2 == 0) for r in scored)
    # An id with both labels counts as 1.
    both = own.unionByName(own.withColumn("quality", F.lit(0)))
    assert all(r["y"] == 1 - r["s_id"] % 2 for r in both.groupBy(F.col("doc_id").alias("s_id")).agg(F.max("quality").alias("y")).collect())
    again = quality_mil.score_quality(docs, both).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 2 == 0) for r in again)
