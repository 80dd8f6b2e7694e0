import math
from collections import Counter

import numpy as np
import pytest
from cases import no_documents, odd_documents
from pyspark.sql import functions as F

from callweave.llm import license_scan, lm_scoring, queries


def slow_models(texts):
    """For each order, how often a byte follows a context of so many bytes."""
    counts = [{} for _ in range(4)]
    for text in texts:
        data = lm_scoring.START + text
        for i in range(3, len(data)):
            for k in range(4):
                followers = counts[k].setdefault(data[i - k : i], Counter())
                followers[data[i]] += 1
    return counts


def slow_probability(counts, before, byte):
    p = 1 / 256
    for k, order in enumerate(counts):
        followers = order.get(before[len(before) - k :], Counter())
        weight = 256 if k == 0 else lm_scoring.SMOOTHING
        p = (followers[byte] + weight * p) / (sum(followers.values()) + weight)
    return p


def slow_loss(text, counts):
    data = lm_scoring.START + text
    return sum(-math.log2(slow_probability(counts, data[i - 3 : i], data[i])) for i in range(3, len(data))) / max(len(text), 1)


def test_probabilities_after_a_context_add_up_to_one(spark):
    texts = [(r["text"] or "").encode() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(40).collect()]
    quads, counts = lm_scoring.count_quads(texts[:15], texts[15:])
    keys, sums = lm_scoring.count_keys(quads, counts)
    ends = {t[-3:] for t in texts if len(t) > 3}
    contexts = [lm_scoring.START, *sorted(ends)[:20], b"the", b"ing", texts[3][10:13]]
    for context in contexts:
        every = np.frombuffer(b"".join(bytes([b, *context[::-1]]) for b in range(256)), "<u4")
        # Keys that no text has count 0.
        missing = np.setdiff1d(np.concatenate(lm_scoring.orders(every)), keys)
        known, held = lm_scoring.add_up([keys, missing], [sums, np.zeros((2, len(missing)), np.int64)])
        probabilities = 2.0 ** -lm_scoring.quad_bits(every, known, held)
        assert probabilities.sum(1) == pytest.approx([1, 1], abs=1e-9)


def test_losses_equal_brute_force(spark, monkeypatch):
    texts = ["the cat sat on the mat", "", None, "über größe", "the the the", "zzz 123", "the cat sat on the mat"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens string")
    labels = spark.createDataFrame([(0, 1), (0, 1), (3, 1), (5, 0), (1, 1)], "doc_id bigint, quality int")
    data = [(t or "").encode() for t in texts]
    models = slow_models([data[0], data[3]]), slow_models(data)
    for r in lm_scoring.score_by_labels(df, labels).collect():
        want = [slow_loss(data[r["doc_id"]], m) for m in models] if data[r["doc_id"]] else [0.0, 0.0]
        assert (r["loss_target"], r["loss_background"], r["loss_difference"]) == pytest.approx((*want, want[0] - want[1]), rel=1e-9)
        assert r["n_tokens"] == len(data[r["doc_id"]])


def test_losses_are_exact_where_hash_buckets_would_be_shared(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 30000)
    letters = np.frombuffer(bytes(range(33, 127)), np.uint8)
    texts = [bytes(np.random.default_rng(k).choice(letters, 4000)) for k in range(30)]
    df = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id bigint, text string")
    found = lm_scoring.score_by_labels(df, df.where("doc_id < 9").select("doc_id", F.lit(1).alias("quality"))).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(30))
    for name, models in (("loss_target", slow_models(texts[:9])), ("loss_background", slow_models(texts))):
        assert all(r[name] == pytest.approx(slow_loss(texts[r["doc_id"]], models), rel=1e-9) for r in found)


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = bytes(np.random.default_rng(0).integers(97, 110, 5000).astype(np.uint8))
    whole = [np.concatenate(x) for x in zip(*lm_scoring.ngrams([text, b"abc"]))]
    monkeypatch.setattr(lm_scoring, "AT_ONCE", 37)
    pieces = [np.concatenate(x) for x in zip(*lm_scoring.ngrams([text, b"abc"]))]
    assert all(np.array_equal(a, b) for a, b in zip(whole, pieces))


def test_target_like_text_has_the_lower_difference(spark):
    rows = [(i, "good clean prose about rivers and hills " * 5) for i in range(20)] + [(100 + i, "XX$$ 99 %%%% ## QQ !! " * 8) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = df.where("doc_id < 10").select("doc_id", F.lit(1).alias("quality"))
    found = {r["doc_id"]: r["loss_difference"] for r in lm_scoring.score_by_labels(df, labels).collect()}
    assert max(v for k, v in found.items() if k < 100) < min(v for k, v in found.items() if k >= 100)


def test_odd_documents_are_scored_and_scanned(spark):
    docs, labels = odd_documents(spark), spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    for known in (labels, labels.limit(0)):
        rows = lm_scoring.score_by_labels(docs, known).collect()
        assert len(rows) == 10 and all(math.isfinite(r["loss_difference"]) for r in rows)
    assert lm_scoring.score_by_labels(no_documents(spark), labels).count() == 0
    assert license_scan.scan_licenses(docs).where("license IS NOT NULL").count() == 0 and license_scan.scan_licenses(docs).count() == 10
    assert license_scan.scan_licenses(no_documents(spark)).count() == 0


def test_scans_equal_brute_force(spark):
    texts = ["Released under the MIT license", "x y. RELEASED UNDER THE MIT LICENSE!! more", "licensed under cc by-nc 4.0", "Licensed under CC BY 4.0 and more", "the license", "", "This work is licensed under the GNU General Public License, version 3. The end", "this work is licensed under a General Public License version 3"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: (r["license"], r["dice"]) for r in license_scan.scan_licenses(df).collect()}
    for i, text in enumerate(texts):
        want = every_stretch(text.encode(), license_scan.TEMPLATES)
        assert found[i][0] == (want and license_scan.TEMPLATES[want[1]][0]) and found[i][1] == pytest.approx(want[0] if want else 0.0), text


def every_stretch(text, templates, threshold=0.8):
    """The best stretch over all starts, also those that the text's beginning cuts."""
    words, best = license_scan.normal_words(text), None
    for t, (_, template) in enumerate(templates):
        x = license_scan.normal_words(template.encode())
        bag = Counter(zip(x, x[1:]))
        if bag.keys().isdisjoint(zip(words, words[1:])):
            continue
        for start in range(2 - len(x), len(words)):
            part = words[max(start, 0) : start + len(x)]
            found = license_scan.dice(Counter(zip(part, part[1:])), bag)
            key = (-found, -len(x), t, max(start, 0))
            if found >= threshold and (best is None or key < best):
                best = key
    return best and (-best[0], best[2], best[3])


def test_reordered_and_scattered_edits_equal_brute_force():
    text = b"Some words go before. No part may be reproduced without written permission. All rights reserved. And some go after."
    assert license_scan.Scanner(license_scan.TEMPLATES).scan(text) == every_stretch(text, license_scan.TEMPLATES)
    assert license_scan.Scanner(license_scan.TEMPLATES).scan(text)[0] == pytest.approx(0.9)
    rng = np.random.default_rng(3)
    long = [f"w{k}" for k in rng.integers(0, 80, 101)]
    templates = [*license_scan.TEMPLATES, ("long", " ".join(long))]
    scanner, matches = license_scan.Scanner(templates), 0
    for case in range(150):
        words = templates[rng.integers(len(templates))][1].split()
        edits = rng.integers(0, max(2, len(words) // 8))
        if case % 3 == 0:  # reordered
            at = rng.integers(1, len(words))
            words = words[at:] + words[:at]
        for k in sorted(rng.integers(0, len(words), edits), reverse=True):  # scattered
            words[k : k + int(rng.integers(0, 2))] = ["other"] * int(rng.integers(0, 2))
        around = [["the", "license", "under", "x"][k] for k in rng.integers(0, 4, 30)]
        text = " ".join([*around[: rng.integers(0, 15)], *words, *around[15 : rng.integers(15, 30)], *words[: rng.integers(0, 9)]]).encode()
        found = scanner.scan(text)
        assert found == every_stretch(text, templates), text
        matches += found is not None
    assert matches > 50
    inserted = [w for k, x in enumerate(long) for w in ([x, "new"] if k % 10 == 5 else [x])]
    text = " ".join(inserted).encode()
    assert scanner.scan(text) == every_stretch(text, templates) and scanner.scan(text)[0] >= 0.8


def test_whole_licences_are_found_and_edited_notices_equal_brute_force():
    scanner, rng, matches = license_scan.Scanner(license_scan.TEMPLATES), np.random.default_rng(8), 0
    for name, template in license_scan.TEMPLATES:
        dice, t, start = scanner.scan(f"a file begins here\n\n{template}\n\nand then goes on".encode())
        assert (dice, license_scan.TEMPLATES[t], start) == (1.0, (name, template), 4)
    short = [x for _, x in license_scan.TEMPLATES if len(x.split()) < 20]
    fill = "this our work is licensed under the public version of a license and post".split()
    for _ in range(2000):
        words = short[rng.integers(len(short))].split()
        for _ in range(rng.integers(0, 4)):
            at, word = rng.integers(len(words) + 1), fill[rng.integers(len(fill))]
            words = words[:at] + [word] * int(rng.integers(0, 2)) + words[at + int(rng.integers(0, 2)) :]
        text = " ".join([*rng.choice(fill, rng.integers(0, 6)), *words, *rng.choice(fill, rng.integers(0, 6))]).encode()
        found = scanner.scan(text)
        assert found == every_stretch(text, license_scan.TEMPLATES), text
        matches += found is not None
    assert matches > 1000


def test_many_templates_are_scanned_in_parts(spark, monkeypatch):
    texts = [t for _, t in license_scan.TEMPLATES] + ["nothing here", None]
    df = spark.createDataFrame(list(enumerate(texts)), "license bigint, dice string").select(F.col("license").alias("doc_id"), F.col("dice").alias("text"))
    whole = sorted(map(tuple, license_scan.scan_licenses(df).collect()))
    monkeypatch.setattr(license_scan, "MAX_TEMPLATES", 4)
    assert sorted(map(tuple, license_scan.scan_licenses(df).collect())) == whole


def test_license_query_equals_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op9_license_scan(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = every_stretch((texts[r["doc_id"]] or "").encode(), license_scan.TEMPLATES)
        assert (r["license"], r["first_word"]) == ((license_scan.TEMPLATES[want[1]][0], want[2]) if want else (None, None))
        assert r["dice"] == pytest.approx(want[0] if want else 0.0, abs=1e-6)


def test_scoring_query_equals_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    target, background = slow_models([t for i, t in texts.items() if i in good]), slow_models(texts.values())
    rows = queries.op4_lm_scoring(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["n_tokens"] == len(text)
        if len(text) < 3000:
            assert (r["loss_target"], r["loss_background"]) == pytest.approx((slow_loss(text, target), slow_loss(text, background)), abs=1e-6)
            assert r["loss_difference"] == pytest.approx(r["loss_target"] - r["loss_background"], abs=2e-6)


def test_equal_texts_are_one_with_and_without_ids(spark):
    """A text of 10^5 rows goes to one block once, and weighs as often as it occurs."""
    hot = "the same text again and again"
    rows = spark.range(100_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.lit(hot).alias("text"))
    few = spark.createDataFrame([(200_001, "another text"), (200_003, hot + "!")], "doc_id bigint, text string")
    labels = spark.range(0, 1000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    found = lm_scoring.score_by_labels(rows.unionByName(few), labels)
    held = found.groupBy("loss_target", "loss_background", "n_tokens").count().collect()
    assert sorted(r["count"] for r in held) == [1, 1, 100_000]
    rows_of = lambda text, n: [text.encode()] * n
    models = slow_models(rows_of(hot, 500)), slow_models(rows_of(hot, 2000) + rows_of("another text", 1))
    one = next(r for r in held if r["count"] == 100_000)
    assert one["loss_target"] == pytest.approx(slow_loss(hot.encode(), models[0]), rel=1e-9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan  # nothing but the join is left to do: the blocks are written
