"""Spelling variants against brute force, and the search in tries against all pairs."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import no_documents, odd_documents
from hypothesis import given, settings
from hypothesis import strategies as st

from callweave.llm import spelling
from callweave.llm.spelling import last_forms, near_in_block, near_words, spelling_variants, steps, top_levels, trie_pairs

LETTERS = ["aeé", "bc", "dfß", ""]


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = sorted((a, b), key=len)
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def slow(rows, slip=199, least=5, ratio=5):
    counts = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if n >= least and len(w) >= 6}
    by = defaultdict(list)
    for w in words:
        by[len(w)].append(w)
    near = {w: sorted((x for k in (-1, 0, 1) for x in by[len(w) + k] if one_edit(w, x)), key=lambda x: (-words[x], x)) for w in words}
    form = {w: near[w][0] if near[w] and words[near[w][0]] >= ratio * n else None for w, n in words.items()}
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], words.get(form[w]), root))
    return sorted(out)


def result(df):
    return sorted((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect())


def test_documents_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert result(spelling_variants(docs)) == slow(rows)
    assert result(spelling_variants(docs, slip=7, ratio=2)) == slow(rows, 7, 5, 2)  # many forms, long chains


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert result(spelling_variants(docs)) == slow(rows)
    assert result(spelling_variants(no_documents(spark))) == []
    long = spark.createDataFrame([(k, ("Ü" + "x" * 30000 + " ") * 3 + ("Ü" + "x" * 29999 + " ") * 30) for k in range(2)], "doc_id bigint, text string")
    found = spelling_variants(long, slip=1 << 31).collect()
    assert sorted((len(r["word"]), r["n"], r["n_near"], r["form_n"]) for r in found) == [(30000, 60, 1, None), (30001, 6, 1, 60)]


def test_small_parts_lose_no_word(spark, monkeypatch):
    random = np.random.default_rng(2)
    words = sorted({"".join(random.choice(list("abcd"), random.integers(6, 9))) for _ in range(900)})
    df = spark.createDataFrame([(w, int(random.integers(5, 99))) for w in words], "word string, n bigint")
    want = sorted((w, sum(one_edit(w, x) for x in words)) for w in words)
    for letters, asked, most in ((1 << 17, 1 << 19, 8192), (200, 300, 2)):  # whole sub-tries; cut into parts, with more top levels
        monkeypatch.setattr(spelling, "BLOCK_LETTERS", letters)
        monkeypatch.setattr(spelling, "QUERY_LETTERS", asked)
        monkeypatch.setattr(spelling, "SUBTRIE", most)
        got = {r["word"]: r["n_near"] for r in near_words(df).collect()}
        assert [(w, got.get(w, 0)) for w in words] == want


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("aébcdfß", min_size=1, max_size=6), min_size=1, max_size=60))
def test_search_in_a_block_equals_all_pairs(words):
    words = sorted(words)
    own = pa.table({"near": words, "n": pa.array(range(1, len(words) + 1), pa.int64())})
    got = {r["word"]: r for r in near_in_block(own, pa.table({"word": words}), LETTERS).to_pylist()}
    for w in words:
        near = [x for x in words if one_edit(w, x)]
        assert (w in got) == bool(near)
        if near:
            best = max(near, key=words.index)
            assert (got[w]["n_near"], got[w]["form"], got[w]["form_n"]) == (len(near), best, words.index(best) + 1)


@pytest.mark.parametrize("leaf", [1, 24])
def test_trie_keeps_the_budget(monkeypatch, leaf):
    monkeypatch.setattr(spelling, "LEAF", leaf)
    random = np.random.default_rng(3)
    own = random.integers(0, 4, (200, 5)).astype(np.int32)
    own = own[np.lexsort(own.T[::-1])]
    asked = random.integers(0, 4, (90, 5)).astype(np.int32)
    got = sorted((int(a), int(b)) for q, j in trie_pairs(own, asked) for a, b in zip(q, j))
    change = own[None] - asked[:, None]
    fits = (np.maximum(change, 0).sum(2) <= 1) & (np.maximum(-change, 0).sum(2) <= 1)
    assert got == [tuple(x) for x in np.argwhere(fits).tolist()]


def test_steps_and_levels():
    assert len(set(steps(3))) == len(steps(3)) == 1 + 3 + 3 + 6 + 4 + 4
    assert all(s[0] in (-1, 0, 1) and sum(max(x, 0) for x in s[1:]) <= 1 and sum(max(-x, 0) for x in s[1:]) <= 1 for s in steps(4))
    assert top_levels(1000) == 1 < top_levels(10**7) < top_levels(10**9) < top_levels(10**12) == 16


def test_roots_follow_long_chains(spark):
    chain = [(f"w{k:03}", f"w{k + 1:03}") for k in range(37)] + [(f"v{k:03}", "w000") for k in range(200)]
    got = {r["word"]: r["root"] for r in last_forms(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert set(got.values()) == {"w037"} and len(got) == 237
