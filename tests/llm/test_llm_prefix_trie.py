"""The trie of conversations against brute force, and sums by centroids against plain ones."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from callweave.llm.prefix_trie import ROOT, forest_sums, list_digests, prefix_trie, rebuilt_turns, numbered_turns

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def slow(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append(((t is not None, t or 0), hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), (r, x)))
    own = {c: [v[2] for v in sorted(turns, key=lambda v: v[:2])] for c, turns in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    parent, depth, tokens, below = {0: None}, {0: 0}, {0: 0}, defaultdict(dict)
    for c in sorted(whole):
        at = 0
        members[0].append(c)
        for d, turn in enumerate(whole[c], 1):
            if turn not in below[at]:
                n = len(parent)
                below[at][turn], parent[n], depth[n], tokens[n] = n, at, d, len(turn[1])
            at = below[at][turn]
            members[at].append(c)
        ends[at].append(c)
    if not whole:
        return []
    leaves, saved = {}, {}
    for n in sorted(parent, key=lambda n: -depth[n]):
        under = list(below[n].values())
        leaves[n] = sum(leaves[u] for u in under) if under else 1
        saved[n] = (len(members[n]) - 1) * tokens[n] + sum(saved[u] for u in under)
    sha = lambda n: hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
    return sorted((min(members[n]), depth[n], -1 if n == 0 else min(members[parent[n]]), len(members[n]), len(below[n]), leaves[n], saved[n], sha(n)) for n in parent)


def result(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


@pytest.mark.parametrize("weight", [8192, 30])
def test_conversations_equal_brute_force(spark, sf_dir, weight):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = result(prefix_trie(turns, block_weight=weight))
    assert got == slow([tuple(r) for r in turns.collect()])


@pytest.mark.parametrize("weight", [8192, 400])
def test_odd_conversations(spark, weight):
    random = np.random.default_rng(4)
    rows = [(100, t, "u", f"turn {t}") for t in range(150)]  # a long chain, and others along parts of it
    rows += [(100 + k, t, "u", f"turn {t}") for k in range(1, 40) for t in range(int(random.integers(1, 60)))]
    rows += [(300 + k, t, "u", str(random.integers(0, 2))) for k in range(60) for t in range(int(random.integers(1, 8)))]
    rows += [(7, 0, None, None), (8, None, "a", "x" * 50000), (8, None, "a", "x" * 50000), (8, 3, "b", ""), (9, 1, "ü", "\U0001f600"), (None, 1, "a", "b")]
    rows += [(1001, 0, "u", "alone")]  # its hundred has no conversation of turns
    rows += [(2000 + k, 0, "u", "same") for k in range(200)]
    df = spark.createDataFrame([(*r, "x", 1, "n") for r in rows], SCHEMA + ", node string, depth int, c string")
    assert result(prefix_trie(df, block_weight=weight)) == slow(rows)


def test_turnless_and_empty(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(c, 0, "u", "t") for c in range(101, 131)]  # no conversation 100: those with h > 0 lose their turn
    got = result(prefix_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == slow(rows) and got[0][1] == 0 and got[0][3] == 30
    convs = rebuilt_turns(numbered_turns(spark.createDataFrame(rows, SCHEMA)))[1]
    assert convs.where("size = 0").count() > 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=120), st.sampled_from(["any", "chain", "star", "forest"]))
def test_sums_by_centroids(seeds, shape):
    n = len(seeds)
    parent = np.array([-1] + [{"any": x % i, "chain": i - 1, "star": 0, "forest": x % (i + 1) - 1}[shape] for i, x in enumerate(seeds[1:], 1)])
    values = np.stack([np.array(seeds) % 1000, np.ones(n, int)], axis=1)
    want = values.copy()
    for i in range(n - 1, -1, -1):
        if parent[i] >= 0:
            want[parent[i]] += want[i]
    assert (forest_sums(parent, values) == want).all()


def test_lists_of_any_length_hash_piece_by_piece(spark):
    ids = list(range(-5, 60000))
    ends = spark.createDataFrame([(ROOT, c) for c in ids[::-1]] + [("f" * 32, 3)], "node string, c bigint")
    got = {r["node"]: r["sha"] for r in list_digests(ends).collect()}
    assert got == {ROOT: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), "f" * 32: hashlib.sha256(b"3").hexdigest()}
