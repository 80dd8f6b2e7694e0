import math

import numpy as np
import pytest

from callweave.llm import queries
from callweave.llm.spherical import CODE, Codes, code_size, near_vectors, sketch_radius, unit


def slow(rows, threshold=0.9):
    def usable(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    good = [k for k, (_, v) in enumerate(rows) if usable(v)]
    label, links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in good:
        for b in good:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], float) / np.abs(rows[k][1]).max() for k in (a, b))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    p, q = find(a), find(b)
                    label[max(p, q)] = min(p, q)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, links[k], least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(rows))


def test_equals_brute_force_with_large_groups(spark):
    random = np.random.default_rng(1)
    rows = [(i, random.normal(size=16).tolist()) for i in range(150)]
    base = random.normal(size=16)
    rows += [(1000 + i, (base + random.normal(size=16) * 0.12).tolist()) for i in range(700)]  # more than a block
    rows += [(2000 + i, base.tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = sorted(tuple(r) for r in near_vectors(df).collect())
    want = slow(rows)
    pairs, hit = sum(w[1] for w in want), sum(f[1] for f in found)
    assert all(f[1] <= w[1] for f, w in zip(found, want))
    assert hit >= 0.99 * pairs and sum(f[2] == w[2] for f, w in zip(found, want)) >= 0.99 * len(rows)


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0, 0.0]), (10, [1e300, 2e300]), (11, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, node string, n_links int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df).collect()}
    assert all(found[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 9))
    assert found[7] == (3, 7, True) and all(found[i] == (3, 7, False) for i in (8, 10, 11))
    assert near_vectors(df.limit(0)).count() == 0


def pairs_at_the_threshold(n):
    random = np.random.default_rng(5)
    x = unit(random.normal(size=(n, 64)))
    z = random.normal(size=x.shape)
    z = unit(z - (z * x).sum(1, keepdims=True) * x)
    return x.astype(np.float32), (0.9 * x + math.sqrt(1 - 0.81) * z).astype(np.float32)


@pytest.mark.parametrize("count", [1000, 4_000_000, 20_000_000])
def test_filters_find_pairs_at_the_threshold(count):
    code, filters = code_size(count)
    assert (code, filters) == (CODE, 27) or count > 1000
    codes, shared, held = Codes(64, code, filters), 0, 0
    found = []
    for vectors in pairs_at_the_threshold(400):
        row, one = codes.decode(vectors)
        held += len(row)
        found.append([set(x.tolist()) for x in np.split(one, np.cumsum(np.bincount(row, minlength=400))[:-1])])
    shared = [bool(a & b) for a, b in zip(*found)]
    assert np.mean(shared) >= 0.98 and 0.7 * filters < held / 800 < 1.4 * filters


def test_sketches_keep_pairs_at_the_threshold():
    codes = Codes(64)
    x, y = (codes.sketches(v) for v in pairs_at_the_threshold(20000))
    differ = np.bitwise_count(x ^ y).sum(1)
    assert differ.max() <= sketch_radius(0.9)


def test_single_precision_is_kept(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, math.sqrt(0.19)]), (3, [0.8999, math.sqrt(1 - 0.8999**2)])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    exact = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert sorted(tuple(r) for r in near_vectors(df).collect()) == slow(exact)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op2_embedding_near_dedup(spark, sf_dir).collect()) == slow(rows)
