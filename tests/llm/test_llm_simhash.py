import random

import xxhash
from cases import no_documents, odd_documents

from callweave.llm import queries
from callweave.llm.links import components
from callweave.llm.simhash import drop_near_duplicates, linked_fingerprints, near_duplicates, segment_masks


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, radius=4):
    label = list(range(len(prints)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                p, q = find(a), find(b)
                label[max(p, q)] = min(p, q)
    return [find(k) for k in range(len(prints))]


def check(spark, docs, found):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    prints = [slow_fingerprint(t) for _, t in rows]
    label = slow_components(prints)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[label[k]] = min(i, least.get(label[k], i))
    want = sorted(((i, f"{prints[k]:016x}", least.get(label[k])) for k, (i, _) in enumerate(rows)), key=str)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want


def test_odd_documents(spark):
    docs = odd_documents(spark).where("length(text) < 200000 OR text IS NULL")
    check(spark, docs, near_duplicates(docs))
    assert near_duplicates(no_documents(spark)).count() == 0
    assert near_duplicates(odd_documents(spark)).count() == 10


def test_every_number_of_segments_loses_no_pair():
    rng = random.Random(7)
    for count in (10, 1 << 24, 1 << 30, 1 << 36):
        masks = segment_masks(count)
        assert all(1 << bin(m).count("1") >= count / 8 for m in masks)
        for _ in range(300):
            differ = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
            assert any(differ & m == 0 for m in masks)


def test_chains_and_large_buckets_lose_no_link(spark):
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(100)]
    chain = [rng.getrandbits(64)]
    for _ in range(60):
        chain.append(chain[-1] ^ sum(1 << b for b in rng.sample(range(64), 4)))
    hot = rng.getrandbits(64)
    group = {hot ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))) for _ in range(700)}
    every = sorted({*prints, *chain, *group})
    signed = [p - (1 << 64) if p >> 63 else p for p in every]
    edges = linked_fingerprints(spark.createDataFrame([(p,) for p in signed], "node bigint"))
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    label = slow_components(every)
    groups, mine = {}, {}
    for k, p in enumerate(signed):
        groups.setdefault(label[k], set()).add(p)
        mine.setdefault(found.get(p, p), set()).add(p)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in mine.values()}


def test_stage_keeps_one_document_of_each_group(spark):
    docs = odd_documents(spark).where("doc_id <> 4")
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 6, 7, 8]


def test_stage_decides_by_row(spark):
    kept = drop_near_duplicates(odd_documents(spark))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 4, 6, 7, 8, None]
    a, b = "one two three four five six seven eight nine ten", "rivers run over hills and down to the wide open sea"
    rows = [(5, a), (7, a.upper()), (3, b), (5, b + " "), (None, a), *[(None, "no id but the same text again and again")] * 50, *[(9, "the same id and the same text in every row")] * 3]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = sorted((tuple(r) for r in drop_near_duplicates(docs).collect()), key=str)
    assert found == sorted([(5, a), (3, b), rows[5], rows[-1]], key=str)


def test_query_equals_brute_force(spark, sf_dir):
    check(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), queries.op6_simhash_near_dedup(spark, sf_dir))


def test_rows_known_by_file_and_place(spark, sf_dir, tmp_path):
    """Reading rows again gives what writing them first gives, with many files, repeated ids and a column of the key's name."""
    from callweave.llm.mixing import take_documents

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.unionByName(docs).selectExpr("*", "'x' AS row", "1 AS file").repartition(5).write.parquet(str(tmp_path / "docs"))
    again = spark.read.parquet(str(tmp_path / "docs"))
    rows = lambda df: sorted(map(str, df.collect()))
    kept = drop_near_duplicates(again, from_files=True)
    assert kept.columns == again.columns and rows(kept) == rows(drop_near_duplicates(again))
    mixes = [rows(take_documents(again, [3, 1, 2], from_files=f)) for f in (True, False)]
    assert mixes[0] and mixes[0] == mixes[1]
    hidden = again.withColumnRenamed("file", "_metadata")
    hidden.write.parquet(str(tmp_path / "hidden"))
    assert drop_near_duplicates(spark.read.parquet(str(tmp_path / "hidden")), from_files=True).count() == kept.count()
