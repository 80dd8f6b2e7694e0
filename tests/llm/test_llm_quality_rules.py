import math
import random
import re
from collections import defaultdict

from cases import no_documents, odd_documents

from callweave.llm import queries
from callweave.llm.quality_rules import MEASURES, MIN_GROUP, REACH, filter_quality, quality_verdicts, repeated_words, text_counts


def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    cover = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_counts_equal_brute_force():
    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choice(["a ", "b ", "é", "中 ", "\n", "\t", "#", "|", "\x85", "\u3000", "aa bb cc dd ee ff "]) for _ in range(rng.randint(0, 60)))
        assert text_counts(text.encode()) == slow_counts(text)
    assert repeated_words([b"x"] * 9) == 9


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = quality_verdicts(docs).collect()
    assert len(rows) == 10
    counts = {r["doc_id"]: r for r in rows}
    assert counts[2]["n_words"] == 0 and counts[2]["base_failed"] and not counts[2]["kept"]
    assert counts[4]["n_repeat_words"] == counts[4]["n_words"] == 120000
    kept = filter_quality(docs)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [1]
    assert quality_verdicts(no_documents(spark)).count() == 0 and filter_quality(no_documents(spark)).count() == 0


def test_thresholds_follow_the_source(spark):
    def text(k, marks):
        rng = random.Random(k)
        return " ".join(f"w{rng.randrange(10**6)}" + "*" * (k < marks) for k in range(50))

    rows = [(k, text(k, k % 3), "en", "plain") for k in range(300)] + [(1000 + k, text(k + 999, 30 + k % 3), "en", "marked") for k in range(300)]
    rows += [(5000, text(1, 30), "en", "plain"), (5001, text(2, 30), "en", "marked")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality_verdicts(df).collect()}
    assert not kept[5000] and kept[5001] and all(v for k, v in kept.items() if k < 5000)


def slow_verdicts(docs):
    """(counts, failed, kept) of each row (lang, source, text), from plain lists of values."""
    made, values = [], defaultdict(lambda: defaultdict(list))
    for lang, source, text in docs:
        n, chars, symbols, dups, repeats = counts = slow_counts(text)
        failed = n < 10 or 100 * repeats > 20 * n
        mine = {"symbols": 1000 * symbols // n, "dup_lines": 1000 * dups // n, "word_length": int(max(0, 100 * chars / n - 400 / math.sqrt(n)))} if n else {}
        made.append((lang, source, counts, failed, mine))
        for m, v in () if failed else mine.items():
            step = max(0, v.bit_length() - 6)
            for key in ((lang, source), lang, "all"):
                values[key][m].append(v >> step << step)
    fences = {key: {m: sorted(v) for m, v in own.items()} for key, own in values.items()}

    def fence(lang, source, m):
        key = next((k for k in ((lang, source), lang) if len(fences.get(k, {}).get(m, ())) >= MIN_GROUP), "all")
        held = fences[key][m]
        q1, q3 = (held[math.ceil(q * len(held)) - 1] for q in (0.25, 0.75))
        return q3 + REACH * (q3 - q1) + MEASURES[m][1]

    return [(c, failed, not failed and all(v <= fence(lang, source, m) for m, v in mine.items())) for lang, source, c, failed, mine in made]


def test_query_equals_brute_force(spark):
    held = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{held}/documents.parquet").collect()
    want = {r["doc_id"]: v for r, v in zip(docs, slow_verdicts([(r["lang"], r["source"], r["text"]) for r in docs]))}
    rows = queries.op8_quality_rules(spark, held).collect()
    assert len(rows) == len(want) and {(r["base_failed"], r["kept"]) for r in rows} == {(True, False), (False, False), (False, True)}
    for r in rows:
        assert (tuple(r)[1:6], r["base_failed"], r["kept"]) == want[r["doc_id"]]
