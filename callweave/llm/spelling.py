"""Spelling variants: near words by a trie of letter-group counts, and the form that each word leads to.

The words of all texts are counted in Spark. A word becomes a vector of counts, one for each group
of letters; groups are dealt from the letter counts of all words, so that each has about the same
share. The vectors, preceded by the word's length, form a trie. One edit moves a vector by one
surplus and one deficit at most, so the search for a word goes down depth first, at each level
along the children within what is left of that budget of one each; words at the leaves are
verified, by the lengths of the common start and the common end.

The top levels of the trie deal the words to sub-tries, and each word as a query to the sub-tries
that its budget reaches. A sub-trie of many letters is cut into parts, and so are its queries, so
that no task holds an unbounded group; what comes back is one row for each query and part, never a
row for each pair. The number of top levels grows with the number of words.

A form is the near word of largest n (ties: the smallest in code-point order) if that is RATIO
times the word's n at least; roots follow forms to the last by doubling.

Defined cases: null texts have no words, and a null id counts as an empty one; repeated rows count
again; runs of any length are whole words; ties are broken as stated; an empty table gives an
empty table; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import broadcast_if_small
from .common import checkpointed, small_batches

#: What a word is made of, and the slip that the query's words get.
RUN, SLIP = "[A-Za-zÀ-ÿ]+", 199
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Groups of letters, which are the levels of the trie below the length.
GROUPS = 16
#: Words that a sub-trie has at about; letters of its parts, and of the queries that meet a part.
SUBTRIE, BLOCK_LETTERS, QUERY_LETTERS = 8192, 1 << 17, 1 << 19
#: A node of so few words is compared at once; elements of one comparison.
LEAF, AT_ONCE = 24, 1 << 20


def slipped(word: Column, doc_id: Column, slip: int = SLIP) -> Column:
    """The word without one of its code points where `slip` divides the crc32 of "<id>:<word>"."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    place = F.pmod(h, F.char_length(word)).cast("int")
    shorter = F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.char_length(word)))
    return F.when(F.pmod(h, F.lit(slip)) == 0, shorter).otherwise(word)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int = SLIP, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the words of whole texts, only A-Z lower-cased, with enough letters and occurrences."""
    low = F.translate(docs[text_col].cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(docs[id_col].alias("i"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("w"))
    words = runs.select(slipped(F.col("w"), F.col("i"), slip).alias("word")).where(F.char_length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def letter_groups(words: DataFrame, groups: int = GROUPS) -> list[str]:
    """The letters of each group: the most frequent letters first, each to the group of least occurrences.

    A row for each letter comes to the driver; the pattern of words admits 116 letters.
    """
    counts = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("m"))
    dealt, load = [""] * groups, [0] * groups
    for row in sorted(counts.collect(), key=lambda r: (-r["m"], r["c"])):
        g = load.index(min(load))
        dealt[g] += row["c"]
        load[g] += row["m"]
    return dealt


def steps(levels: int) -> list[tuple[int, ...]]:
    """Changes of (length, counts of the top levels) that one edit can make."""
    none = (0,) * levels
    plus = [tuple(int(i == k) for i in range(levels)) for k in range(levels)]
    minus = [tuple(-x for x in p) for p in plus]
    both = [tuple(a + b for a, b in zip(p, m)) for i, p in enumerate(plus) for j, m in enumerate(minus) if i != j]
    return [(0, *x) for x in [none, *plus, *minus, *both]] + [(1, *x) for x in [none, *plus]] + [(-1, *x) for x in [none, *minus]]


def top_levels(count: int, groups: int = GROUPS) -> int:
    """Levels of counts, beside the length, that name a sub-trie; each cuts the words to about a third."""
    levels = 1
    while levels < groups and count > SUBTRIE * 8 * 3**levels:
        levels += 1
    return levels


class Letters:
    """Words as arrays: lengths, counts by group, and letters from the start and from the end.

    Both sides of a comparison fill up their letters differently, so that no word runs on into another.
    """

    def __init__(self, words: pa.ChunkedArray, letters: list[str], width: int, fill: int):
        self.words = words.to_pylist()
        n, self.length = len(self.words), np.array([len(w) for w in self.words], np.int64)
        flat = np.frombuffer("".join(self.words).encode("utf-32-le"), "<u4")
        row = np.repeat(np.arange(n), self.length)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        group = np.zeros(1 + max([0, *(ord(c) for g in letters for c in g)]), np.int64)
        for k, g in enumerate(letters):
            group[[ord(c) for c in g]] = k
        self.counts = np.bincount(row * len(letters) + group[flat], minlength=n * len(letters)).reshape(n, len(letters)).astype(np.int32)
        self.start, self.end = np.full((n, width), fill, np.uint8), np.full((n, width), fill, np.uint8)
        self.start[row, place] = flat
        self.end[row, np.repeat(self.length, self.length) - 1 - place] = flat


def trie_pairs(own: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, row) pairs of counts that differ by one surplus and one deficit at most, by a depth-first search.

    own is sorted by its columns, so that a node of the trie is a range of rows. All queries that
    still have budget at a node go down together.
    """
    levels = own.shape[1]

    def descend(level: int, lo: int, hi: int, q: np.ndarray, surplus: np.ndarray, deficit: np.ndarray):
        if hi == lo or not len(q):
            return
        if level == levels or hi - lo <= LEAF:
            step = max(1, AT_ONCE // ((hi - lo) * max(1, levels - level)))
            for k in range(0, len(q), step):
                part = q[k : k + step]
                change = own[None, lo:hi, level:] - asked[part][:, None, level:]
                over = np.maximum(change, 0).sum(2)
                fits = (over <= surplus[k : k + step, None]) & (over - change.sum(2) <= deficit[k : k + step, None])
                i, j = np.nonzero(fits)
                yield part[i], lo + j
            return
        column = own[lo:hi, level]
        cuts = np.flatnonzero(np.diff(column)) + 1
        wanted = asked[q, level]
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), hi - lo]):
            change = column[a] - wanted
            alive = np.flatnonzero((change <= surplus) & (-change <= deficit))
            spent = change[alive]
            yield from descend(level + 1, lo + a, lo + b, q[alive], surplus[alive] - np.maximum(spent, 0), deficit[alive] - np.maximum(-spent, 0))

    ones = np.ones(len(asked), np.int32)
    yield from descend(0, 0, len(own), np.arange(len(asked)), ones, ones)


def near_in_block(own: pa.Table, asked: pa.Table, letters: list[str]) -> pa.Table:
    """word, n_near, form, form_n: the near words that a query has among the words of one block, and the largest."""
    width = 2 + max(max((len(w) for w in t[c].to_pylist()), default=0) for t, c in ((own, "near"), (asked, "word")))
    mine, theirs = Letters(own["near"], letters, width, 0), Letters(asked["word"], letters, width, 1)
    n = own["n"].to_numpy()
    # Words in the order in which a form is chosen; then each node of the trie is a range of rows.
    best = np.empty(len(n), np.int64)
    best[sorted(range(len(n)), key=lambda r: (-n[r], mine.words[r]))] = np.arange(len(n))
    order = np.lexsort(mine.counts.T[::-1])
    found, first = np.zeros(len(theirs.words), np.int64), np.full(len(theirs.words), len(n), np.int64)
    for q, at in trie_pairs(mine.counts[order], theirs.counts):
        step = max(1, 4 * AT_ONCE // width)
        for k in range(0, len(q), step):
            i, r = q[k : k + step], order[at[k : k + step]]
            shared = (theirs.start[i] != mine.start[r]).argmax(1) + (theirs.end[i] != mine.end[r]).argmax(1)
            size, other = theirs.length[i], mine.length[r]
            # One edit parts a common start from a common end; equal words share both whole.
            near = (shared >= np.maximum(size, other) - 1) & (np.abs(size - other) <= 1) & ~((size == other) & (shared == 2 * size))
            i, r = i[near], r[near]
            found += np.bincount(i, minlength=len(found))
            np.minimum.at(first, i, best[r])
    hit = np.flatnonzero(found)
    chosen = np.argsort(best)[first[hit]]
    return pa.table({"word": pa.array([theirs.words[i] for i in hit], pa.string()), "n_near": pa.array(found[hit]), "form": pa.array([mine.words[r] for r in chosen], pa.string()), "form_n": pa.array(n[chosen], pa.int64())})


def near_words(words: DataFrame, groups: int = GROUPS) -> DataFrame:
    """word, n_near, form, form_n: how many near words a word has, and the one of largest n; only words that have one.

    words: (word, n) without repeats, from the pattern of words.
    """
    letters = letter_groups(words, groups)
    levels = top_levels(words.count(), groups)
    size = F.char_length("word")
    count = [(size - F.char_length(F.translate("word", g, ""))) if g else F.lit(0) for g in letters[:levels]]
    keyed = words.select("word", "n", F.array(size, *count).alias("at"))
    sizes = keyed.groupBy("at").agg(F.count("*").alias("words"))
    moves = [F.array(*[F.get("at", i) + d for i, d in enumerate(step)]) for step in steps(levels)]
    letters_of = lambda col: F.get("at", 0) * F.col(col)
    reached = sizes.select(F.explode(F.array(*moves)).alias("at"), "words").groupBy("at").agg(F.sum("words").alias("queries"))
    parts = lambda col, most: F.greatest(F.lit(1), F.ceil(letters_of(col) / most)).cast("int")
    # A row for each sub-trie.
    blocks = broadcast_if_small(sizes.join(reached, "at").select("at", parts("words", BLOCK_LETTERS).alias("own_parts"), parts("queries", QUERY_LETTERS).alias("query_parts")))
    dealt = lambda parts: F.pmod(F.xxhash64("word"), F.col(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    own = keyed.join(blocks, "at").select("at", dealt("own_parts").alias("a"), each("query_parts").alias("b"), "word", "n")
    asked = keyed.select("word", F.explode(F.array(*moves)).alias("at")).join(blocks, "at").select("at", each("own_parts").alias("a"), dealt("query_parts").alias("b"), "word")
    small_batches(words.sparkSession)

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        return near_in_block(mine, theirs, letters)

    key = [F.concat_ws(",", "at").alias("block"), "a", "b"]
    own = own.select(*key, F.col("word").alias("near"), "n")
    asked = asked.select(F.concat_ws(",", "at").alias("of"), F.col("a").alias("c"), F.col("b").alias("d"), "word")
    made = own.groupBy("block", "a", "b").cogroup(asked.groupBy("of", "c", "d")).applyInArrow(run, "word string, n_near bigint, form string, form_n bigint")
    best = F.min(F.struct((-F.col("form_n")).alias("order"), "form")).alias("best")
    return made.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.order")).alias("form_n"))


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root of words with a form: forms followed to the last by doubling the length of the steps.

    forms: (word, form); every form is more frequent than its word, so there are no rings.
    """
    now = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        further = broadcast_if_small(now.join(now.select(F.col("root").alias("at")).distinct(), F.col("word") == F.col("at"), "left_semi").select(F.col("word").alias("at"), F.col("root").alias("next")))
        if further.isEmpty():
            return now
        now = checkpointed(now.join(further, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root")))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int = SLIP, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word."""
    words = checkpointed(word_counts(docs, id_col, text_col, slip))
    near = near_words(words)
    fits = F.col("form_n") >= ratio * F.col("n")
    whole = checkpointed(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")))
    roots = last_forms(whole.where("form IS NOT NULL"))
    return whole.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
