"""LM scoring by cross-entropy difference.

A target and a background n-gram model over bytes score every document: for each byte the
difference of the losses -log2 P(byte | three bytes before), and for the document their mean,
which is low for text like the target. The target model counts the documents that the
caller marks, the background model all documents. Both are matched: the same vocabulary of
bytes, orders 1 to 4, smoothing and tables, so that only the counts differ. An order's
probability is (n(context, byte) + SMOOTHING * lower order) / (n(context) + SMOOTHING), where
n(context) counts the places at which a byte follows the context, so that the probabilities of all
bytes after a context add up to 1.

All orders are exact, and the table of n-grams grows with the corpus. Distinct texts are dealt to blocks
of about BLOCK_BYTES. A block lists each of its distinct n-grams once, as a row with both
counts; the rows are added up by n-gram in Spark, the sums go back to the blocks that hold
the n-gram, and each block scores its texts. An n-gram has one row for each block at most, so
frequent ones weigh no more than others, and nothing is gathered on the driver.

Defined cases: null and empty texts have no tokens, losses 0 and difference 0; without a marked
document the target model is uniform; repeated rows count one by one: equal texts, told by their MD5, are counted and
scored once with the number of their rows; a text of any length is in one block, by itself if it is longer
than one; a document is marked by its id, so all rows of an id are; an empty table gives an empty table;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import broadcast_if_small
from .common import checkpointed, small_batches, text_bytes

SMOOTHING, START = 4.0, b"\n\n\n"
#: Bytes that are looked at together.
AT_ONCE = 1 << 19
#: Bytes of the texts of a block, about, and what a row counts for besides its text.
BLOCK_BYTES, ROW_BYTES = 8 << 20, 32
#: Bytes of equal texts together from which they are made one before they go to their block.
HOT_BYTES = BLOCK_BYTES // 8
LOSSES = ("n_tokens", "loss_target", "loss_background", "loss_difference")
#: What a key of the table counts: the leading bits of the key, before the bytes. TOTAL, FIRST,
#: SECOND and THIRD are contexts of 0 to 3 bytes, the others a byte after such a context.
TOTAL, UNI, FIRST, BI, SECOND, TRI, THIRD, QUAD = (k << 32 for k in range(8))
#: Distinct n-grams that wait to be added up.
HELD = 1 << 20


def ngrams(texts: list[bytes]):
    """The four bytes that end at every byte, in parts: (document, quad)."""
    docs, held, size = [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, len(text), AT_ONCE):  # a long text in pieces, each with the bytes before it
            held.append(((START if at == 0 else b"") + text[max(0, at - 3) : at])[-3:] + text[at : at + AT_ONCE])
            docs.append(k)
            size += len(held[-1])
            if size >= AT_ONCE:
                yield cells(docs, held)
                docs, held, size = [], [], 0
    if held:
        yield cells(docs, held)


def cells(docs: list[int], pieces: list[bytes]):
    data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint32)
    sizes = np.array([len(p) for p in pieces])
    own = np.ones(len(data), bool)
    starts = np.cumsum(sizes) - sizes
    own[(starts[:, None] + np.arange(3)).ravel()] = False
    four = data.copy()
    for k in range(1, 4):
        four[k:] |= data[:-k] << (8 * k)
    return np.repeat(docs, sizes - 3), four[own]


def add_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and for each the sum of its columns of counts (2, key)."""
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    both = np.concatenate(counts, axis=1)
    return found, np.stack([np.bincount(place, row, len(found)).astype(np.int64) for row in both])


def count_weighted(groups: list[tuple[list[bytes], int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct quads, and their counts (2, quad), from texts that each count so often in the target and in all."""
    keys, counts, held = [np.zeros(0, np.uint32)], [np.zeros((2, 0), np.int64)], 0
    for texts, target, every in groups:
        for _, quad in ngrams(texts):
            found, n = np.unique(quad, return_counts=True)
            keys.append(found)
            counts.append(n * np.array([[target], [every]]))
            held += len(found)
            if held > HELD:
                found, both = add_up(keys, counts)
                keys, counts, held = [found], [both], 0
    return add_up(keys, counts)


def count_quads(marked: list[bytes], other: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct quads, and their counts (2, quad) in the marked texts and in all."""
    return count_weighted([(marked, 1, 1), (other, 0, 1)])


def count_keys(quads: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all orders that the losses of the quads need, and their counts here."""
    parts = [add_up([k], [counts]) for k in orders(quads)]
    return add_up([k for k, _ in parts], [n for _, n in parts])


def orders(quads: np.ndarray) -> list[np.ndarray]:
    """The keys of the contexts and of the last byte after them, lowest order first."""
    q = quads.astype(np.int64)
    return [TOTAL | q & 0, UNI | q & 0xFF, FIRST | q >> 8 & 0xFF, BI | q & 0xFFFF, SECOND | q >> 8 & 0xFFFF, TRI | q & 0xFFFFFF, THIRD | q >> 8, QUAD | q]


def quad_bits(quads: np.ndarray, keys: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """(2, quad): the losses of the last byte after the three before it, from the sums of all blocks."""
    total, uni, first, bi, second, tri, third, quad = (sums[:, np.searchsorted(keys, k)] for k in orders(quads))
    p = (uni + 1) / (total + 256)
    for context, after in ((first, bi), (second, tri), (third, quad)):
        p = (after + SMOOTHING * p) / (context + SMOOTHING)
    return -np.log2(p)


class Places:
    """Finds the places of quads in a list of distinct ones that has them all."""

    def __init__(self, quads: np.ndarray):
        self.quads, bits = quads, max(4, (2 * len(quads)).bit_length())
        self.shift, self.mask = np.uint32(32 - min(bits, 32)), (1 << min(bits, 32)) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)
        left = np.arange(len(quads), dtype=np.int32)
        at = self.start(quads)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            away = self.slots[at] != left
            left, at = left[away], at[away] + 1 & self.mask

    def start(self, quads: np.ndarray) -> np.ndarray:
        return (((quads ^ (quads >> np.uint32(15))) * np.uint32(2246822519)) >> self.shift).astype(np.int64)

    def find(self, quads: np.ndarray) -> np.ndarray:
        at = self.start(quads)
        found = self.slots[at]
        left = np.flatnonzero(self.quads[found] != quads)
        at = at[left]
        while len(left):
            at = at + 1 & self.mask
            found[left] = self.slots[at]
            away = self.quads[found[left]] != quads[left]
            left, at = left[away], at[away]
        return found


def losses(texts: list[bytes], quads: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """(2, document): summed losses in bits, target and background."""
    out, places = np.zeros((2, len(texts))), Places(quads)
    for doc, quad in ngrams(texts):
        at = places.find(quad)
        for k in range(2):
            out[k] += np.bincount(doc, bits[k][at], len(texts))
    return out


def score_by_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id, n_tokens, loss_target and loss_background in bits a byte, and their difference.

    The documents labelled 1 are the target.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_bytes(text_col), F.lit(b"")).alias("text")).withColumn("h", F.md5("text"))
    # Ids and hashes are written, so that the joins below are ones in which Spark can split a hot id or text.
    keyed = checkpointed(rows.select("id", "h", F.octet_length("text").alias("n")))
    good = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast(kind).alias("g")).distinct()
    marked = keyed.join(good, F.col("id") == F.col("g"), "left")
    times = checkpointed(marked.groupBy("h").agg(F.count("g").alias("n_target"), F.count("*").alias("n_all"), F.max("n").alias("n")))
    size = times.agg(F.sum(F.col("n") + F.lit(ROW_BYTES)).cast("bigint").alias("n")).first()["n"] or 0
    block = F.pmod(F.xxhash64("h"), F.lit(size // BLOCK_BYTES + 1)).alias("block")
    # A text whose copies would fill a good part of a block goes there once: each task sends one copy, and one of
    # these stays. There are a few such texts for each block at most. Other copies meet in their block.
    large = (F.col("n_all") > 1) & (F.col("n_all") * (F.col("n") + F.lit(ROW_BYTES)) > HOT_BYTES)
    hot = broadcast_if_small(times.where(large).select(F.col("h").alias("hot")))
    few = rows.join(hot, F.col("h") == F.col("hot"), "left_semi").groupBy("h").agg(F.first("text").alias("text"))
    texts = rows.join(hot, F.col("h") == F.col("hot"), "left_anti").select("h", "text").unionByName(few).select(block, "h", "text")
    times = times.select(block.alias("of"), F.col("h").alias("key"), "n_target", "n_all")

    def count(key, times: pa.Table, texts: pa.Table) -> pa.Table:
        held = dict(zip(texts["h"].to_pylist(), texts["text"].to_pylist()))
        alike: dict[tuple[int, int], list[bytes]] = {}
        for h, target, every in zip(times["key"].to_pylist(), times["n_target"].to_pylist(), times["n_all"].to_pylist()):
            if held[h]:
                alike.setdefault((target, every), []).append(held[h])
        keys, counts = count_keys(*count_weighted([(held, *n) for n, held in alike.items()]))
        return pa.table({"block": pa.array(np.full(len(keys), key[0].as_py())), "gram": pa.array(keys), "n_target": pa.array(counts[0]), "n_all": pa.array(counts[1])})

    def score(known: pa.Table, texts: pa.Table) -> pa.Table:
        distinct = dict(zip(texts["h"].to_pylist(), texts["text"].to_pylist()))
        held = list(distinct.values())
        order = np.argsort(known["gram"].to_numpy())
        keys = known["gram"].to_numpy()[order]
        sums = np.stack([known[c].to_numpy()[order] for c in ("n_target", "n_all")])
        quads = (keys[keys >= QUAD] & 0xFFFFFFFF).astype(np.uint32)
        n = np.array([len(t) for t in held], np.int64)
        mean = losses(held, quads, quad_bits(quads, keys, sums)) / np.maximum(n, 1)
        columns = [pa.array(list(distinct), pa.string()), pa.array(n), *map(pa.array, (mean[0], mean[1], mean[0] - mean[1]))]
        return pa.table(columns, names=["h", *LOSSES])

    counted = times.groupBy("of").cogroup(texts.groupBy("block")).applyInArrow(count, "block bigint, gram bigint, n_target bigint, n_all bigint")
    everywhere = Window.partitionBy("gram")
    known = counted.select("block", "gram", *[F.sum(c).over(everywhere).alias(c) for c in ("n_target", "n_all")])
    scored = known.groupBy("block").cogroup(texts.select(F.col("block").alias("at"), "h", "text").groupBy("at")).applyInArrow(score, "h string, n_tokens bigint, loss_target double, loss_background double, loss_difference double")
    scored = checkpointed(scored.select(F.col("h").alias("s"), *LOSSES))
    return keyed.join(scored, F.col("h") == F.col("s")).select(F.col("id").alias(id_col), *LOSSES)
