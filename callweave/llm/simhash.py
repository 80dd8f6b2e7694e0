"""SimHash near-dedup with pivot distance tables.

A fingerprint has a bit set where over half of the 64-bit hashes of a text's word shingles
have it. Texts link when their fingerprints differ in at most `radius` bits.

Equal fingerprints are one class. Cut into s segments, two fingerprints within the radius agree
in s - radius of them at least, so classes are dealt to buckets by every choice of so many
segments, which loses no pair whatever s is. s grows with the number of classes, so that chance
alone brings a class about one other in a bucket.

Every fingerprint carries a table of its Hamming distances to pivots, the reference
fingerprints: by the triangle inequality no coordinate of two fingerprints within the radius
differs by more than the radius. The members of a large bucket are sorted by the pivot whose
distances spread most there, and only those within the radius of each other in it are paired;
of all pairs, those with a larger maximum difference are discarded, and the survivors are verified.

Defined cases: texts without words, null or empty, have fingerprint zero and link like
others; texts of fewer words than a shingle are one shingle; repeated rows share a class;
rows of an id that repeats are judged one by one, and a component is named by its
smallest id; a bit that just half the hashes have is not set; texts of any length are read to their
end; an empty table gives an empty table; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_column, text_bytes, with_row_key
from .links import PAIRS_AT_ONCE, SMALL_GROUP, bucket_blocks, component_minima, components, join_labels, map_blocks, small_pairs

SHINGLE, SEED, RADIUS, PIVOTS = 4, 42, 4, 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    width = min(shingle, len(words))
    starts, ends = (end - size)[: len(words) - width + 1].tolist(), end[width - 1 :].tolist()
    hashes = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends)], "<u8")
    bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):  # a long text needs no more memory for its bits
        part = np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bits += part.sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns and fp bigint."""

    def start():
        return lambda batch: [[fingerprint(x) for x in batch.to_pylist()]]

    return map_column(docs, text_bytes(text_col), keep, {"fp": "bigint"}, start)


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same everywhere."""
    return np.array([xxhash.xxh64_intdigest(k.to_bytes(4, "little"), SEED) for k in range(count)], "<u8")


def segment_masks(count: int, radius: int = RADIUS) -> list[int]:
    """The bits of every choice of segments in which two fingerprints within the radius may agree."""
    n = radius + 2
    while n < 16 and count > 1 << 64 * (n - radius) // n:
        n += 1
    cuts = [64 * i // n for i in range(n + 1)]
    segments = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(segments, n - radius)]


def segment_keys(fps: DataFrame, masks: list[int]) -> DataFrame:
    """node, bucket for every mask; a bucket holds the mask's number and the bits under it."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = [F.struct(F.lit(k).alias("k"), F.col("node").bitwiseAND(F.lit(signed(m))).alias("bits")) for k, m in enumerate(masks)]
    return fps.select("node", F.explode(F.array(*keys)).alias("x")).select("node", F.xxhash64("x.k", "x.bits").alias("bucket"))


def linked_fingerprints(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """src, dst: links that join all fingerprints of a component, from distinct fingerprints (node)."""
    table = pivots()

    def links(rows: pa.Table, starts: np.ndarray):
        ids = rows["node"].to_numpy()
        fp, n = ids.view("<u8"), len(ids)
        part, split = rows["part"].to_numpy(), rows["a"].to_numpy() != rows["b"].to_numpy()
        far = np.bitwise_count(fp[:, None] ^ table).astype(np.int8)
        label = np.arange(n)

        def verify(i, j):
            ok = ~split[i] | (part[i] != part[j])
            i, j = i[ok], j[ok]
            for k in range(0, far.shape[1], 4):
                near = (np.abs(far[i, k : k + 4] - far[j, k : k + 4]) <= radius).all(1)
                i, j = i[near], j[near]
            same = np.bitwise_count(fp[i] ^ fp[j]) <= radius
            join_labels(label, i[same], j[same])

        sizes = np.diff(starts, append=n)
        for i, j in small_pairs(starts, sizes):
            verify(i, j)
        for s, size in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP]):
            own = far[s : s + size]
            best = own[:, own.std(0).argmax()].astype(np.int64)
            order = np.argsort(best, kind="stable")
            # Each row is paired with those behind it whose distance to the pivot is within the radius.
            count = np.searchsorted(best[order], best[order] + radius, "right") - np.arange(1, size + 1)
            step = max(1, PAIRS_AT_ONCE // size)
            for k in range(0, size, step):
                n_here = count[k : k + step]
                i = np.repeat(np.arange(k, k + len(n_here)), n_here)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n_here) - n_here, n_here)
                verify(s + order[i], s + order[j])
        moved = label != np.arange(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["src", "dst"])

    return map_blocks(bucket_blocks(segment_keys(fps, segment_masks(fps.count(), radius))), links, "src bigint, dst bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id of every row."""
    rows = checkpointed(fingerprints(docs.select(F.col(id_col).alias("n_id"), F.col(text_col)), ["n_id"], text_col))
    classes = checkpointed(rows.groupBy(F.col("fp").alias("node")).agg(F.min("n_id").alias("rep")))
    found = checkpointed(components(linked_fingerprints(classes.select("node"), radius)))
    named = component_minima(classes, found, "rep", "component_id")
    # Written first, so that the join with the rows is one that can split a frequent fingerprint.
    whole = checkpointed(classes.join(named, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id")))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(whole, rows["fp"] == whole["node"]).select(F.col("n_id").alias(id_col), text.alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, from_files: bool = False) -> DataFrame:
    """One row of docs for each component, with its columns: the one of least id, null ids last.

    Rows that share that id are told apart by a row key. from_files says that docs is a plain reading of
    Parquet files, whose rows have such a key already and are read again in the end; others are written first.
    """
    rows, own = with_row_key(docs, from_files)
    keyed = rows.select(F.col(own[id_col]).alias("n_id"), F.col(own[text_col]).alias("n_text"), "row")
    keys = checkpointed(fingerprints(keyed, ["n_id", "row"], "n_text"))
    first = F.min(F.struct(F.col("n_id").isNull().alias("without"), F.col("n_id"), F.col("row"))).alias("first")
    classes = checkpointed(keys.groupBy(F.col("fp").alias("node")).agg(first))
    found = checkpointed(components(linked_fingerprints(classes.select("node"), radius)))
    # The rows of a fingerprint without links are a component of its own name.
    named = classes.join(found, "node", "left").select(F.coalesce("component", "node").alias("component"), "first")
    kept = named.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias("kept_row"))
    return rows.join(kept, rows["row"] == kept["kept_row"], "left_semi").select(*[F.col(o).alias(c) for c, o in own.items()])
