"""Similarity links over buckets, and the components that the links form.

Candidates share a bucket. A bucket is compared in blocks: its members are dealt to parts of
at most about BLOCK_ROWS rows, and each pair of parts is one block, so that no task ever
holds a large bucket. A block gives back one row per member at most and never a row per pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import broadcast_if_small
from .common import checkpointed, small_batches

#: Members of a part of a bucket; groups up to SMALL_GROUP rows are compared many at a time.
BLOCK_ROWS, SMALL_GROUP = 512, 48
#: Pairs that a task looks at together.
PAIRS_AT_ONCE = 100_000


def bucket_blocks(keys: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """node, bucket, a, b, part and what else keys have: the members of each block (a, b) of each bucket of two or more.

    keys: (node, bucket, ...), without repeats of both.
    """
    sizes = keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    # Written first, so that the join can split a large bucket.
    counts = checkpointed(sizes.select("bucket", F.ceil(F.col("n") / block_rows).cast("int").alias("parts")))
    dealt = keys.join(counts, "bucket").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    return other.select(*keys.columns, F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part")


def map_blocks(members: DataFrame, work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Runs work on whole blocks: a table of rows sorted by block, and the first row of each block."""
    small_batches(members.sparkSession)

    def run(batches):
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, part]) if held is not None else part
            if held.num_rows < 4096:
                continue
            starts = block_starts(held)
            if starts[-1] > 0:
                yield from work(held.slice(0, starts[-1]).combine_chunks(), starts[:-1])
                held = held.slice(starts[-1])
        if held is not None and held.num_rows:
            yield from work(held.combine_chunks(), block_starts(held))

    return members.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "node").mapInArrow(run, schema)


def block_starts(rows: pa.Table) -> np.ndarray:
    new = np.ones(rows.num_rows, bool)
    new[1:] = False
    for name in ("bucket", "a", "b"):
        x = rows[name].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def small_pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (i < j) within groups of at most SMALL_GROUP rows, many groups at a time."""
    few = sizes <= SMALL_GROUP
    starts, sizes = starts[few & (sizes > 1)], sizes[few & (sizes > 1)]
    for step in range(1, int(sizes.max(initial=0))):
        count = np.maximum(sizes - step, 0)
        left = np.repeat(starts, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        for k in range(0, len(left), PAIRS_AT_ONCE):
            yield left[k : k + PAIRS_AT_ONCE], left[k : k + PAIRS_AT_ONCE] + step


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j; label maps every row to the first row of its set."""
    while len(i):
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label[:] = further


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that links reach, for every node with a link.

    edges: (src, dst). Alternating large-star and small-star rounds; each round sends every
    node's neighbours to the smallest of them, and every node keeps one edge in the end. The
    smallest neighbours, a row for each node, are written before edges are joined with them:
    both sides of such a join are plain shuffles, and Spark splits a node of very many edges.
    """
    high, low = F.greatest("src", "dst"), F.least("src", "dst")
    now = checkpointed(edges.where("src <> dst").select(high.alias("hi"), low.alias("lo")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
        if state == before or state["n"] == 0:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component"))).distinct()
        before = state
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = checkpointed(large)
        first = checkpointed(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = large.join(first, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = checkpointed(small.unionByName(first.select("hi", F.col("m").alias("lo"))).distinct())


def component_minima(members: DataFrame, parts: DataFrame, value: str, name: str) -> DataFrame:
    """node, `name`: the least `value` of the component of each node that has a component.

    members: (node, value); parts: (node, component). The minima, a row for each component, are
    written and counted first. Few are broadcast, so that nodes stay where they are; with many, the
    join is one in which Spark can split a component of very many nodes.
    """
    least = broadcast_if_small(members.join(parts, "node").groupBy("component").agg(F.min(value).alias(name)))
    return parts.join(least, "component").select("node", name)
