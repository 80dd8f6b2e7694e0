"""Trie of the prefixes of conversations, rolled up by centroid decomposition.

A conversation is a sequence of turns; every distinct sequence of first turns is a node, and the
node without its last turn is its parent. A node is named by its depth and a digest of 128 bits:
the exclusive or of a hash of every turn with its place. So all prefixes of a conversation follow
from one running sum over rows dealt by ranges, however long a conversation is, and no text is
shuffled beyond its digest.

Sums over subtrees come from a centroid decomposition of the forest of parent edges. A node weighs
the conversations through it, and the weight of its subtree is the sum of what its conversations
still have before them, which is a plain aggregate. The centroid of a component is its deepest node
with more than half of the component's weight below it. Cutting it off makes a component of each of
its children and one of what is above, none with more than half the weight. What the centroid has
below it in its component is one total, added to every node on the path from the centroid to the
component's top. Rounds over all large components run in Spark, a few joins each; components of at
most BLOCK_WEIGHT go to tasks whole, many at a time, where the recursion goes on to single nodes.
There are about log2(weight / BLOCK_WEIGHT) rounds whatever the shape is, a chain or a star.

Defined cases: null role or text is empty, a null turn comes first; turns of equal number come in
the order of the MD5 of role and text; rows without a conversation are ignored; repeated
rows are turns like others; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import broadcast_if_small, ranked
from .common import checkpointed, crc_rest, small_batches, written

#: Weight of a component that a task decomposes by itself; bytes of one piece of a list of ids.
BLOCK_WEIGHT, PIECE_BYTES = 8192, 1 << 16
#: The node of no turns.
ROOT = "0" * 32
#: An id's conversation of the first turns is the one of its hundred, and the turns are below six.
HUNDRED, HEADS = 100, 6


def numbered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """c, pos (from 1), digest, tokens (code points): the turns of each conversation in order, without their texts."""
    said, by = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.char_length(by).cast("string"), F.lit(":"), by, said).cast("binary"))
    turns = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("bigint").alias("c"), F.col(turn).alias("t"), digest.alias("digest"), F.char_length(said).alias("tokens"))
    placed = ranked(turns, ["c"], [F.col("t"), F.col("digest")], "pos")
    return placed.select("c", (F.col("pos") + 1).alias("pos"), "digest", F.col("tokens").cast("bigint").alias("tokens"))


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns and the sizes of rebuilt conversations: c, depth, size, digest, tokens; and c, size.

    A conversation begins with the first h turns of that of its hundred and goes on with its own after h.
    """
    sizes = turns.groupBy("c").agg(F.count("*").alias("own"))
    h = crc_rest("c", HEADS)
    asked = checkpointed(sizes.select("c", "own", h.alias("h"), (F.col("c") - F.col("c") % HUNDRED).alias("base")))
    bases = asked.where(F.col("c") == F.col("base")).select(F.col("c").alias("b"), F.col("own").alias("b_own"))
    # Ids are distinct here, so a base meets its own hundred only.
    taken = F.when(F.col("b_own").isNotNull(), F.least("h", "b_own")).otherwise(0)
    convs = asked.join(bases, F.col("base") == F.col("b"), "left").select("c", "h", "base", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size"))
    convs = broadcast_if_small(convs)
    heads = turns.where((F.col("pos") < HEADS) & (F.col("c") % HUNDRED == 0)).withColumnRenamed("c", "b")
    first = heads.join(convs, (F.col("b") == F.col("base")) & (F.col("pos") <= F.col("taken")))
    later = turns.join(convs.withColumnRenamed("c", "k"), (F.col("c") == F.col("k")) & (F.col("pos") > F.col("h")))
    rows = first.select("c", F.col("pos").alias("depth"), "size", "digest", "tokens").unionByName(later.select("c", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "size", "digest", "tokens"))
    return rows, convs.select("c", "size")


def prefix_nodes(rows: DataFrame) -> DataFrame:
    """c, depth, size, tokens, node, parent: the node that each turn of a conversation leads to.

    Rows are dealt by ranges of (c, depth). A conversation that began in an earlier range brings its
    sum along, which is one row for a range at most.
    """
    marks = {f"x{k}": F.xxhash64(F.lit(k), F.col("depth"), F.col("digest")) for k in (1, 2)}
    dealt = rows.withColumns(marks).drop("digest").repartitionByRange("c", "depth").withColumn("part", F.spark_partition_id())
    held = checkpointed(dealt)
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each conversation in a range, of which those that go on from an earlier range remain.
    sums = held.groupBy("c", "part").agg(*[F.bit_xor(x).alias(x) for x in marks])
    brought = sums.select(F.col("c").alias("k"), F.col("part").alias("p"), *[F.bit_xor(x).over(before).alias(f"before_{x}") for x in marks]).where("before_x1 IS NOT NULL")
    within = Window.partitionBy("c", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    running = held.select("*", *[F.bit_xor(x).over(within).alias(f"sum_{x}") for x in marks])
    joined = running.join(broadcast_if_small(brought), (F.col("c") == F.col("k")) & (F.col("part") == F.col("p")), "left")
    here = [F.col(f"sum_{x}").bitwiseXOR(F.coalesce(f"before_{x}", F.lit(0))) for x in marks]
    above = [x.bitwiseXOR(F.col(m)) for x, m in zip(here, marks)]

    def name(sums: list[Column]) -> Column:
        return F.lower(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in sums]))

    return joined.select("c", F.col("depth").cast("bigint").alias("depth"), "size", "tokens", name(here).alias("node"), F.when(F.col("depth") == 1, ROOT).otherwise(name(above)).alias("parent"))


def trie_nodes(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """node, parent, depth, owner (smallest member), n_convs, tokens, weight, n_children."""
    left = (F.col("size") - F.col("depth") + 1).alias("left")
    made = paths.select("*", left).groupBy("node").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("c").alias("owner"), F.count("*").alias("n_convs"), F.max("tokens").alias("tokens"), F.sum("left").alias("weight"))
    root = convs.agg(F.min("c").alias("owner"), F.count("*").alias("n_convs"), F.sum(F.col("size") + 1).alias("weight")).where("n_convs > 0")
    zero = F.lit(0).cast("bigint")
    root = root.select(F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), zero.alias("depth"), "owner", "n_convs", zero.alias("tokens"), "weight")
    nodes = checkpointed(made.unionByName(root))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("n_children"))
    return nodes.join(children, F.col("node") == F.col("of"), "left").drop("of").withColumn("n_children", F.coalesce("n_children", zero))


def forest_sums(parent: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums over the subtrees of a forest by centroid decomposition; a parent comes before its children, -1 for tops."""
    n = len(parent)
    children: list[list[int]] = [[] for _ in range(n)]
    size, up = [1] * n, parent.tolist()
    for i in range(n - 1, -1, -1):
        if up[i] >= 0:
            size[up[i]] += size[i]
            children[up[i]].append(i)
    gone, cuts = [False] * n, []
    tops = [i for i in range(n) if up[i] < 0]
    while tops:
        top = z = tops.pop()
        path, half = [], size[top] / 2
        while True:
            heavy = next((c for c in children[z] if not gone[c] and size[c] > half), None)
            if heavy is None:
                break
            path.append(z)
            z = heavy
        gone[z] = True
        below = [c for c in children[z] if not gone[c]]
        for v in path:
            size[v] -= size[z]
        cuts.append((z, path, below))
        tops.extend(below)
        if path:
            tops.append(top)
    sums = values.copy()
    for z, path, below in reversed(cuts):  # components after those they were split into
        if below:
            sums[z] += sums[below].sum(0)
        if path:
            sums[path] += sums[z]
    return sums


def component_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """node and the sums of the values over its subtree, from whole components (comp, node, parent, depth, values)."""
    small_batches(nodes.sparkSession)
    names = ["node", *values]

    def solved(rows: pa.Table) -> pa.RecordBatch:
        node, parent, comp = rows["node"].to_pylist(), rows["parent"].to_pylist(), rows["comp"].to_pylist()
        place = {x: i for i, x in enumerate(node)}
        up = np.array([place.get(p, -1) for p in parent], np.int64)
        up[[i for i, p in enumerate(up) if p >= 0 and comp[p] != comp[i]]] = -1
        sums = forest_sums(up, np.stack([rows[v].to_numpy() for v in values], axis=1))
        return pa.RecordBatch.from_arrays([pa.array(node, pa.string()), *[pa.array(sums[:, k]) for k in range(len(values))]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, part]) if held is not None else part
            if held.num_rows < BLOCK_WEIGHT:
                continue
            comp = held["comp"].to_numpy(zero_copy_only=False)
            cut = int(np.flatnonzero(comp != comp[-1]).max(initial=-1)) + 1  # the last component may go on
            if cut:
                yield solved(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield solved(held)

    rows = nodes.select("comp", "node", "parent", "depth", *values).repartition("comp").sortWithinPartitions("comp", "depth")
    return rows.mapInArrow(run, "node string, " + ", ".join(f"{v} bigint" for v in values))


def subtree_sums(nodes: DataFrame, paths: DataFrame, values: dict[str, Column], block_weight: int = BLOCK_WEIGHT) -> DataFrame:
    """node and the sums over its subtree.

    nodes: (node, parent, depth, owner, n_convs, weight, ...); paths: (c, depth, node, parent), the nodes of a
    conversation, from which a path to the top is read as those of its owner.
    """
    names, added = list(values), [f"add_{v}" for v in values]
    one = nodes.agg(F.min(F.when(F.col("parent").isNull(), F.col("node"))).alias("top")).first()["top"]
    now = nodes.select("node", "parent", "depth", "owner", "n_convs", "weight", F.lit(one).alias("comp"), *[v.cast("bigint").alias(n) for n, v in values.items()], *[F.lit(0).cast("bigint").alias(a) for a in added])
    done = []
    while True:
        # A written table: a checkpoint hands the constraints of its plan on, and those of many rounds grow without end.
        now = written(now, "components")[0]
        totals = now.groupBy("comp").agg(F.max("weight").alias("total"), F.min("depth").alias("top_depth"), F.count("*").alias("n")).select(F.col("comp").alias("whole"), "total", "top_depth", ((F.col("total") > block_weight) & (F.col("n") > 1)).alias("large"))
        totals = broadcast_if_small(totals)
        large = broadcast_if_small(totals.where("large"))
        # Components are small enough now, or are split below.
        done.append(now.join(totals.where("NOT large"), F.col("comp") == F.col("whole"), "left_semi"))
        if large.isEmpty():
            break
        open_ = checkpointed(now.join(large, F.col("comp") == F.col("whole")).drop("whole", "large"))
        least = F.min(F.struct("weight", "node", "depth", "owner")).alias("z")
        cut = open_.where("2 * weight > total").groupBy("comp", "top_depth").agg(least)
        cut = broadcast_if_small(cut.select(F.col("comp").alias("of"), "top_depth", F.col("z.node").alias("z"), F.col("z.depth").alias("z_depth"), F.col("z.owner").alias("z_owner"), F.col("z.weight").alias("z_weight")))
        # The child of the centroid through which a node below it is reached, if it is below it.
        placed = open_.drop("total", "top_depth").join(cut.drop("top_depth"), F.col("comp") == F.col("of"))
        way = paths.select(F.col("c").alias("w_c"), F.col("depth").alias("w_depth"), F.col("node").alias("w_node"), F.col("parent").alias("w_parent"))
        placed = placed.join(way, (F.col("depth") > F.col("z_depth")) & (F.col("owner") == F.col("w_c")) & (F.col("w_depth") == F.col("z_depth") + 1) & (F.col("w_parent") == F.col("z")), "left")
        inside = (F.col("node") == F.col("z")) | F.col("w_node").isNotNull()
        placed = checkpointed(placed.select(*now.columns, "z", inside.alias("inside"), F.when(F.col("node") == F.col("z"), F.col("node")).otherwise(F.coalesce("w_node", "comp")).alias("next")))
        sums = placed.where("inside").groupBy(F.col("z").alias("c_z")).agg(*[F.sum(v).alias(f"sum_{v}") for v in names])
        totals_of = cut.join(sums, F.col("z") == F.col("c_z"))
        # From the centroid to the top of its component.
        above = paths.select("c", "depth", F.col("node").alias("on")).unionByName(paths.select("c").distinct().select("c", F.lit(0).cast("bigint").alias("depth"), F.lit(one).alias("on")))
        path = above.join(broadcast_if_small(totals_of), (F.col("c") == F.col("z_owner")) & (F.col("depth") >= F.col("top_depth")) & (F.col("depth") < F.col("z_depth"))).select("on", "z_weight", *[f"sum_{v}" for v in names])
        moved = placed.join(path, F.col("node") == F.col("on"), "left")
        # The centroid keeps what is below it: it is a component by itself.
        own = moved.join(broadcast_if_small(sums.withColumnRenamed("c_z", "s_z").select("s_z", *[F.col(f"sum_{v}").alias(f"own_{v}") for v in names])), (F.col("node") == F.col("s_z")), "left")
        now = own.select(
            "node", "parent", "depth", "owner", "n_convs",
            F.when(F.col("node") == F.col("z"), F.col("n_convs")).otherwise(F.col("weight") - F.coalesce("z_weight", F.lit(0))).alias("weight"),
            F.col("next").alias("comp"), *names,
            *[(F.col(f"add_{v}") + F.coalesce(f"sum_{v}", F.lit(0)) + F.coalesce(F.col(f"own_{v}") - F.col(v), F.lit(0))).alias(f"add_{v}") for v in names],
        )
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    whole = checkpointed(whole)
    inside = component_sums(whole, names).select(F.col("node").alias("at"), *[F.col(v).alias(f"in_{v}") for v in names])
    return whole.join(inside, F.col("node") == F.col("at")).select("node", *[(F.col(f"in_{v}") + F.col(f"add_{v}")).alias(v) for v in names])


def list_digests(ends: DataFrame) -> DataFrame:
    """node, sha: SHA-256 of the ids (node, c) of a node, in decimal, ascending and joined by commas.

    Ids are dealt by ranges and joined to pieces; the pieces of a node are hashed one after the other
    as they stream through a task, which never holds a node's list.
    """

    def pieces(batches):
        node, ids, size = None, [], 0

        def piece():
            return pa.RecordBatch.from_arrays([pa.array([node], pa.string()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())], names=["node", "first", "piece"])

        for batch in batches:
            for at, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (at != node or size > PIECE_BYTES):
                    yield piece()
                    ids, size = [], 0
                node = at
                ids.append(c)
                size += 12
        if ids:
            yield piece()

    def digests(batches):
        node, state, out = None, None, []
        for batch in batches:
            for at, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if at == node:
                    state.update(b",")
                else:
                    if state:
                        out.append((node, state.hexdigest()))
                    node, state = at, hashlib.sha256()
                state.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], names=["node", "sha"])
            out = []
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], names=["node", "sha"])

    small_batches(ends.sparkSession)
    dealt = ends.select("node", F.col("c").cast("bigint").alias("c")).repartitionByRange("node", "c").sortWithinPartitions("node", "c").mapInArrow(pieces, "node string, first bigint, piece string")
    return dealt.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digests, "node string, sha string")


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_weight: int = BLOCK_WEIGHT) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    rows, convs = rebuilt_turns(checkpointed(numbered_turns(conversations, conv, turn, role, text)))
    convs, paths = checkpointed(convs), checkpointed(prefix_nodes(rows))
    nodes = checkpointed(trie_nodes(paths, convs))
    sums = subtree_sums(nodes, paths, {"n_leaves": F.col("n_children") == 0, "saved_tokens": (F.col("n_convs") - 1) * F.col("tokens")}, block_weight)
    ends = paths.where("depth = size").select("node", "c").unionByName(convs.where("size = 0").select(F.lit(ROOT).alias("node"), "c"))
    named = nodes.select(F.col("node").alias("p"), F.col("owner").alias("parent_conv_id"))
    whole = nodes.join(checkpointed(sums), "node").join(checkpointed(list_digests(ends)), "node", "left").join(named, F.col("parent") == F.col("p"), "left")
    none = F.lit(hashlib.sha256().hexdigest())
    return whole.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", none).alias("ends_sha256"))
