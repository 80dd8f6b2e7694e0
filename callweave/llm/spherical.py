"""Embedding near-dedup with spherical-cap filters.

The filter directions are random product codes: a seeded rotation, and a code of random
directions on each half of the rotated vector; a filter is a pair of directions. A vector is
list-decoded to all filters whose cap it lies in, that is whose inner product exceeds a
bound: only directions of the first half that any of the second can still lift over the
bound are looked at. Vectors are joined on shared filters and compared in double precision.

Codes grow with the number of vectors, so that a filter holds about TARGET random vectors:
twice the directions make four times the filters, and each vector then lies in GROWTH times as
many, which keeps the share of pairs that are found. Measured on random vectors of 64
components, of the pairs of cosine 0.90 this share is 99.7, 99.7 and 99.7 % with codes of 64,
128 and 256 directions. The bound is set for each length of vectors so that a random vector
lies in so many filters on average; one in fewer than LEAST caps gets the LEAST nearest instead.

What is joined on filters is small: an id and a sketch of SKETCH sign bits. Only members of a
bucket whose sketch is near another's there are sent their vector and filters, and are
verified. Sign bits of two vectors of cosine c differ with probability arccos(c) / pi each; pairs
that differ in SLACK standard deviations more than at the threshold are not verified.

A link is counted in the smallest filter that its two vectors share, so that links are
counted once though no pair is ever a row.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components,
link with nothing; vectors of different length do not link; equal vectors are one
class and link with each other; ids that repeat are judged row by row, and a null id
names no component; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import checkpointed, small_batches
from .links import SMALL_GROUP, bucket_blocks, component_minima, components, join_labels, map_blocks, small_pairs

THRESHOLD = 0.9
ROTATIONS, CODE, FILTERS, GROWTH, TARGET, LEAST, SEED = 16, 64, 27, 1.45, 256, 8, 20240
SKETCH, SLACK = 256, 6.0
#: Members of a part of a bucket; what a block holds of its members is not small.
PART_ROWS = 256
#: Bits of the number of a filter in a bucket; the length of the vectors stands above them.
FILTER_BITS = 40
#: Vectors that are decoded together, and probes that set the bound.
TOGETHER, PROBES = 2048, 64


def code_size(count: int) -> tuple[int, float]:
    """Directions on each half, and filters of a vector, for so many vectors."""
    code, filters = CODE, float(FILTERS)
    while count * filters > TARGET * ROTATIONS * code * code:
        code, filters = 2 * code, GROWTH * filters
    return code, filters


class Codes:
    """Rotations, directions scaled by sqrt(dim / 2), and the bound, for vectors of one length."""

    def __init__(self, dim: int, code: int = CODE, filters: float = FILTERS):
        random, half = np.random.default_rng([SEED, dim]), dim - dim // 2
        self.code, self.turns = code, []
        for _ in range(ROTATIONS):
            turn, _ = np.linalg.qr(random.normal(size=(dim, dim)))
            halves = [random.normal(size=(code, n)) for n in (half, dim // 2)]
            scaled = [h * np.sqrt(dim / 2) / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-300) for h in halves]
            # Short halves repeat directions.
            self.turns.append((turn.astype(np.float32), *[np.unique(h.round(9), axis=0).astype(np.float32) for h in scaled]))
        self.signs = random.normal(size=(dim, SKETCH)).astype(np.float32)
        probes = unit(random.normal(size=(max(4, PROBES * CODE // code), dim))).astype(np.float32)
        sorted_halves = [(one.ravel(), np.sort(two, 1)) for one, two in (self.products(probes, k) for k in range(ROTATIONS))]
        wanted = min(filters, sum(len(a) * len(b) for _, a, b in self.turns)) * len(probes)
        low, high = -float(dim) - 1, float(dim) + 1
        for _ in range(40):  # the largest bound that as many filters as wanted exceed
            self.bound = (low + high) / 2
            if self.exceeding(sorted_halves) >= wanted:
                low = self.bound
            else:
                high = self.bound
        self.bound = low

    def products(self, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Inner products with the directions of both halves of a rotation."""
        turn, first, second = self.turns[k]
        turned = vectors @ turn
        return turned[:, : first.shape[1]] @ first.T, turned[:, first.shape[1] :] @ second.T

    def exceeding(self, sorted_halves) -> int:
        found = 0
        for one, two in sorted_halves:
            one = one.reshape(len(two), -1)
            for a, b in zip(one, two):
                found += len(a) * len(b) - int(np.searchsorted(b, self.bound - a).sum())
        return found

    def decode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every unit vector, ascending."""
        rows, filters, code = [], [], self.code
        for k in range(ROTATIONS):
            one, two = self.products(vectors, k)
            at, i = np.nonzero(one >= self.bound - two.max(1, keepdims=True))
            which, j = np.nonzero(two[at] >= self.bound - one[at, i][:, None])
            rows.append(at[which])
            filters.append((k * code + i[which]) * code + j)
        row, found = np.concatenate(rows), np.concatenate(filters)
        few = np.flatnonzero(np.bincount(row, minlength=len(vectors)) < LEAST)
        if len(few):  # such vectors are rare
            best = [self.nearest(v[None]) for v in vectors[few]]
            enough = ~np.isin(row, few)
            row = np.concatenate([row[enough], np.repeat(few, [len(b) for b in best])])
            found = np.concatenate([found[enough], *best])
        order = np.lexsort((found, row))
        return row[order], found[order]

    def nearest(self, vector: np.ndarray) -> np.ndarray:
        """The LEAST nearest filters: they pair directions among the LEAST best of each half."""
        names, values = [], []
        for k in range(ROTATIONS):
            one, two = (p[0] for p in self.products(vector, k))
            i, j = (np.argsort(-p, kind="stable")[:LEAST] for p in (one, two))
            values.append((one[i][:, None] + two[j]).ravel())
            names.append(((k * self.code + i)[:, None] * self.code + j).ravel())
        return np.concatenate(names)[np.argsort(-np.concatenate(values), kind="stable")[:LEAST]]

    def sketches(self, vectors: np.ndarray) -> np.ndarray:
        return np.packbits(vectors @ self.signs > 0, axis=1)


def sketch_radius(threshold: float) -> int:
    """The sign bits in which two vectors at the threshold may differ."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return math.ceil(SKETCH * p + SLACK * math.sqrt(SKETCH * p * (1 - p)))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; large and small components are scaled first."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def bytes_column(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and where each row's begin; one more for the end."""
    held = column.combine_chunks()
    step = np.dtype(kind).itemsize
    at = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1] // step
    return np.frombuffer(held.buffers()[2] or b"", kind), at


def with_filters(classes: DataFrame, code: int, filters: float, kind: str) -> DataFrame:
    """node, hash, rep, n; v as bytes; buckets, one for each filter; filters and sketch as bytes."""
    small_batches(classes.sparkSession)

    def decoded(rows: pa.Table, codes: dict) -> pa.RecordBatch:
        lists = rows["v"].combine_chunks()
        flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        size = np.diff(at)
        packed, buckets, held, sketches = ([b""] * len(size) for _ in range(4))
        for dim in np.unique(size).tolist():
            own = np.flatnonzero(size == dim)
            vectors = flat[at[own][:, None] + np.arange(dim)]
            if dim not in codes:
                codes[dim] = Codes(dim, code, filters)
            units = unit(vectors.astype(np.float64)).astype(np.float32)
            row, found = codes[dim].decode(units)
            cuts = np.cumsum(np.bincount(row, minlength=len(own)))[:-1]
            for k, v, f, s in zip(own.tolist(), vectors.astype(kind), np.split(found, cuts), codes[dim].sketches(units)):
                packed[k], buckets[k], held[k], sketches[k] = v.tobytes(), f + (dim << FILTER_BITS), f.astype("<i8").tobytes(), s.tobytes()
        columns = [rows[c].combine_chunks() for c in ("node", "hash", "rep", "n")]
        made = [pa.array(packed, pa.binary()), pa.array(buckets, pa.list_(pa.int64())), pa.array(held, pa.binary()), pa.array(sketches, pa.binary())]
        return pa.RecordBatch.from_arrays(columns + made, names=["node", "hash", "rep", "n", "v", "buckets", "filters", "sketch"])

    def run(batches):
        codes: dict[int, Codes] = {}
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= TOGETHER:
                yield decoded(pa.Table.from_batches(held), codes)
                held, size = [], 0
        if size:
            yield decoded(pa.Table.from_batches(held), codes)

    rep = classes.schema["rep"].dataType.simpleString()
    rows = classes.select(F.monotonically_increasing_id().alias("node"), "hash", "rep", "n", "v")
    return rows.mapInArrow(run, f"node bigint, hash string, rep {rep}, n bigint, v binary, buckets array<bigint>, filters binary, sketch binary")


def near_in_bucket(keys: DataFrame, threshold: float) -> DataFrame:
    """node, bucket, a, b, part: the members of blocks whose sketch is near another's in the block."""
    radius = sketch_radius(threshold)

    def near(rows: pa.Table, starts: np.ndarray):
        n, words = rows.num_rows, SKETCH // 64
        sketch = bytes_column(rows["sketch"], "<u8")[0].reshape(n, words)
        part, split = rows["part"].to_numpy(), rows["a"].to_numpy() != rows["b"].to_numpy()
        close = np.zeros(n, bool)
        sizes = np.diff(starts, append=n)
        for i, j in small_pairs(starts, sizes):
            ok = ~split[i] | (part[i] != part[j])
            i, j = i[ok], j[ok]
            both = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1, dtype=np.int64) <= radius
            close[i[both]] = True
            close[j[both]] = True
        for s, size in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP]):
            own = np.arange(s, s + size)
            for k in range(0, size, 64):
                some = own[k : k + 64]
                differ = np.zeros((len(some), size), np.int16)
                for w in range(words):
                    differ += np.bitwise_count(sketch[some, w][:, None] ^ sketch[own, w])
                both = (differ <= radius) & (some[:, None] != own)
                if split[s]:
                    both &= part[some][:, None] != part[own]
                close[some] |= both.any(1)
        found = rows.select(["node", "bucket", "a", "b", "part"]).filter(pa.array(close))
        yield from found.to_batches()

    return map_blocks(bucket_blocks(keys, PART_ROWS), near, "node bigint, bucket bigint, a int, b int, part int")


def linked_vectors(members: DataFrame, threshold: float, kind: str) -> DataFrame:
    """node, links, root: links of a class that its block counts, and a class it is joined to."""

    def links(rows: pa.Table, starts: np.ndarray):
        n = rows.num_rows
        part, split = rows["part"].to_numpy(), rows["a"].to_numpy() != rows["b"].to_numpy()
        weight, filter_here = rows["n"].to_numpy(), rows["bucket"].to_numpy() & ((1 << FILTER_BITS) - 1)
        flat, at = bytes_column(rows["v"], kind)
        held, held_at = bytes_column(rows["filters"], "<i8")
        width = np.diff(at)
        counted, label = np.zeros(n, np.int64), np.arange(n)
        sets: dict[int, frozenset] = {}

        def filters_of(row):
            found = sets.get(row)
            if found is None:
                found = sets[row] = frozenset(held[held_at[row] : held_at[row + 1]].tolist())
            return found

        def count(i, j):
            np.add.at(counted, i, weight[j])
            np.add.at(counted, j, weight[i])

        sizes = np.diff(starts, append=n)
        units = np.zeros((n, width.max(initial=1)))
        for dim in np.unique(width):
            same = np.flatnonzero(width == dim)
            units[same, :dim] = unit(flat[at[same][:, None] + np.arange(dim)].astype(np.float64))
        for i, j in small_pairs(starts, sizes):
            ok = ~split[i] | (part[i] != part[j])
            i, j = i[ok], j[ok]
            near = np.einsum("ij,ij->i", units[i], units[j]) >= threshold
            i, j = i[near], j[near]
            join_labels(label, i, j)
            first = np.fromiter((min(filters_of(x) & filters_of(y), default=-1) for x, y in zip(i.tolist(), j.tolist())), np.int64, len(i))
            own = first == filter_here[i]
            count(i[own], j[own])
        for s, size in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP]):
            x = units[s : s + size]
            near = x @ x.T >= threshold
            if split[s]:
                near &= part[s : s + size, None] != part[None, s : s + size]
            near = np.triu(near, 1)
            some = np.flatnonzero(near.any(0) | near.any(1))
            if not len(some):
                continue
            near = near[np.ix_(some, some)]
            # Filters below this one, of vectors that have a link here: who shares one is counted there.
            owner = np.repeat(np.arange(len(some)), held_at[s + some + 1] - held_at[s + some])
            theirs = np.concatenate([held[held_at[s + k] : held_at[s + k + 1]] for k in some])
            below = theirs < filter_here[s]
            _, column = np.unique(theirs[below], return_inverse=True)
            shared = np.zeros((len(some), int(column.max(initial=-1)) + 1), np.float32)
            shared[owner[below], column] = 1
            i, j = np.nonzero(near)
            join_labels(label, s + some[i], s + some[j])
            own = near & ~(shared @ shared.T > 0)
            i, j = np.nonzero(own)
            count(s + some[i], s + some[j])
        out = (counted > 0) | (label != np.arange(n))
        node = rows["node"].to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(node[out]), pa.array(counted[out]), pa.array(node[label[out]])], names=["node", "links", "root"])

    keys = members.select("node", "sketch", F.explode("buckets").alias("bucket"))
    blocks = near_in_bucket(keys, threshold)
    return map_blocks(blocks.join(members.select("node", "n", "v", "filters"), "node"), links, "node bigint, links bigint, root bigint")


def near_vectors(table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, n_links, component_id, kept of every row."""
    given = table.schema[vector_col].dataType
    single = isinstance(given, ArrayType) and isinstance(given.elementType, FloatType)
    element, kind = ("float", "<f4") if single else ("double", "<f8")
    v = F.col(vector_col).cast(f"array<{element}>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.coalesce((F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))
    digest = F.when(usable, F.concat(F.hex(F.xxhash64(v)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), v))))
    rows = checkpointed(table.select(F.col(id_col).alias("v_id"), digest.alias("hash"), F.when(usable, v).alias("v")))
    classes = checkpointed(rows.where("hash IS NOT NULL").groupBy("hash").agg(F.min("v_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")))
    members = checkpointed(with_filters(classes, *code_size(classes.count()), kind))
    found = checkpointed(linked_vectors(members, threshold, kind))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = checkpointed(components(found.select(F.col("node").alias("src"), F.col("root").alias("dst"))))
    reps = members.select("node", "hash", "rep", "n")
    named = component_minima(reps, parts, "rep", "component_id")
    # Written first, so that the join with the rows is one that can split a frequent vector.
    per_class = checkpointed(
        reps.join(counts, "node", "left")
        .join(named, "node", "left")
        .select("hash", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    )
    joined = rows.select("v_id", "hash").join(per_class, "hash", "left")
    component = F.when(F.col("hash").isNull(), F.col("v_id")).otherwise(F.col("component_id"))
    return joined.select(F.col("v_id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("v_id").eqNullSafe(component).alias("kept"))
