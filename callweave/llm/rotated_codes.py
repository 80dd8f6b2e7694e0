"""Nearest neighbours by inner product: randomly rotated one-bit codes, error bounds, and reranking.

Vectors are dealt to clusters around centres fitted on a bounded sample. In its cluster a vector is
kept as the signs of its rotated offset from the centre, packed to bits, with two scalars: the
length of the offset, and the inner product of the offset's direction with its own code. Of a query
the rotated vector is exact. With signs s, code b = s / sqrt(d), offset length r and correction k,

    <query, vector> is estimated as <query, centre> + r * <rotated query, b> / k,

and is off by more than SPREAD * r * |query| * sqrt(1 / k^2 - 1) / sqrt(d - 1) for very few pairs, since
the rotation is random (a bound for the worst case would be sqrt(d - 1) times as wide). Vectors
whose upper bound reaches the best lower bounds seen so far are reranked by
inner products in double precision; all others are left out.

A query first searches a part of its own cluster, which gives the score that a further
neighbour must reach. Then it visits every part of a cluster whose largest possible inner product,
that with the centre plus |query| times the cluster's radius, reaches this score. All vectors are indexed and
no cluster is skipped by number. Clusters of any size are cut into parts of about PART_ROWS
vectors, and queries into groups, so that a task holds one part and one group.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part,
nor do rows without an id; vectors meet those of equal length only; repeated ids and repeated vectors are
rows of their own, and equal scores go to the smaller id; with fewer candidates than k all
are returned; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import broadcast_if_small
from .common import checkpointed, small_batches

K, EVERY = 20, 20
#: Rows on which the centres of a length are fitted at most, the centres, and the rounds of the fit.
SAMPLE_ROWS, CENTRES, ROUNDS = 4096, 32, 8
#: Vectors of a part of a cluster, queries of a group, and pairs estimated together.
PART_ROWS, GROUP_QUERIES, PAIRS_AT_ONCE = 8192, 2048, 1 << 20
#: Standard deviations of the estimate that its bound takes.
SPREAD, SEED = 3.0, 7


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    """A random rotation, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([seed, size]).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """row, id, x (doubles), dim of the vectors that take part."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("x", lambda v: v != 0)
    return df.where(F.col(id_col).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), x.alias("x")).where("x IS NOT NULL").where(fine).withColumn("dim", F.size("x"))


def fit_centres(vectors: DataFrame, sample_rows: int = SAMPLE_ROWS, centres: int = CENTRES) -> dict[int, np.ndarray]:
    """Centres of the vectors of each length, from sample_rows of them at most, drawn by a hash of the row."""
    per = Window.partitionBy("dim").orderBy(F.xxhash64("row"), "row")
    counts = {r["dim"]: r["count"] for r in vectors.groupBy("dim").count().collect()}
    share = F.lit(0.0)
    for dim, n in counts.items():
        share = F.when(F.col("dim") == dim, min(1.0, 2.0 * sample_rows / n)).otherwise(share)
    # About twice the sample is sorted, never the table.
    drawn = vectors.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < share * (1 << 30))
    rows = drawn.withColumn("n", F.row_number().over(per)).where(F.col("n") <= sample_rows).select("dim", "x").collect()
    fitted = {}
    for dim in sorted(counts):
        x = np.array([r["x"] for r in rows if r["dim"] == dim], np.float64).reshape(-1, dim)
        x = np.unique(x, axis=0)
        if not len(x):
            fitted[dim] = np.zeros((1, dim))
            continue
        size = max(1, min(centres, len(x) // 16))
        at = x[np.random.default_rng(SEED).permutation(len(x))[:size]]
        for _ in range(ROUNDS):
            own = (x @ at.T - (at * at).sum(1) / 2).argmax(1)
            for c in np.unique(own):
                at[c] = x[own == c].mean(0)
        fitted[dim] = at
    return fitted


def offsets(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cluster of each vector, its offset from the centre and the offset's length."""
    own = (x @ at.T - (at * at).sum(1) / 2).argmax(1)
    apart = x - at[own]
    return own, apart, np.sqrt((apart * apart).sum(1))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def encode(vectors: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """row, id, dim, cluster, bits, radius, fit, x: the index, a row for each vector."""
    held = vectors.sparkSession.sparkContext.broadcast(centres)  # a bounded number of centres

    def run(batches):
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = matrix(part.column(2))
                own, apart, radius = offsets(x, held.value[int(dim)])
                turned = apart @ rotation(int(dim)).T
                # The offset's direction times its code; a vector at the centre needs no estimate.
                fit = np.where(radius > 0, np.abs(turned).sum(1) / (np.sqrt(dim) * np.where(radius > 0, radius, 1)), 1.0)
                bits = np.packbits(turned > 0, axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(own, pa.int32()), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(radius), pa.array(fit), part.column(2)], names=["row", "id", "dim", "cluster", "bits", "radius", "fit", "x"])

    return vectors.select("row", "id", "x", "dim").mapInArrow(run, "row bigint, id bigint, dim int, cluster int, bits binary, radius double, fit double, x array<double>")


def nearest_in_part(index: pa.Table, queries: pa.Table, centre: np.ndarray, k: int, spread: float = SPREAD) -> tuple[np.ndarray, ...]:
    """(query row, rank, vector row, score) of each query's k best in a part, those that reach its floor."""
    x, q, dim = matrix(index["x"]), matrix(queries["q"]), len(centre)
    ids, rows, asked = index["id"].to_numpy(), index["row"].to_numpy(), queries["q_row"].to_numpy()
    floor = queries["floor"].to_numpy()
    bits = np.frombuffer(b"".join(index["bits"].to_pylist()), np.uint8).reshape(len(x), -1)
    code = np.where(np.unpackbits(bits, axis=1, count=dim), np.float32(1), np.float32(-1)) / np.float32(np.sqrt(dim))
    radius, fit = index["radius"].to_numpy(), index["fit"].to_numpy()
    turned, base, length = (q @ rotation(dim).T).astype(np.float32), q @ centre, np.sqrt((q * q).sum(1))
    scale = radius / fit
    slack = spread * radius * np.sqrt(np.maximum(1 / fit**2 - 1, 0)) / np.sqrt(max(dim - 1, 1))
    if dim == 1:
        slack = slack + radius  # one sign says nothing of a bound
    out = []
    step = max(1, PAIRS_AT_ONCE // max(1, len(x)))
    for s in range(0, len(q), step):
        guess = base[s : s + step, None] + (turned[s : s + step] @ code.T) * scale
        wide = length[s : s + step, None] * slack + 1e-6 * (np.abs(base[s : s + step, None]) + length[s : s + step, None] * radius)
        own = rows[None, :] == asked[s : s + step, None]
        low = np.where(own, -np.inf, guess - wide)
        least = floor[s : s + step]
        if len(x) > k:
            least = np.maximum(least, np.partition(low, len(x) - k, axis=1)[:, len(x) - k])
        chosen = ~(guess + wide < least[:, None]) & ~own  # where doubles overflow, nothing is left out
        for i in range(len(chosen)):
            at = np.flatnonzero(chosen[i])
            # Components are added from the first to the last, so that equal vectors have equal scores.
            score = np.cumsum(x[at] * q[s + i], axis=1)[:, -1] if len(at) else np.zeros(0)
            good = ~(score < floor[s + i])
            at, score = at[good], score[good]
            best = np.lexsort((rows[at], ids[at], -score))[:k]
            out.append((np.full(len(best), asked[s + i]), np.arange(len(best)), at[best], score[best]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate([o[c] for o in out]) for c in range(4))


def search_parts(index: DataFrame, visits: DataFrame, centres: dict[int, np.ndarray], groups: int, k: int) -> DataFrame:
    """q_row, row, id, score: the k best of each query in each part that it visits.

    index has dim, cluster, part; visits (dim, cluster, part, q_row, q, floor) go to `groups` groups.
    """
    held = index.sparkSession.sparkContext.broadcast(centres)
    schema = "q_row bigint, row bigint, id bigint, score double"

    def run(key, own: pa.Table, asked: pa.Table) -> pa.Table:
        if own.num_rows and asked.num_rows:
            q, _, at, score = nearest_in_part(own, asked, held.value[key[0].as_py()][key[1].as_py()], k)
        else:
            q, at, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return pa.table({"q_row": pa.array(q, pa.int64()), "row": own["row"].to_numpy()[at], "id": own["id"].to_numpy()[at], "score": pa.array(score, pa.float64())})

    vectors = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = visits.select(*[F.col(c).alias(f"v_{c}") for c in ("dim", "cluster", "part")], F.pmod(F.xxhash64("q_row"), F.lit(groups)).cast("int").alias("v_group"), "q_row", "q", "floor")
    return vectors.groupBy("dim", "cluster", "part", "group").cogroup(asked.groupBy("v_dim", "v_cluster", "v_part", "v_group")).applyInArrow(run, schema)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """Adds rank, from 1, and keeps the k best of a query."""
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_vectors(df: DataFrame, queries: Column | None = None, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS, centres: int = CENTRES, part_rows: int = PART_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of largest inner product with each query, itself left out.

    queries: a condition on `id` that chooses the rows that ask; every twentieth id unless given.
    """
    small_batches(df.sparkSession)
    vectors = checkpointed(usable(df, id_col, vector_col))
    fitted = fit_centres(vectors, sample_rows, centres)
    index = checkpointed(encode(vectors, fitted))
    # A row for each cluster: as many as centres and lengths.
    clusters = checkpointed(index.groupBy("dim", "cluster").agg(F.max("radius").alias("reach"), F.ceil(F.count("*") / part_rows).cast("int").alias("parts")))
    dealt = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    index = index.join(F.broadcast(clusters.select("dim", "cluster", "parts")), ["dim", "cluster"]).withColumn("part", dealt).drop("parts")
    chosen = F.pmod(F.col("id"), F.lit(EVERY)) == 0 if queries is None else queries
    asking = checkpointed(index.where(chosen).select("dim", "cluster", "part", F.col("row").alias("q_row"), F.col("id").alias("q_id"), F.col("x").alias("q")))
    groups = max(1, -(-asking.count() // GROUP_QUERIES))
    home = checkpointed(best_of(search_parts(index, asking.withColumn("floor", F.lit(float("-inf"))), fitted, groups, k), k))
    floors = home.where(F.col("rank") == k).select(F.col("q_row").alias("f_row"), F.col("score").alias("f_score"))
    floored = asking.join(floors, F.col("q_row") == F.col("f_row"), "left").select("q_row", "q", F.coalesce("f_score", F.lit(float("-inf"))).alias("floor"), F.col("dim").alias("h_dim"), F.col("cluster").alias("h_cluster"), F.col("part").alias("h_part"))
    means = df.sparkSession.createDataFrame([(d, c, [float(v) for v in row]) for d, at in fitted.items() for c, row in enumerate(at)], "dim int, cluster int, centre array<double>")
    reach = F.broadcast(clusters.join(means, ["dim", "cluster"]))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    length = F.sqrt(dot("q", "q"))
    most = dot("q", "centre") + length * F.col("reach")
    margin = 1e-9 * (F.abs(dot("q", "centre")) + length * F.col("reach"))
    passing = floored.join(reach, F.col("h_dim") == F.col("dim")).where(most + margin >= F.col("floor"))
    visits = passing.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("NOT (cluster = h_cluster AND part = h_part)")
    further = search_parts(index, visits.select("dim", "cluster", "part", "q_row", "q", "floor"), fitted, groups, k)
    best = best_of(home.drop("rank").unionByName(further), k)
    named = asking.select(F.col("q_row").alias("n_row"), "q_id")
    return best.join(named, F.col("q_row") == F.col("n_row")).select(F.col("q_id").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
