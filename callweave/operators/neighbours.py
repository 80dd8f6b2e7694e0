"""Exact nearest neighbours within classes, without comparing all pairs.

The rows of a class are dealt to cells by their nearest pivot. By the triangle inequality no row of a cell is nearer to
a point than the point's distance to the pivot less the cell's radius. A row first searches a part of its own cell,
which gives the distance that a further neighbour must not exceed, and then only the cells that can hold one. On
clustered rows most cells are skipped; where none can be, all are searched, and the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import checkpointed

#: Pivots of a class at most; rows that ask in one group of a search.
MOST_PIVOTS, GROUP_ROWS = 1024, 20_000
#: What rounding may take from a bound.
SLACK = 1e-7


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of y."""
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0)


def _search(part: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """label, key, gap, other: the k nearest in one part of a cell, ties by key, the row itself left out."""

    def nearest(given: pa.Table, asked: pa.Table) -> pa.Table:
        keys, gaps, others = [], [np.zeros(0)], []
        if given.num_rows and asked.num_rows:
            given = given.sort_by("key")
            x, y = (np.array(t["features"].to_pylist(), np.float64) for t in (asked, given))
            mine, theirs = asked["q_key"].to_pylist(), given["key"].to_pylist()
            place = {key: i for i, key in enumerate(theirs)}
            own = np.array([place.get(key, -1) for key in mine])
            for s in range(0, len(x), 512):
                self = own[s : s + 512]
                gap = distances(x[s : s + 512], y)
                gap[np.flatnonzero(self >= 0), self[self >= 0]] = np.inf
                at = np.argsort(gap, axis=1, kind="stable")[:, :k]
                row, column = np.nonzero(np.isfinite(np.take_along_axis(gap, at, 1)))
                found = at[row, column]
                keys += [mine[s + i] for i in row.tolist()]
                others += [theirs[i] for i in found.tolist()]
                gaps.append(gap[row, found])
        label = given["label"][0].as_py() if keys else 0
        return pa.table({"label": pa.array([label] * len(keys), pa.int32()), "key": pa.array(keys, pa.string()), "gap": pa.array(np.concatenate(gaps)), "other": pa.array(others, pa.string())})

    theirs = asking.select(*[F.col(c).alias(f"q_{c}") for c in ("label", "cell", "part", "group", "key")], F.col("features"))
    return part.groupBy("label", "cell", "part", "group").cogroup(theirs.groupBy("q_label", "q_cell", "q_part", "q_group")).applyInArrow(nearest, "label int, key string, gap double, other string")


def nearest_in_class(rows: DataFrame, k: int, block: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(near, visits). near: label, key, near (array of gap, other), the k nearest rows of the class of each row that asks.

    rows: label, key, features (array), at (place in the class, from 0, at random), n (its size), asks. Keys are unique.
    visits: label, key, cell, part of all searches beyond the row's own part.
    """
    cells = F.least(F.lit(MOST_PIVOTS), F.ceil(F.col("n") / block))
    chosen = rows.where(F.col("at") < cells).select("label", "at", "features").orderBy("label", "at").collect()
    pivots: dict[int, np.ndarray] = {}
    for label in {r["label"] for r in chosen}:
        pivots[label] = np.array([r["features"] for r in chosen if r["label"] == label], np.float64)
    held = rows.sparkSession.sparkContext.broadcast(pivots)  # a bounded number for each class

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, x = batch.column(0).to_numpy(), batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cell, off = np.zeros(len(label), np.int32), np.zeros(len(label))
            for value in np.unique(label).tolist():
                mine = np.flatnonzero(label == value)
                for s in range(0, len(mine), 1024):
                    at = mine[s : s + 1024]
                    gap = distances(x[at], held.value[value])
                    cell[at], off[at] = gap.argmin(1), np.sqrt(gap.min(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(off)], names=[*batch.schema.names, "cell", "off"])

    placed = checkpointed(rows.select("label", "key", "features", "asks").mapInArrow(place, "label int, key string, features array<double>, asks boolean, cell int, off double"))
    sizes = checkpointed(placed.groupBy("label", "cell").agg(F.max("off").alias("radius"), F.ceil(F.count("*") / block).cast("int").alias("parts")))
    balls = {(r["label"], r["cell"]): r["radius"] for r in sizes.collect()}  # no more than there are pivots
    # A cell of any number of rows is searched in parts.
    dealt = placed.join(F.broadcast(sizes.select("label", "cell", "parts")), ["label", "cell"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    dealt = checkpointed(dealt.drop("parts", "off"))
    asking = dealt.where("asks")
    groups = max(1, -(-asking.count() // GROUP_ROWS))
    asking = checkpointed(asking.withColumn("group", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(groups)).cast("int")))
    given = dealt.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    home = checkpointed(_search(given, asking, k))
    reach = home.groupBy("label", "key").agg(F.count("*").alias("found"), F.max("gap").alias("most")).where(F.col("found") >= k)
    limited = asking.join(reach.select(F.col("label").alias("r_label"), F.col("key").alias("r_key"), "most"), (F.col("label") == F.col("r_label")) & (F.col("key") == F.col("r_key")), "left")

    @F.pandas_udf("array<int>")
    def within(label: pd.Series, features: pd.Series, most: pd.Series) -> pd.Series:
        x, limit = np.stack(features.to_numpy()), np.sqrt(np.where(np.isnan(most.to_numpy(np.float64)), np.inf, most.to_numpy(np.float64)))
        out = []
        for i, value in enumerate(label.to_numpy()):
            gap = np.sqrt(distances(x[i : i + 1], held.value[value])[0])
            out.append([c for c in range(len(gap)) if (value, c) in balls and gap[c] - balls[value, c] <= limit[i] + SLACK * (1 + gap[c])])
        return pd.Series(out)

    each = limited.withColumn("to", F.explode(within("label", "features", "most")))
    parts = F.broadcast(sizes.select(F.col("label").alias("s_label"), F.col("cell").alias("s_cell"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("to_part")))
    each = each.join(parts, (F.col("label") == F.col("s_label")) & (F.col("to") == F.col("s_cell")))
    visits = checkpointed(each.where("NOT (to = cell AND to_part = part)").select("label", "key", "features", "group", F.col("to").alias("cell"), F.col("to_part").alias("part")))
    whole = home.unionByName(_search(given, visits, k))
    order = Window.partitionBy("label", "key").orderBy("gap", "other")
    kept = whole.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    near = kept.groupBy("label", "key").agg(F.array_sort(F.collect_list(F.struct("gap", "other"))).alias("near"))
    return near, visits.select("label", "key", "cell", "part")
