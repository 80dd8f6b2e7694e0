"""Exact percentiles by distributed selection.

A rank is looked for in rounds. A round counts the values of every open range in BINS bins, and only the
bin that holds the rank stays open; a bin with few values, or with one, is settled. The first
round cuts the range on a logarithmic scale, so that a long tail costs no rounds, the others evenly. Counts
are summed before the shuffle, so no task holds the values of a group, whatever share of the rows it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expr import broadcast_if_small, checkpointed, stored

#: Bins of a range in a round, and values of a range that are sorted as they are.
BINS, FEW = 1024, 4096
LARGEST = 1.7976931348623157e308


def _scale(x: Column) -> Column:
    """A number that never falls when x rises, even on a logarithmic scale on both sides of 0."""
    return F.signum(x) * F.when(x == 0, 0.0).otherwise(F.log2(F.abs(x)) + 1100)


def _place(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """The even bin of x between lo < hi; halves, so that no difference overflows."""
    share = (x / 2 - lo / 2) / (hi / 2 - lo / 2)
    return F.least(F.lit(bins - 1), F.floor(share * bins)).cast("int")


def order_statistics(values: DataFrame, ranks: DataFrame, by: Sequence[str], bins: int = BINS, few: int = FEW) -> DataFrame:
    """by, rank, value: the values of some ranks, from 0, of each group.

    values: (by, x), finite doubles, read once in each round; ranks: (by, rank), ranks that are there.
    """
    by = list(by)
    same = lambda a, b: [F.col(f"{a}{g}").eqNullSafe(F.col(f"{b}{g}")) for g in by]
    values = values.select(*[F.col(g).alias(f"v_{g}") for g in by], F.col("x"))
    spans = values.groupBy(*[F.col(f"v_{g}").alias(f"s_{g}") for g in by]).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("inside"))
    asked = ranks.select(*[F.col(g).alias(f"r_{g}") for g in by], "rank")
    zero = F.lit(0).cast("bigint")
    state = stored(asked.join(spans, same("r_", "s_") or F.lit(True)).select(*[f"r_{g}" for g in by], "rank", zero.alias("below"), "inside", "lo", "hi"))
    done, first = [], True
    while True:
        open_ = (F.col("inside") > few) & (F.col("lo") < F.col("hi"))
        done.append(state.where(~open_))
        state = state.where(open_)
        if state.isEmpty():
            break
        # A row for each range that is open: a few for each group.
        ranges = broadcast_if_small(state.select(*[F.col(f"r_{g}").alias(f"g_{g}") for g in by], "lo", "hi").distinct())
        lo, hi = F.col("lo"), F.col("hi")
        even = _place(F.col("x"), lo, hi, bins)
        bin_ = F.when(_scale(lo) < _scale(hi), _place(_scale(F.col("x")), _scale(lo), _scale(hi), bins)).otherwise(even) if first else even
        inside = values.join(ranges, [*same("v_", "g_"), F.col("x") >= lo, F.col("x") <= hi])
        keys = [*[f"g_{g}" for g in by], "lo", "hi"]
        counts = inside.groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), zero)
        counts = counts.select(*[F.col(g).alias(f"c_{g}") for g in keys], "n", "least", "most", before.alias("before"))
        on = [*[F.col(f"r_{g}").eqNullSafe(F.col(f"c_g_{g}")) for g in by], lo == F.col("c_lo"), hi == F.col("c_hi"), F.col("rank") >= F.col("below") + F.col("before"), F.col("rank") < F.col("below") + F.col("before") + F.col("n")]
        state = stored(state.join(counts, on).select(*[f"r_{g}" for g in by], "rank", (F.col("below") + F.col("before")).alias("below"), F.col("n").alias("inside"), F.col("least").alias("lo"), F.col("most").alias("hi")))
        first = False
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    whole = checkpointed(whole)
    settled = whole.where("lo = hi").select(*[F.col(f"r_{g}").alias(g) for g in by], "rank", F.col("lo").alias("value"))
    # Few values of each range are sorted.
    ranges = broadcast_if_small(whole.where("lo < hi").select(*[F.col(f"r_{g}").alias(f"g_{g}") for g in by], "lo", "hi", "below").distinct())
    inside = values.join(ranges, [*same("v_", "g_"), F.col("x") >= F.col("lo"), F.col("x") <= F.col("hi")])
    placed = inside.withColumn("at", F.col("below") + F.row_number().over(Window.partitionBy(*[f"g_{g}" for g in by], "lo", "hi").orderBy("x")) - 1)
    wanted = whole.where("lo < hi").select(*[f"r_{g}" for g in by], "rank")
    found = placed.join(wanted, [*same("r_", "g_"), F.col("rank") == F.col("at")]).select(*[F.col(f"r_{g}").alias(g) for g in by], "rank", F.col("x").alias("value"))
    return settled.unionByName(found)


def percentiles(df: DataFrame, col: str, shares: dict[str, float], by: Sequence[str] = (), bins: int = BINS, few: int = FEW) -> DataFrame:
    """by and a column for each named share: the percentile between the two nearest values of a group.

    Null and NaN do not count, infinities count as the largest doubles; without values there is no row.
    """
    by = list(by)
    x = F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.col(col).cast("double")))
    values = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))).select(*by, x.alias("x"))
    sizes = values.groupBy(*by).agg(F.count("*").alias("n")).where("n > 0")
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(float(q)) * (F.col("n") - 1)).alias("at")) for name, q in shares.items()]))
    wanted = checkpointed(sizes.select(*by, each.alias("q")).select(*by, "q.name", "q.at", F.floor("q.at").alias("low"), F.ceil("q.at").alias("high")))
    ranks = wanted.select(*by, F.col("low").alias("rank")).unionByName(wanted.select(*by, F.col("high").alias("rank"))).distinct()
    found = checkpointed(order_statistics(values, ranks, by, bins, few))

    def named(side: str) -> tuple[DataFrame, Column]:
        own = found.select(*[F.col(g).alias(f"{side}_{g}") for g in by], F.col("rank").alias(f"{side}_rank"), F.col("value").alias(f"{side}_value"))
        on = F.col(side) == F.col(f"{side}_rank")
        for g in by:
            on = on & F.col(g).eqNullSafe(F.col(f"{side}_{g}"))
        return own, on

    joined = wanted.join(*named("low")).join(*named("high"))
    value = F.col("low_value") + (F.col("high_value") - F.col("low_value")) * (F.col("at") - F.col("low"))
    return joined.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, value)).alias(name) for name in shares])
