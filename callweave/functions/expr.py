"""Column expressions that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .constants import CLASSES


def argmax(probs: Column) -> Column:
    """The id of the first largest element."""
    # The array is named once, so that what computes it is not repeated in the plan.
    return (-F.array_max(F.transform(probs, lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))["i"]).cast("int")


def class_name(class_id: Column) -> Column:
    """The name of a class id; null for other ids."""
    return F.get(F.array(*[F.lit(c) for c in CLASSES]), class_id.cast("int"))


def class_id(name: Column) -> Column:
    """The id of a class name; -1 for other names."""
    return F.coalesce(F.array_position(F.array(*[F.lit(c) for c in CLASSES]), name).cast("int") - 1, F.lit(-1))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as a double, 0 where bottom is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top.cast("double") / F.when(bottom != 0, bottom))


#: The characters that Unicode counts as white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Text without Unicode white space at both ends."""
    return F.btrim(text, F.lit(WHITE))


def words(text: Column) -> Column:
    """The runs of characters between Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def seeded(seed, *keys: Column) -> Column:
    """A hex string that orders rows at random, the same for the same seed and keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def seeded_int(seed, *keys: Column) -> Column:
    """The leading 32 bits of seeded() as an integer."""
    return F.conv(F.substring(seeded(seed, *keys), 1, 8), 16, 10).cast("bigint")


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def own_prefix(columns: list[str]) -> str:
    """A prefix for columns that an operator adds for itself, which none of the given columns has."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def vector_of(scores: list[Column]) -> Column:
    """Scores as one vector: a missing one counts 0, and a vector without any score is null."""
    doubles = [s.cast("double") for s in scores]
    return F.when(F.coalesce(*doubles).isNotNull(), F.array(*[F.coalesce(d, F.lit(0.0)) for d in doubles]))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names.

    Only a local session that names none gets one of its own; on a cluster this is an error, since
    executors would not see each other's files.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def round_binary(x: Column, places: int) -> Column:
    """x to a few places by the value that the double holds, ties to even, as C and Python round.

    bround rounds the shortest decimal of a double: it takes 8.1225, which lies above that decimal, down.
    A double of 24 bits and what is left of x, both times 2 * 10^places, are exact, and so is their
    sum's side of the middle between two results. From 10^12 on x stays as it is.
    """
    step = float(10**places)
    high = x.cast("float").cast("double")
    below = F.floor(x * step).cast("double")
    beyond = (high * (2 * step) - (2 * below + 1)) + (x - high) * (2 * step)
    up = (beyond > 0) | ((beyond == 0) & (F.abs(below) % 2 == 1))
    return F.when(F.abs(x) < 1e12, (below + up.cast("double")) / step).otherwise(x)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in that folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a table in that folder, read again.

    For loops: a checkpoint hands on the constraints of its plan, and those of many rounds grow without end.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df, written first, with a hint to broadcast it if it has at most so many rows."""
    held = checkpointed(df)
    return F.broadcast(held) if held.count() <= rows else held


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str = "rank", size: str | None = None) -> DataFrame:
    """Adds the position, from 0, of each row in its group, however large the group is; and the group's size, if named.

    Rows are dealt by range of (group, order); a row's position is its position within its
    range plus the sizes of the ranges before. The dealt rows are written whole, since rows have no
    key by which a written position could be joined back to them.
    """
    p = own_prefix(df.columns)
    part, n, at = f"{p}part", f"{p}n", f"{p}inside"
    keys = {f"{p}o{i}": o for i, o in enumerate(order)}
    dealt = df.withColumns(keys).repartitionByRange(*[F.col(c) for c in [*group, *keys]])
    parts = checkpointed(dealt.withColumn(part, F.spark_partition_id()))
    within = F.row_number().over(Window.partitionBy(*group, part).orderBy(*keys)) - 1
    sizes = parts.groupBy(*group, part).agg(F.count("*").alias(n))
    before = F.coalesce(F.sum(n).over(Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum(n).over(Window.partitionBy(*group))
    # A row for each group and range in which it lies: few, unless groups are.
    offsets = broadcast_if_small(sizes.select(*[F.col(g).alias(f"{p}g{i}") for i, g in enumerate(group)], F.col(part).alias(f"{p}p"), before.alias(f"{p}before"), whole.alias(f"{p}size")))
    on = (F.col(part) == F.col(f"{p}p"))
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"{p}g{i}"))
    inside = parts.withColumn(at, within)
    return inside.join(offsets, on).select(*df.columns, (F.col(at) + F.col(f"{p}before")).alias(name), *[F.col(f"{p}size").alias(s) for s in (size,) if s])
