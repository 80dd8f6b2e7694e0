"""Mixing sources to target weights by a low-discrepancy schedule.

1. Each source gets a target in tokens: its share of the mix by weight, at most max_repeats
   times its own size; what lies above is shared again by weight until none is above.
2. The mix is a row of slots of block_tokens tokens. Slot i has the golden-ratio point
   frac((i + 1) * phi), which the cumulative targets map to a source, so that every
   stretch of the mix holds each source in its share to within a few slots. Points are whole
   multiples modulo 2^62, distinct for any number of slots, and so are the bounds of sources.
3. The slots of a source are ranked. Slot of rank r takes block r mod n of the source, whose
   documents lie one after the other in a hashed order and are cut to blocks of equal tokens.

No rank and no running sum is taken over a whole source: rows are dealt to chunks, sums of
chunks are added up, and ranks are taken within a chunk. What one task sees whole is a row for each
source (targets, names in order), so sources are meant to be thousands or a few millions, not a
name for each document; and a row for each chunk of one source, its size over CHUNK_ROWS.

Defined cases: null texts have size 0 and are taken 0 times; a null source is a source,
which sorts last; ids that repeat are ordered by their text's hash and count one by one; long texts
are cut to blocks like others; equal rows are told apart by a row key where there is one, and take their places in
turn where not; an empty table gives an empty table; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, with_row_key

#: Tokens of a slot; the rows that one chunk may hold, about.
BLOCK_TOKENS, CHUNK_ROWS = 64, 4096
#: The golden ratio in 62 bits, odd, so that no two multiples below 2^62 are equal.
POINT_BITS = 62
PHI = 2850178704830799621
#: Bits of the hash that orders the documents of a source.
ORDER_BITS = 60
#: Equal parts of [0, 1) by which slots find their source: so many bits at least, two more than the sources have, so
#: many at most.
BIN_BITS, MOST_BIN_BITS = 10, 20


def point(slot: Column) -> Column:
    """The golden-ratio point of a slot, as a whole number below 2^62, from products of 31 bits."""
    half, low = POINT_BITS // 2, (1 << POINT_BITS // 2) - 1
    n1, n0 = F.shiftright(slot + 1, half), (slot + 1).bitwiseAND(F.lit(low))
    a1, a0 = PHI >> half, PHI & low
    upper = F.pmod(n1 * a0 + n0 * a1, F.lit(1 << half))
    return (n0 * a0 + F.shiftleft(upper, half)).bitwiseAND(F.lit((1 << POINT_BITS) - 1))


def word_count(text: Column) -> Column:
    """Runs of characters other than the six ASCII white-space characters."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint"), F.lit(0).cast("bigint"))


def source_targets(sizes: DataFrame, weights: list[float], share: float, max_repeats: float) -> DataFrame:
    """m_source, source_size, weight, target, from (m_source, source_size).

    Sources come in order of code points, null last; weights repeat along them. With the
    sources sorted by size over weight, the full ones are a prefix: a source is full when
    the weight that remains would give it more than its limit. One row is one source.
    """
    by_name, by_fill = Window.orderBy(F.col("m_source").asc_nulls_last()), Window.orderBy("fill", "place")
    ahead = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", weight)
        .withColumn("limit", max_repeats * F.col("source_size"))
        .withColumn("fill", F.col("limit") / F.col("weight"))
        .withColumn("mix", share * F.sum("source_size").over(all_rows))
        .withColumn("level", (F.col("mix") - F.coalesce(F.sum("limit").over(ahead), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("at", F.when(F.col("fill") >= F.col("level"), F.col("level")))
    )
    # The first source that is not full sets the level for it and all that follow.
    level = F.min(F.when(F.col("at").isNotNull(), F.struct("fill", "place", "level"))).over(all_rows)["level"]
    return ranked.withColumn("level", level).select("m_source", "source_size", "weight", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def running(rows: DataFrame, chunk: str, value: str, order: list) -> DataFrame:
    """Adds `before`: the sum of value over earlier rows of the same group.

    Rows are ordered by chunk, then by order. Groups come in `m_key`. A chunk is a small
    part of a group; what lies before a chunk is summed from one row per chunk.
    """
    parts = rows.groupBy("m_key", chunk).agg(F.sum(value).alias("part"))
    offset = F.coalesce(F.sum("part").over(Window.partitionBy("m_key").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("m_key").alias("o_key"), F.col(chunk).alias("o_chunk"), offset.alias("offset"))
    within = Window.partitionBy("m_key", chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("inside", F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = inside.join(parts, (inside["m_key"] == parts["o_key"]) & (inside[chunk] == parts["o_chunk"]))
    return joined.select(*rows.columns, (F.col("inside") + F.col("offset")).alias("before"))


def documents_with_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, row_col: str | None = None) -> DataFrame:
    """id, row key (0 without one), m_source, size, and the hash that shuffles the documents of a source."""
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).alias("m_id"),
        (F.col(row_col) if row_col else F.lit(0).cast("bigint")).alias("m_row"),
        F.col(source_col).cast("string").alias("m_source"),
        word_count(text).alias("size"),
        F.conv(F.substring(F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.col(source_col).cast("string"), text)), 1, ORDER_BITS // 4), 16, 10).cast("bigint").alias("order"),
    )


def mixed(docs: DataFrame, weights: list[float], share: float = 1.5, max_repeats: int = 2, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, documents, slots).

    sources: m_key, m_source, source_size, target. documents: m_id, m_row, m_key, size, first token
    `before` in the source's order. slots: slot, m_key, rank, block, epoch.
    """
    sized = checkpointed(documents_with_sizes(docs, id_col, text_col, source_col, row_col))
    sizes = sized.groupBy("m_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = source_targets(sizes.select("m_source", "source_size"), weights, share, max_repeats)
    counts = sizes.select(F.col("m_source").alias("s_source"), "n_docs")
    upper = F.sum("target").over(Window.orderBy("m_key").rowsBetween(Window.unboundedPreceding, 0))
    sources = checkpointed(
        targets.join(counts, targets["m_source"].eqNullSafe(counts["s_source"]))
        .withColumn("m_key", F.row_number().over(Window.orderBy(F.col("m_source").asc_nulls_last())))
        .withColumn("upper", upper)
        .withColumn("total", F.sum("target").over(Window.partitionBy()))
        .drop("s_source", "weight")
    )

    # Documents: token intervals in hashed order.
    keyed = sized.join(sources.select("m_key", "n_docs", F.col("m_source").alias("k_source")), F.col("m_source").eqNullSafe(F.col("k_source"))).drop("k_source")
    chunks = F.greatest(F.lit(1), F.col("n_docs") / CHUNK_ROWS).cast("bigint")
    # The leading bits of the hash name the chunk, so chunk and hash order agree.
    dealt = keyed.withColumn("chunk", F.floor(F.shiftright("order", ORDER_BITS - 32) * chunks / F.lit(2**32)))
    documents = running(dealt.select("m_id", "m_row", "m_source", "m_key", "size", "order", "chunk"), "chunk", "size", ["order", "m_id", "m_row"])

    # Slots: one row each, mapped to a source through the bins that its interval meets.
    whole = F.coalesce(F.sum("target"), F.lit(0.0)) / block_tokens
    found = sources.agg(F.ceil(F.round(whole, 6)).cast("bigint").alias("n"), F.count("*").alias("sources")).first()
    bin_bits = min(MOST_BIN_BITS, max(BIN_BITS, found["sources"].bit_length() + 2))
    spark, bin_of = docs.sparkSession, lambda p: F.shiftright(p, POINT_BITS - bin_bits).cast("int")
    slots = spark.range(found["n"]).select(F.col("id").alias("i"), point(F.col("id")).alias("u")).withColumn("bin", bin_of(F.col("u")))
    # Neighbouring spans share their bounds, since one's upper bound is the next one's lower.
    by_key = Window.orderBy("m_key")
    spans = (
        sources.where("target > 0")
        .withColumn("hi", F.when(F.lead("m_key").over(by_key).isNull(), F.lit(1 << POINT_BITS)).otherwise(F.floor(F.col("upper") / F.col("total") * F.lit(float(1 << POINT_BITS))).cast("bigint")))
        .select("m_key", "source_size", F.coalesce(F.lag("hi").over(by_key), F.lit(0).cast("bigint")).alias("lo"), "hi")
        .where("lo < hi")
        .withColumn("bin", F.explode(F.sequence(bin_of(F.col("lo")), bin_of(F.col("hi") - 1))))
    )
    placed = slots.join(spans, "bin").where("u >= lo AND u < hi")
    placed = placed.select("i", "m_key", "source_size", F.floor(F.col("i") / CHUNK_ROWS).alias("chunk"), F.lit(1).cast("bigint").alias("one"))
    ranked = running(placed, "chunk", "one", ["i"])
    blocks = F.ceil(F.col("source_size") / block_tokens)
    scheduled = (
        ranked.withColumn("block", F.col("before") % blocks)
        .withColumn("epoch", F.floor(F.col("before") / blocks))
        .where(F.col("epoch") < max_repeats)  # a limit of repeats holds to the token
        .select(F.col("i").alias("slot"), "m_key", F.col("before").alias("rank"), "block", "epoch")
    )
    return sources, documents, scheduled


def taken_tokens(docs: DataFrame, weights: list[float], share: float = 1.5, max_repeats: int = 2, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """m_id, m_row, size, source_size, target, taken: the tokens the mix takes from each row."""
    sources, documents, slots = mixed(docs, weights, share, max_repeats, block_tokens, id_col, text_col, source_col, row_col)
    uses = slots.groupBy("m_key", "block").agg(F.count("*").alias("uses"))
    spread = documents.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(before div {block_tokens}, (before + size - 1) div {block_tokens})")))
    covered = F.least(F.col("before") + F.col("size"), (F.col("block") + 1) * block_tokens) - F.greatest(F.col("before"), F.col("block") * block_tokens)
    used = (
        spread.join(uses, ["m_key", "block"], "left")
        .groupBy("m_key", "order", "m_id", "m_row", "size", "before")
        .agg(F.sum(covered * F.coalesce("uses", F.lit(0))).alias("taken"))
        .select("m_key", "m_id", "m_row", "size", "taken")
        .unionByName(documents.where("size = 0").select("m_key", "m_id", "m_row", "size", F.lit(0).cast("bigint").alias("taken")))
    )
    return used.join(sources.select("m_key", "source_size", "target"), "m_key").select("m_id", "m_row", "size", "source_size", "target", "taken")


def mix_counts(docs: DataFrame, weights: list[float], share: float = 1.5, max_repeats: int = 2, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, size, source_size, target, taken: the tokens the mix takes from each document."""
    counts = taken_tokens(docs, weights, share, max_repeats, block_tokens, id_col, text_col, source_col)
    return counts.select(F.col("m_id").alias(id_col), "size", "source_size", "target", "taken")


def take_documents(docs: DataFrame, weights: list[float], share: float = 1.5, max_repeats: int = 2, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", from_files: bool = False) -> DataFrame:
    """The rows of docs as often as the mix takes them, with their columns.

    A document at the edge of the part that is taken is kept whole when at least half of it
    is. Copies come back to their row by a row key, so rows that share an id or have none count
    one by one. Rows without words are not taken. from_files says that docs is a plain reading of Parquet
    files, whose rows have such a key already and are read again in the end; others are written first.
    """
    rows, own = with_row_key(docs, from_files)
    counts = taken_tokens(rows, weights, share, max_repeats, block_tokens, own[id_col], own[text_col], own[source_col], "row")
    copies = counts.where("size > 0").select(F.col("m_row").alias("c_row"), F.expr("(2 * taken + size) div (2 * size)").cast("int").alias("c_copies"))
    joined = rows.join(copies.where("c_copies > 0"), F.col("row") == F.col("c_row"))
    return joined.withColumn("c_copy", F.explode(F.sequence(F.lit(1), F.col("c_copies")))).select(*[F.col(o).alias(c) for c, o in own.items()])
