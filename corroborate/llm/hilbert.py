"""Sharding along a Hilbert curve over metadata dimensions.

Source, language and size are quantised to BITS bits each, or more up to MOST_BITS where a dimension has more categories: a
category's slot is its place among the categories in order. The cell's index on the Hilbert curve is looked up in a
table of 2 ** (bits * dimensions) rows, and rows are sorted by (index, text checksum and hash, doc_id), so that rows
near each other in all dimensions stand together; files cut from the runs then have
narrow minima and maxima in every dimension. Equal texts take one cell, that of the least (source, lang) among them, so they stand one
after the other. The sorted order is cut into runs of equal row counts (law ``rows``: counts at most one apart); a group of
equal texts is divided only where a run ends.

A row's global number is its number in its sorted partition plus a sum over the partitions before, so no
window runs over the whole table or over a crowded cell. Null text: as the empty one, size 1 and checksum 0. Null metadata:
quantised as the empty text. Null ids sort first. Repeated rows are placed one after the other. Very long texts are
only hashed. An empty table gives an empty result. Other columns of docs aren't looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroborate.llm.common import hot_keys, scratch, split_join, table, unused

SHARDS, BITS, MOST_BITS = 8, 4, 5


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """The index of a cell on the Hilbert curve of 2 ** bits cells a side (Skilling's transform)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    index = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            index = index << 1 | (v >> b & 1)
    return index


def curve(spark: SparkSession, dimensions: int, bits: int) -> DataFrame:
    """cell (coordinates joined to one number), hilbert: 2 ** (bits * dimensions) rows, 65 536 at most."""
    if bits * dimensions > 16:
        raise ValueError("the curve's table is kept to 65 536 cells")
    mask = (1 << bits) - 1
    rows = [(c, hilbert_index(tuple(c >> (bits * d) & mask for d in reversed(range(dimensions))), bits)) for c in range(1 << (bits * dimensions))]
    return spark.createDataFrame(rows, "cell int, hilbert int")


def magnitude(column: Column, bits: int) -> Column:
    """A size's slot: half powers of two from 64 up (quarters with more than 4 bits)."""
    steps = 2 << max(0, bits - 4)
    return F.least(F.lit((1 << bits) - 1), F.greatest(F.lit(0), F.floor(steps * F.log2(F.greatest(column, F.lit(1)) / 64.0)))).cast("int")


def in_order(rows: DataFrame, order: list[str], number: str = "number") -> DataFrame:
    """rows with each row's place, from 0, in the order of the columns; written once, so places don't change."""
    at, part, begin = unused([*rows.columns, number], "at", "partition", "begin")
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the low 33 bits of the generated id number the rows of a partition, the rest is the partition
    kept = scratch(parts.withColumn(at, F.monotonically_increasing_id()), "hilbert-order").withColumn(part, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = kept.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition, whatever the rows
    shifts = sizes.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(begin))
    return kept.join(F.broadcast(shifts), part).withColumn(number, F.col(begin) + F.col(at)).drop(part, at, begin)


def categories(rows: DataFrame, column: str) -> DataFrame:
    """value, number: the distinct values of a column as text (null: empty), numbered in order."""
    return in_order(rows.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).distinct(), ["value"])


def cut_runs(numbered: DataFrame, shards: int, total: int) -> DataFrame:
    """Adds shard and slot: shard s holds numbers ceil(s * total / shards) up to the next shard's first."""
    shard = F.expr(f"(number * {shards}) div {max(1, total)}").cast("int")
    return numbered.withColumn("shard", shard).withColumn("slot", F.col("number") - F.expr(f"(shard * {max(1, total)}L + {shards - 1}) div {shards}"))


def document_shards(docs: DataFrame, shards: int = SHARDS, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, hilbert of each row of docs, by source, language and size.

    carry: with the struct row of all the columns of docs.
    """
    known = {c: categories(docs, c) for c in ("source", "lang")}
    counts = {c: max(1, v.count()) for c, v in known.items()}
    # a slot for each category, where there are not more of them than slots; neighbours in order else share one
    bits = min(MOST_BITS, max(BITS, *((n - 1).bit_length() for n in counts.values())))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in known],
        *([F.struct(*docs.columns).alias("row")] if carry else []),
    )
    # equal texts stand in one cell, that of the least source and language among them
    cells = rows.groupBy("text_hash").agg(F.min(F.struct("source", "lang")).alias("cell"), F.count(F.lit(1)).alias("n"))
    cells = scratch(cells.filter("n > 1"), "hilbert-copies")
    keys = ["text_hash"]
    hot = hot_keys(cells, keys, cells.agg(F.sum("n")).first()[0] or 0)
    placed = split_join(rows, cells.drop("n"), keys, hot, "left").withColumns({c: F.coalesce(F.col(f"cell.{c}"), F.col(c)) for c in known}).drop("cell")
    for c, values in known.items():
        slot = F.expr(f"cast(number * {1 << bits} div {max(counts[c], 1 << bits)} as int)") if counts[c] > 1 << bits else F.col("number").cast("int")
        placed = placed.join(values.select(F.col("value").alias(c), slot.alias(f"{c}_slot")), c)
    cell = (F.col("source_slot") * (1 << bits) + F.col("lang_slot")) * (1 << bits) + magnitude(F.col("size"), bits)
    # the table is bounded by the curve's cells
    placed = placed.withColumn("cell", cell.cast("int")).join(F.broadcast(curve(docs.sparkSession, 3, bits)), "cell")
    own = placed.select("doc_id", "size", "text_crc32", "text_hash", "hilbert", F.monotonically_increasing_id().alias("tie"), *(["row"] if carry else []))
    numbered = in_order(own, ["hilbert", "text_crc32", "text_hash", "doc_id", "tie"])
    return cut_runs(numbered, shards, numbered.count()).select("doc_id", "size", "text_crc32", "shard", "slot", "hilbert", *(["row"] if carry else []))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes the rows of docs as Parquet, a folder shard=0, shard=1, ... for each shard, in slot order within it.

    Each row is written once, with all its columns, null and repeated ids too.
    """
    folder, slot = unused(docs.columns, "shard", "slot")
    placed = document_shards(docs, shards, carry=True).select("row.*", F.col("shard").alias(folder), F.col("slot").alias(slot))
    placed.repartitionByRange(folder, slot).sortWithinPartitions(folder, slot).drop(slot).write.partitionBy(folder).parquet(path)


def op4_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = document_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
