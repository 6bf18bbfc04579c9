"""Benchmark decontamination: documents that hold windows of benchmark items, by a prefix-filtered join in DataFrame operations alone.

A window is WINDOW consecutive words of an item; an item of fewer words, but not none, is one window. Words are
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. A document word inside any occurrence of a window is hit.

1. Rarity: the shingles (SHINGLE words; the whole of shorter windows) of all windows are counted over all documents.
2. An occurrence holds every shingle of the window, so the necessary prefix of a window's shingles, ordered by rarity, is its rarest one.
   A window with a shingle that no document has is gone.
3. The documents' shingles join the windows by that prefix. The shingle's place in the window gives the occurrence's first word, which
   must leave room for the whole window (bounds on position and length), and then the words are compared with the window's.
   Joins use 64-bit hashes; the comparison makes the result exact.
4. Spans of a document are sorted, and each adds the words that those before it don't reach.

Windows and shingles are broadcast in tiles of a fixed number of rows, whatever the benchmark's size; each tile reads the documents once, which
takes the place of a shuffle of all their words. A text is in the row while its words pass by, and isn't shuffled. A
document is its id and text (told apart by SHA-256): repeated rows are searched by themselves, counted once, and each gets its result.

Null and empty texts: no words, nothing is hit. Null doc_id: a document like others. Null item_id: named by the empty text. Items with
equal windows are all named; rows that share an item_id are one item. Very long texts are searched whole. An empty table of documents
gives an empty result, an empty benchmark hits nothing. Only the named columns are read, so others may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroborate.llm.common import hot_of, scratch, split_join, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 3
#: Windows (of up to WINDOW words) and shingles (of 8 bytes) that are broadcast at a time.
TILE, SHINGLE_TILE = 200_000, 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def windows_of(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(window number, win words, k) of all distinct windows of items (item_id, text), and (window, item_id)."""
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words("text").alias("w")).filter("size(w) > 0")
    parts = F.expr(f"transform(sequence(1, greatest(1, size(w) - {window - 1})), i -> slice(w, i, {window}))")
    owned = scratch(named.select("item_id", F.explode(parts).alias("win")).distinct(), "benchmark-items")
    known = scratch(owned.select("win").distinct().withColumn("window", F.monotonically_increasing_id()).withColumn("k", F.size("win")), "benchmark-windows")
    return known, scratch(owned.join(known.select("win", "window"), "win").select("window", "item_id"), "benchmark-owners")


def _shingle(words: str, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(size)])


def shingles_of(known: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(window, h, place, g): the shingles of each window, each at its first place (from 0), and their size."""
    placed = known.withColumn("g", F.least(F.lit(shingle), "k")).select("window", "win", "g", F.explode(F.expr("sequence(0, k - g)")).alias("place"))
    h = F.coalesce(*[F.when(F.col("g") == g, _shingle("win", F.col("place"), g)) for g in range(1, shingle + 1)])
    return placed.withColumn("h", h).groupBy("window", "h", "g").agg(F.min("place").alias("place"))


def _tiles(df: DataFrame, key: str, rows: int, most: int) -> list[DataFrame]:
    """The rows dealt by a hash of the key into parts of about ``most`` rows."""
    n = -(-rows // most)
    return [df.filter(F.pmod(F.xxhash64(key, F.lit(n)), F.lit(n)) == k) for k in range(n)] if n > 1 else [df]


def _passing(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """A row for each shingle of docs (doc_id, text): the document's words behind a first null, the shingle's place (from 1), g and h.

    The row of place 0 stands for the document. An outer explode, so that Spark doesn't infer a filter that splits the text once more.
    """
    named = F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce("text", F.lit(""))), 256))
    listed = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(words("text"), F.array().cast("array<string>")))
    at = docs.select("doc_id", named.alias("document"), listed.alias("words")).select("*", F.posexplode_outer("words").alias("place", "word")).drop("word")
    out = None
    for g in sizes or [1]:
        one = at.withColumn("g", F.lit(g)).withColumn("h", F.when((F.col("place") > 0) & (F.col("place") + g <= F.size("words")), _shingle("words", F.col("place"), g)))
        one = one if out is None else one.filter("place > 0")
        out = one if out is None else out.unionByName(one)
    return out


def rarest(docs: DataFrame, known: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """known windows that may occur, each with the hash h, size g and place of its shingle that is rarest in docs."""
    grams = scratch(shingles_of(known, shingle), "benchmark-shingles")
    sizes = [r[0] for r in grams.select("g").distinct().collect()]  # shingle sizes: at most SHINGLE of them
    wanted = scratch(grams.select("h").distinct(), "benchmark-hashes")
    counts = None
    for tile in _tiles(wanted, "h", wanted.count(), SHINGLE_TILE):
        one = _passing(docs, sizes).select("h").join(F.broadcast(tile), "h").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        counts = one if counts is None else counts.unionByName(one)
    ranked = grams.join(scratch(counts, "benchmark-counts"), "h", "left").groupBy("window")
    best = ranked.agg(F.min(F.struct("n", "h", "g", "place")).alias("best"), F.count_if(F.col("n").isNull()).alias("absent")).filter("absent = 0")
    return known.join(best, "window").select("window", "win", "k", "best.h", "best.g", F.col("best.place").alias("shift"))


def occurrences(docs: DataFrame, known: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Rows (document, doc_id, n_words) for each row of docs, where window is null, and (document, window, start, k) for each occurrence."""
    prefix = scratch(rarest(docs, known, shingle), "benchmark-prefixes")
    sizes = [r[0] for r in prefix.select("g").distinct().collect()]
    out = None
    for tile in _tiles(prefix, "window", prefix.count(), TILE):
        start = F.col("place") - F.col("shift")
        near = _passing(docs, sizes).join(F.broadcast(tile), ["h", "g"], "left").withColumn("start", start)
        holds = F.expr("window is not null and start > 0 and start + k <= size(words) and slice(words, start + 1, k) = win")
        alone = (F.col("place") == 0) if out is None else F.lit(False)
        found = near.filter(holds | alone).select("document", "doc_id", (F.size("words") - 1).cast("long").alias("n_words"), "window", F.col("start").cast("long").alias("start"), "k")
        out = found if out is None else out.unionByName(found)
    return scratch(out, "benchmark-found")


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_words, n_hit, and the sorted item_ids (as text) whose windows occur."""
    known, owned = windows_of(items, window)
    found = occurrences(docs.select("doc_id", "text"), known, shingle)
    base, spans = found.filter("window is null").select("document", "doc_id", "n_words"), found.filter("window is not null")
    ends = spans.groupBy("document", "start").agg(F.max(F.col("start") + F.col("k")).alias("end"))
    before = F.max("end").over(Window.partitionBy("document").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    hit = ends.withColumn("added", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, "start")))).groupBy("document").agg(F.sum("added").alias("n_hit"))
    pairs = scratch(spans.select("document", "window").distinct(), "benchmark-pairs")
    named = split_join(pairs, owned, ["window"], hot_of(pairs, ["window"])).groupBy("document").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    judged = split_join(base, hit.join(named, "document"), ["document"], hot_of(base, ["document"]), "left")
    return judged.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
 b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
 i AS (SELECT item_id, least(10, len(w)) AS k, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM b WHERE len(w) > 0),
 windows AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item_id, k, array_to_string(w[p : p + k - 1], ' ') AS win FROM i),
 places AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k),
 found AS (SELECT r, p, places.k, item_id FROM places JOIN windows ON windows.win = array_to_string(w[p : p + places.k - 1], ' ')),
 hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT r, p, k FROM found)) GROUP BY r),
 named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
