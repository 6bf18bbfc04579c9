"""Question-set curation: token sets, paraphrase guards, selection."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def token_set(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower))


def jaccard(a: Column, b: Column) -> Column:
    """0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def paraphrases_by_position(entries: DataFrame, corpus: DataFrame, limit: float = 0.30) -> DataFrame:
    """Entries (position, text) against the corpus text at their position: similarity and rejection."""
    both = entries.select("position", F.col("text").alias("a")).join(corpus.select("position", F.col("text").alias("b")), "position")
    out = both.withColumn("similarity", jaccard(token_set(F.col("a")), token_set(F.col("b"))))
    return out.select("position", "similarity", (F.col("similarity") >= limit).alias("rejected"))


def _of_fitting_size(sets: DataFrame, tokens: str, others: DataFrame, other_tokens: str, limit: float) -> DataFrame:
    """The sets whose size lets them reach the limit with some of the others: of two sets the smaller has ``limit`` of the larger at least. Exact, and one row is broadcast."""
    sizes = others.select(F.size(other_tokens).alias("n")).filter("n > 0").agg(F.min("n").alias("_least"), F.max("n").alias("_most"))
    n = F.size(tokens)
    return sets.join(F.broadcast(sizes), (n >= F.col("_least") * limit - 1e-6) & (n * limit <= F.col("_most") + 1e-6)).drop("_least", "_most")


def paraphrases(entries: DataFrame, corpus: DataFrame, limit: float = 0.30) -> DataFrame:
    """All (entry_id, text_id) pairs of similarity >= limit, by a prefix-filtered index of tokens.

    Two sets with Jaccard >= limit share one of the first n - ceil(limit * n) + 1 tokens of either, in any
    fixed order of tokens. The order is that of how many entries hold a token. So a text's tokens that no entry holds come first: they
    fill its prefix and need only be counted, and of the others only what is left of the prefix is looked up. At the first token that
    two sets share, no more than the shorter rest of both can follow in common, which with the sizes drops most pairs; what is left is
    verified exactly. Texts of sizes that no entry fits go before all that.
    """
    one = entries.select(F.col("entry_id"), token_set(F.col("text")).alias("a"))
    two = _of_fitting_size(corpus.select(F.col("text_id"), token_set(F.col("text")).alias("b")), "b", one, "a", limit)
    seen = one.select(F.explode("a").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))

    def prefix(df: DataFrame, key: str, tokens: str) -> DataFrame:
        each = df.select(key, F.size(tokens).alias("n"), F.xxhash64(tokens).alias("set"), F.explode(tokens).alias("token")).join(seen, "token")
        ordered = each.groupBy(key, "n", "set").agg(F.array_sort(F.collect_set(F.struct("df", "token"))).alias("t"))
        unknown = F.col("n") - F.size("t")
        keep = F.greatest(F.col("n") - F.ceil(F.col("n") * limit).cast("int") + 1 - unknown, F.lit(0))
        placed = ordered.select(key, "n", unknown.alias("unknown"), F.posexplode(F.slice("t", F.lit(1), keep)).alias("at", "x"))
        return placed.select(key, F.col("n").alias(f"n_{tokens}"), (F.col("at") + F.col("unknown")).alias(f"at_{tokens}"), "x.token")

    n, m = F.col("n_a"), F.col("n_b")
    following = F.least(n - F.col("at_a"), m - F.col("at_b"))
    # intersection / union >= limit, with a little room for rounding
    possible = following * (1 + limit) + 1e-6 >= (n + m) * limit
    fits = (n >= m * limit - 1e-6) & (m >= n * limit - 1e-6)
    pairs = prefix(one, "entry_id", "a").join(prefix(two, "text_id", "b"), "token").filter(fits & possible).select("entry_id", "text_id").distinct()
    exact = pairs.join(one, "entry_id").join(two, "text_id").withColumn("similarity", jaccard(F.col("a"), F.col("b")))
    return exact.filter(F.col("similarity") >= limit).select("entry_id", "text_id", "similarity")


#: Bands of the approximate search, and signatures in each: of pairs of similarity 0.3 about 0.977 share a band.
BANDS, BAND_ROWS = 40, 2


def paraphrases_approx(entries: DataFrame, corpus: DataFrame, limit: float = 0.30, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """The pairs of ``paraphrases`` that share a MinHash band: none that it hasn't, and 1 - (1 - s ** rows) ** bands of those of similarity s.

    A signature is the least hash of a set's tokens under one of bands * rows seeds, so the work on a text is in proportion to it, and
    pairs meet in equal bands only, where ``paraphrases`` meets them by rare tokens. Each pair is then verified. Empty sets have no band,
    and texts of sizes that no entry fits, which can't be in a pair, get no signatures.
    """
    one = entries.select("entry_id", token_set(F.col("text")).alias("a")).filter(F.size("a") > 0)
    two = _of_fitting_size(corpus.select("text_id", token_set(F.col("text")).alias("b")), "b", one, "a", limit)

    def banded(df: DataFrame, key: str, tokens: str) -> DataFrame:
        # minima over a text's tokens: the partial sums leave one row for each text
        each = df.select(key, F.xxhash64(tokens).alias("set"), F.explode(tokens).alias("token"))
        least = each.groupBy(key, "set").agg(*[F.min(F.xxhash64("token", F.lit(i))).alias(f"m{i}") for i in range(bands * rows)])
        marks = F.array(*[F.xxhash64(*[f"m{b * rows + k}" for k in range(rows)]) for b in range(bands)])
        return least.select(key, F.posexplode(marks).alias("band", "mark"))

    pairs = banded(one, "entry_id", "a").join(banded(two, "text_id", "b"), ["band", "mark"]).select("entry_id", "text_id").distinct()
    exact = pairs.join(one, "entry_id").join(two, "text_id").withColumn("similarity", jaccard(F.col("a"), F.col("b")))
    return exact.filter(F.col("similarity") >= limit).select("entry_id", "text_id", "similarity")


def clean_classification(rows: DataFrame, expected: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """Rows (position, offset, family, reason): known offsets and families, the first of each offset, reasons of 200 characters."""
    first = F.row_number().over(Window.partitionBy("offset").orderBy("position")) == 1
    known = rows.filter(F.col("family").isin(*families)).join(expected.select("offset"), "offset", "left_semi")
    return known.withColumn("_first", first).filter("_first").select("offset", "family", F.substring("reason", 1, 200).alias("reason"))


def balanced_selection(seed: DataFrame, drafts: DataFrame, target: int) -> DataFrame:
    """All seed rows (offset, family), and drafts not among them up to ``target`` a family, by offset.

    The constant bound on the place comes first: Spark then keeps the first ``target`` of each family within every input partition
    (WindowGroupLimit), so that no task sorts a family's drafts, and families are matched with what they have afterwards.
    """
    have = seed.groupBy("family").agg(F.count(F.lit(1)).alias("have"))
    fresh = drafts.select("offset", "family").join(seed.select("offset"), "offset", "left_anti")
    first = fresh.withColumn("place", F.row_number().over(Window.partitionBy("family").orderBy("offset"))).filter(F.col("place") <= target)
    chosen = first.join(have, "family", "left").filter(F.col("place") <= target - F.coalesce("have", F.lit(0)))
    return seed.select("offset", "family", F.lit(True).alias("seeded")).unionByName(chosen.select("offset", "family", F.lit(False).alias("seeded")))


def strip_fence(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"\A```(?:json)?\s*", ""), r"\s*```\z", ""))


@F.pandas_udf(T.BooleanType())
def compiles(patterns: pd.Series) -> pd.Series:
    """Is the text a regular expression? Java's dialect differs from the one answers are scored with, so it is compiled here."""

    def ok(pattern: str) -> bool:
        try:
            re.compile(pattern)
        except (re.error, OverflowError, RecursionError):
            return False
        return True

    return patterns.map(ok, na_action="ignore")


def draft_problem(pattern: Column, justification: Column) -> Column:
    """Why a draft is refused, null if it isn't: an empty field, or a pattern (after its ``~``) that doesn't compile."""
    body = F.regexp_replace(pattern, "^~", "")
    return F.when(F.coalesce(pattern, F.lit("")) == "", "EMPTY_PATTERN").when(F.coalesce(justification, F.lit("")) == "", "EMPTY_JUSTIFICATION").when(~compiles(body), "BAD_PATTERN")
