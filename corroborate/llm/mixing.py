"""Mixing sources to target weights by Poisson replication, in DataFrame operations alone.

The rate of a source is weight * rows in all / rows of the source, so that its expected rows after mixing
are its weight's share of the corpus. Each document draws a uniform number from a hash of its id, its text, its number
among equal rows and the seed; the number is put through the inverse of its source's Poisson distribution, and the document is
repeated that often. At last all rows are dealt out and sorted by a hash of (document, replica): a global shuffle.

A source's distribution is cumulated over the WIDE standard deviations around its mean, so it has about 24 * sqrt(rate) terms.
Null source: a source of its own. Null doc_id: drawn by the text, as if the id were the empty text. Rows that share an
id but not a text, and equal rows, draw by themselves. Null and empty texts are alike; long ones are hashed whole. Unlisted sources have weight 0;
without weights all sources have the same. An empty table gives an empty result. All columns of docs stay as they are;
where docs has a column copies, replica or shuffle_key already, the new one's name ends in an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroborate.llm.common import hot_keys, scratch, split_join, table, unused

SEED = 20240607
#: A distribution's terms: those within WIDE standard deviations and MORE of the mean. The rest is under the steps of the uniform number.
WIDE, MORE = 12, 40
#: Terms of all distributions, of 8 bytes each, that are broadcast; with more of them they are joined by a shuffle.
BROADCAST_TERMS = 4_000_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of the parts and the seed."""
    name = F.concat_ws(":", F.lit(str(SEED)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """source, n, rate of each source of docs; counts cover all rows and are summed before the shuffle."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    weight = F.lit(1.0)
    if weights is not None:
        weight = F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in weights.items()], F.lit(0.0))
    weighed = scratch(counts.withColumn("weight", weight), "mixing-sources")
    total = weighed.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).first()
    share = F.col("weight") / F.lit(total["weight"] or 1.0)
    return weighed.select("source", "n", (share * F.lit(total["n"] or 0) / F.col("n")).alias("rate"))


def poisson(k: Column, rate: Column) -> Column:
    """The probability of k at a rate, by way of its distance from the mean, so that large rates lose no digits."""
    over = k * F.log1p((k - rate) / rate) + rate - k
    stirling = 1 / (12 * k) - 1 / (360 * k**3) + 1 / (1260 * k**5)
    large = F.exp(-over - stirling) / F.sqrt(2 * F.lit(3.141592653589793) * k)
    small = F.exp(k * F.ln(rate) - rate - F.ln(F.factorial(F.least(k.cast("int"), F.lit(20)))))
    return F.when(k <= 20, small).otherwise(large)


def with_distribution(source_rates: DataFrame) -> DataFrame:
    """Adds low and cdf: the cumulated probabilities from the number low on; sources of rate 0 go."""
    reach = WIDE * F.sqrt("rate") + MORE
    low = F.greatest(F.lit(0.0), F.floor(F.col("rate") - reach)).cast("int")
    bounded = source_rates.filter("rate > 0").withColumn("low", low)
    terms = bounded.withColumn("k", F.explode(F.sequence("low", F.ceil(F.col("rate") + reach).cast("int"))))
    terms = terms.withColumn("c", F.sum(poisson(F.col("k").cast("double"), F.col("rate"))).over(Window.partitionBy("source", "rate").orderBy("k")))
    return terms.groupBy("source", "rate", "low").agg(F.sort_array(F.collect_list("c")).alias("cdf"))


def copies(low: Column, cdf: Column, u: Column) -> Column:
    """The inverse of the distribution at u: low and the steps of the cumulated distribution that are at or under u."""
    return low + F.size(F.filter(cdf, lambda c: c <= u))


def numbered(docs: DataFrame, name: str, number: str) -> DataFrame:
    """Adds name, the hash of a row's id and text, and number, which tells rows with one name apart: 0, 1, ...

    Only rows whose name comes again are numbered, in their partition and then over the partitions' sums, so that
    equal rows are never gathered in one place.
    """
    rows = docs.withColumn(name, F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.md5("text"), F.md5(F.lit(""))))))
    again = scratch(rows.groupBy(name).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "mixing-again")
    if again.isEmpty():
        return rows.withColumn(number, F.lit(0).cast("long"))
    hot = hot_keys(again, [name], again.agg(F.sum("n")).first()[0])
    at, part, begin = unused(rows.columns, "at", "partition", "begin")
    # written once, so that a row's partition is the same for all that follows
    twice = scratch(split_join(rows, again.select(name), [name], hot).withColumn(at, F.monotonically_increasing_id()), "mixing-twice").withColumn(part, F.shiftright(at, 33))
    sizes = twice.groupBy(name, part).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(name).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(name, part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(begin))
    placed = F.row_number().over(Window.partitionBy(name, part).orderBy(at)) - 1
    twice = twice.withColumn(number, placed).join(shifts, [name, part]).withColumn(number, F.col(number) + F.col(begin))
    once = rows.join(again.select(name), name, "left_anti").withColumn(number, F.lit(0).cast("long"))
    return once.unionByName(twice.select(*once.columns))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """The rows of docs (doc_id, text, source and others) by their Poisson counts, globally shuffled, with copies, replica and shuffle_key."""
    copied, replica, key, name, number, source, low, cdf = unused(docs.columns, "copies", "replica", "shuffle_key", "mixing_name", "mixing_number", "mixing_source", "low", "cdf")
    of = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    known = scratch(with_distribution(rates(docs, weights)).select(of.alias(source), F.col("low").alias(low), F.col("cdf").alias(cdf)), "mixing-rates")
    rows = numbered(docs, name, number).withColumn(source, of)
    if (known.agg(F.sum(F.size(cdf))).first()[0] or 0) <= BROADCAST_TERMS:
        joined = rows.join(F.broadcast(known), source)
    else:
        counts = scratch(docs.groupBy(of.alias(source)).agg(F.count(F.lit(1)).alias("n")), "mixing-counts")
        joined = split_join(rows, known, [source], hot_keys(counts, [source], counts.agg(F.sum("n")).first()[0]))
    counted = joined.withColumn(copied, copies(F.col(low), F.col(cdf), uniform(F.col(name), F.col(number)))).drop(low, cdf, source).filter(F.col(copied) > 0)
    repeated = counted.withColumn(replica, F.explode(F.sequence(F.lit(1), F.col(copied))))
    keyed = repeated.withColumn(key, F.md5(F.concat_ws(":", F.lit(f"{SEED}s"), name, number, replica)))
    return keyed.select(*docs.columns, copied, replica, key).repartition(key).sortWithinPartitions(key)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", F.col("copies").cast("long").alias("copies"), F.col("replica").cast("long").alias("replica"), "shuffle_key", F.md5("text").alias("text_md5"))


ORACLE_SQL = f"""
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
known AS (SELECT source, 1.0 / (SELECT count(*) FROM counts) * (SELECT sum(n) FROM counts) / n AS rate FROM counts),
terms AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + {WIDE} * sqrt(rate) + {MORE}) AS BIGINT) + 1)) AS k FROM known),
steps AS (SELECT source, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
cdf AS (SELECT source, list(c) AS c FROM steps GROUP BY source),
named AS (SELECT *, md5(concat(doc_id, ':', md5(coalesce(text, '')))) || ':' || (row_number() OVER (PARTITION BY doc_id, coalesce(text, '')) - 1) AS name FROM documents),
drawn AS (SELECT *, ('0x' || substr(md5('{SEED}:' || name), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM named),
counted AS (SELECT d.doc_id, d.source, d.text, d.name, CAST(len(list_filter(c.c, lambda x: x <= d.u)) AS BIGINT) AS copies
            FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source),
repeated AS (SELECT doc_id, source, copies, text, name, unnest(range(1, copies + 1)) AS replica FROM counted WHERE copies > 0)
SELECT doc_id, source, copies, replica, md5('{SEED}s:' || name || ':' || replica) AS shuffle_key, md5(text) AS text_md5 FROM repeated
"""
