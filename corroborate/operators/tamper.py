"""Tamper predicates over host and file facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.operators.reports import utc_text

# The reason codes that ledgers hold.
FLUSH_REASONS = {"likely": "tamper_likely_baseflushappcompatcache", "ambiguous": "ambiguous_legitimate_flush_consistent"}
SUPPRESSION_REASONS = {"likely": "tamper_likely_sysmain_disabled", "ambiguous": "ambiguous_sysmain_disabled_operator_plausible"}
TIMESTOMP_REASON = "tamper_likely_mft_timestomp"


def _us(name: str):
    return F.unix_micros(F.col(name).cast("timestamp"))


def appcompat_flush(facts: DataFrame, window_seconds: int = 3600) -> DataFrame:
    """Adds flush: the cache is empty and its hive was written within the window before acquisition; within 1 s it is ambiguous."""
    delta = _us("image_acquisition") - _us("system_hive_last_write")
    hit = (F.col("shimcache_rowcount") == 0) & (delta >= 0) & (delta <= window_seconds * 1_000_000)
    return facts.withColumn("flush", F.when(hit & (delta <= 1_000_000), "ambiguous").when(hit, "likely"))


def sysmain_suppression(facts: DataFrame, least: int = 5) -> DataFrame:
    """Adds suppression: programs ran, there is no prefetch file, and the service isn't running; disabled is likely."""
    hit = (F.col("amcache_rowcount") >= least) & (F.col("prefetch_filecount") == 0) & (F.col("sysmain_state") != "Running")
    return facts.withColumn("suppression", F.when(hit & (F.col("sysmain_state") == "Disabled"), "likely").when(hit, "ambiguous"))


def mft_timestomp(times: DataFrame, threshold: str = "1980-01-01", skew_seconds: int = 86_400) -> DataFrame:
    """Adds timestomp: the standard time is before the threshold while the name's is not, or over the skew before the name's."""
    limit = F.unix_micros(F.lit(threshold).cast("timestamp"))
    epoch = (_us("si_btime") < limit) & (_us("fn_btime") >= limit)
    back = _us("si_btime") < _us("fn_btime") - skew_seconds * 1_000_000
    return times.withColumn("timestomp", F.when(epoch, "epoch").when(back, "backdated"))


def _signal(kind: str, reasons: dict[str, str], family: str, rationale: Column) -> Column:
    """A struct (reason, family, rationale) where the column ``kind`` names one of the reasons; else null."""
    reason = F.coalesce(*[F.when(F.col(kind) == k, F.lit(code)) for k, code in reasons.items()])
    return F.when(reason.isNotNull(), F.struct(reason.alias("reason"), F.lit(family).alias("family"), rationale.alias("rationale")))


def host_signals(facts: DataFrame, window_seconds: int = 3600, least: int = 5) -> DataFrame:
    """(case_id, reason, family, rationale): a row for each signature that fires, in one pass over the facts.

    A case without a row isn't thereby trusted more. Facts that are null fire nothing.
    """
    marked = sysmain_suppression(appcompat_flush(facts, window_seconds), least)
    seconds = (_us("image_acquisition") - _us("system_hive_last_write")) / 1_000_000
    flush = _signal("flush", FLUSH_REASONS, "AppCompat", F.format_string("no cache entry; hive written %.1f s before acquisition", seconds))
    off = _signal("suppression", SUPPRESSION_REASONS, "SysMain", F.format_string("%d inventory rows and no prefetch file; service %s", F.col("amcache_rowcount"), F.col("sysmain_state")))
    return marked.select("case_id", F.inline(F.array_compact(F.array(flush, off))))


def file_signals(times: DataFrame, *keys: str, threshold: str = "1980-01-01", skew_seconds: int = 86_400) -> DataFrame:
    """(keys, reason, family, rationale) of each file whose times were set back; a row for each, so no case's files are collected."""
    marked = mft_timestomp(times, threshold, skew_seconds)
    both = F.concat(F.lit("standard time "), utc_text(F.col("si_btime").cast("timestamp")), F.lit(", name's time "), utc_text(F.col("fn_btime").cast("timestamp")))
    why = F.concat(F.when(F.col("timestomp") == "epoch", F.lit("before the threshold: ")).otherwise(F.lit("set back: ")), both)
    signal = _signal("timestomp", dict.fromkeys(("epoch", "backdated"), TIMESTOMP_REASON), "AppCompat", why)
    return marked.select(*keys, F.inline(F.array_compact(F.array(signal))))


def case_facts(inventory: DataFrame, events: DataFrame) -> DataFrame:
    """Row counts per (case_id, tool) of what was read: 0 if read and empty, no row if not read."""
    counts = events.groupBy("case_id", "tool").agg(F.count(F.lit(1)).alias("n"))
    return inventory.select("case_id", "tool").distinct().join(counts, ["case_id", "tool"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def collect_signals(*signals: DataFrame) -> DataFrame:
    """(case_id, reason) rows of all predicates -> one row for each case with its reasons, sorted, and their number."""
    every = signals[0].select("case_id", "reason")
    for more in signals[1:]:
        every = every.unionByName(more.select("case_id", "reason"))
    return every.filter("reason is not null").groupBy("case_id").agg(F.count(F.lit(1)).alias("n_signals"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def family_counts(events: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """Events per case and family, and whether one family is empty where another isn't; events (case_id, family)."""
    wide = events.groupBy("case_id").pivot("family", list(families)).count().na.fill(0)
    columns = [F.col(f"`{f}`") for f in families]
    return wide.withColumn("disagrees", (F.least(*columns) == 0) & (F.greatest(*columns) > 0))
