"""Families, tiers and the batch corroboration gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Tool, family, and whether the family's time is one of execution.
TOOLS = (
    ("get_amcache", "AppCompat", False),
    ("get_shimcache", "AppCompat", False),
    ("get_mft_timeline", "AppCompat", False),
    ("get_usnjrnl", "AppCompat", False),
    ("get_userassist", "Explorer/NTUSER", True),
    ("get_bam", "Background-service", True),
    ("get_prefetch", "SysMain", True),
    ("get_sysmon_4688", "Kernel-ETW", True),
)
FAMILIES = ("AppCompat", "Background-service", "Explorer/NTUSER", "Kernel-ETW", "SysMain")
TIERS = ("DRAFT_TAMPER_SUSPECTED", "DRAFT", "CORROBORATED", "FINAL")
C_SCALE = ("C0", "C2", "C4", "C5")
#: The rank of three families and more.
MOST_RANK = 3


def tools(spark: SparkSession) -> DataFrame:
    """The dimension tool -> family; a handful of rows, so always broadcast."""
    return F.broadcast(spark.createDataFrame(TOOLS, "tool string, family string, exec_time boolean"))


def tier_rank(families: Column) -> Column:
    """1 to 3 by the number of families; a negative number is an error."""
    return F.when(families < 0, F.raise_error(F.lit("a number of families is negative")).cast("int")).when(families <= 1, 1).when(families == 2, 2).otherwise(MOST_RANK)


def _label(rank: Column, labels: tuple[str, ...]) -> Column:
    """The label of a rank from 0; null for a null rank."""
    out = F.when(rank == 0, labels[0])
    for k, label in enumerate(labels[1:], 1):
        out = out.when(rank == k, label)
    return out


def tier_name(rank: Column) -> Column:
    return _label(rank, TIERS)


def c_scale(rank: Column) -> Column:
    return _label(rank, C_SCALE)


def program_family_tier(events: DataFrame) -> DataFrame:
    """Per case and program: how many families saw it, its tier and scale. Grouped by both, so no system program is a hot key."""
    known = events.join(tools(events.sparkSession), "tool").filter(F.col("program_path").isNotNull())
    out = known.groupBy("case_id", F.lower("program_path").alias("program")).agg(F.countDistinct("family").alias("n_families"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.count(F.lit(1)).alias("n_events"))
    rank = tier_rank(F.col("n_families"))
    return out.withColumn("tier", tier_name(rank)).withColumn("c_scale", c_scale(rank))


def evaluate_claims(claims: DataFrame, calls: DataFrame, window_seconds: float = 5.0) -> DataFrame:
    """One finding for each claim (claim_id, audit_ids array, n_signals), from calls (audit_id, tool, first_event_ts).

    Refused, in this order: no citations, an id that no call has, a tool without a family. Tier by distinct
    families; one lower for any tamper signal; one lower (from CORROBORATED or FINAL alone) if the first
    cited times of the execution-time families are further apart than the window.
    """
    ids = claims.select("claim_id", F.posexplode(F.array_distinct("audit_ids")).alias("pos", "audit_id"))
    cited = ids.join(calls.select("audit_id", "tool", "first_event_ts", F.lit(True).alias("found")), "audit_id", "left").join(tools(claims.sparkSession), "tool", "left")
    by_family = cited.groupBy("claim_id", "family").agg(
        F.min("pos").alias("pos"), F.min_by("first_event_ts", "pos").alias("ts"), F.max("exec_time").alias("exec_time"),
        F.count_if(F.col("found").isNull()).alias("missing"), F.count_if(F.col("found").isNotNull() & F.col("family").isNull()).alias("unknown"),
        F.collect_list(F.when(F.col("found").isNull(), F.col("audit_id"))).alias("missing_ids"),
    )
    times = F.when(F.col("exec_time"), F.unix_micros(F.col("ts")))
    per_claim = by_family.groupBy("claim_id").agg(
        F.count("family").alias("n_families"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("family").isNotNull(), F.struct("pos", "family")))), lambda s: s["family"]).alias("families"),
        F.sum("missing").alias("missing"), F.sum("unknown").alias("unknown"), F.array_sort(F.flatten(F.collect_list("missing_ids"))).alias("missing_ids"),
        F.count(times).alias("n_times"), (F.max(times) - F.min(times)).alias("span_us"),
    )
    out = claims.join(per_claim, "claim_id", "left")
    out = out.withColumn("refusal", F.when(F.coalesce(F.size(F.array_distinct("audit_ids")), F.lit(0)) <= 0, "EMPTY_AUDIT_IDS").when(F.col("missing") > 0, "MISSING_AUDIT_IDS").when(F.col("unknown") > 0, "UNKNOWN_TOOL"))
    base = tier_rank(F.col("n_families"))
    out = out.withColumn("demoted_for_tamper", F.coalesce(F.col("n_signals") > 0, F.lit(False)))
    out = out.withColumn("_rank", F.greatest(base - F.col("demoted_for_tamper").cast("int"), F.lit(0)))
    out = out.withColumn("coherence", F.when(F.col("n_times") < 2, "insufficient_data").when(F.col("span_us") <= round(window_seconds * 1e6), "coherent").otherwise("incoherent"))
    out = out.withColumn("demoted_for_temporal", (F.col("coherence") == "incoherent") & (F.col("_rank") != 1))
    out = out.withColumn("tier_rank", F.when(F.col("demoted_for_temporal") & (F.col("_rank") >= 2), F.col("_rank") - 1).otherwise(F.col("_rank")))
    for name in ("tier_rank", "coherence", "demoted_for_tamper", "demoted_for_temporal", "n_families"):
        out = out.withColumn(name, F.when(F.col("refusal").isNull(), F.col(name)))
    basis = F.when(F.col("n_families") >= 2, "independent_artifacts").when(F.col("n_families").isNotNull(), "single_family")
    return out.withColumn("tier", tier_name(F.col("tier_rank"))).withColumn("c_scale", c_scale(F.col("tier_rank"))).withColumn("confirmation_basis", basis).drop("_rank", "missing", "unknown", "n_times")


def tier_progression(citations: DataFrame) -> DataFrame:
    """The tier after each citation (claim_id, pos, tool), as families accumulate."""
    first = F.row_number().over(Window.partitionBy("claim_id", "family").orderBy("pos")) == 1
    so_far = Window.partitionBy("claim_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    known = citations.join(tools(citations.sparkSession), "tool").withColumn("first", first.cast("int"))
    out = known.withColumn("n_families", F.sum("first").over(so_far))
    return out.withColumn("tier", tier_name(tier_rank(F.col("n_families")))).drop("first", "exec_time")


def weak_pair(families: Column) -> Column:
    """Exactly the two families that share a hive."""
    return F.array_sort(families) == F.array(F.lit("AppCompat"), F.lit("Background-service"))


def needle(events: DataFrame, text: str, fields: tuple[str, ...] = ("program_path",)) -> DataFrame:
    """Rows in which one of the fields holds the text, whatever the case; fields that the table lacks are passed over."""
    held = [F.contains(F.lower(F.col(f).cast("string")), F.lit(text.lower())) for f in fields if f in events.columns]
    return events.filter(reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in held], F.lit(False)))


def family_yield(events: DataFrame) -> DataFrame:
    return events.join(tools(events.sparkSession), "tool").groupBy("family", "tool").agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("program_path").alias("n_programs"))


def needles_found(expected: DataFrame, events: DataFrame) -> DataFrame:
    """expected (family, needle) with the number of events whose path holds the needle; 0 is a miss. expected is a short list."""
    known = events.join(tools(events.sparkSession), "tool").select("family", F.lower("program_path").alias("path"))
    hits = known.join(F.broadcast(expected), "family").filter(F.contains("path", F.lower("needle"))).groupBy("family", "needle").agg(F.count(F.lit(1)).alias("hits"))
    return expected.join(hits, ["family", "needle"], "left").withColumn("hits", F.coalesce("hits", F.lit(0))).withColumn("found", F.col("hits") > 0)


def expected_tiers(expected: DataFrame, graded: DataFrame) -> DataFrame:
    """expected (case_id, program, expected_tier) against the rows of ``program_family_tier``: the tier found (null if none) and met, higher, lower or missing."""
    place = lambda c: F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col(c))
    found = graded.select("case_id", F.lower("program").alias("program"), "tier")
    both = expected.withColumn("program", F.lower("program")).join(found, ["case_id", "program"], "left")
    verdict = F.when(F.col("tier").isNull(), "missing").when(place("tier") == place("expected_tier"), "met").when(place("tier") > place("expected_tier"), "higher").otherwise("lower")
    return both.withColumn("verdict", verdict)
