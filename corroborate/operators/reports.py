"""Tables that reports read: wire rows, case loads, summaries of calls and findings, integrity and range checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.operators.gate import TIERS

# The keys of a token count, and the shape of an identifier in a tool's answer.
TOKEN_KEYS = ("input", "output")
AUDIT_ID = r'"audit_id"\s*:\s*"([0-9a-fA-F-]{36})"'
TIER = rf'"tier"\s*:\s*"({"|".join(TIERS)})"'


def utc_text(ts: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss in UTC, whatever the session's zone: counted from the epoch."""
    seconds = F.floor(F.unix_micros(ts) / 1_000_000)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86_400).cast("int")).cast("string")
    part = lambda step, most: F.lpad(F.pmod(F.floor(seconds / step), F.lit(most)).cast("string"), 2, "0")
    return F.concat(day, F.lit(" "), part(3600, 24), F.lit(":"), part(60, 60), F.lit(":"), part(1, 60))


def iso_utc(ts: Column) -> Column:
    """ISO 8601 in UTC, with six digits of a second only where they aren't zero."""
    digits = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.concat(F.replace(utc_text(ts), F.lit(" "), F.lit("T")), F.when(digits != 0, F.format_string(".%06d", digits)).otherwise(""), F.lit("+00:00"))


def wire_rows(events: DataFrame, tools: DataFrame) -> DataFrame:
    """Events (tool, program_path, ts, ...) as they go out: with the tool's family and the time as text; unknown tools stay out."""
    return events.join(tools.select("tool", "family"), "tool").withColumn("timestamp", iso_utc(F.col("ts"))).drop("ts")


def load_cases(families: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """The events of all families under one schema, with their family's name; a family may be empty or lack columns."""
    parts = [df.select(*[c for c in columns if c in df.columns]).withColumn("loaded_family", F.lit(name)) for name, df in families.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def case_counts(loaded: DataFrame, families: list[str]) -> DataFrame:
    """case_id, family, n for each case and each family, 0 where a case has none; one pass over the events."""
    counts = loaded.groupBy("case_id").agg(*[F.count_if(F.col("loaded_family") == f).alias(f) for f in families])
    each = F.array(*[F.struct(F.lit(f).alias("family"), F.col(f"`{f}`").alias("n")) for f in families])
    return counts.select("case_id", F.explode(each).alias("x")).select("case_id", "x.family", "x.n")


def entry_problem(elapsed_ms: Column, usage: Column) -> Column:
    """What is wrong with a ledger entry: negative elapsed time, or a token count whose keys aren't exactly TOKEN_KEYS; else null."""
    keys = F.array_sort(F.map_keys(usage))
    wrong = usage.isNotNull() & (keys != F.array(*[F.lit(k) for k in TOKEN_KEYS]))
    return F.when(F.coalesce(elapsed_ms < 0, F.lit(False)), "NEGATIVE_ELAPSED").when(wrong, "TOKEN_KEYS")


def call_summary(events: DataFrame, payloads: DataFrame) -> DataFrame:
    """One row for each call: rows, first and last time, and the payload's path and digests where it has one."""
    own = events.groupBy("audit_id").agg(F.count(F.lit(1)).alias("row_count"), F.min("ts").alias("first_event_ts"), F.max("ts").alias("last_event_ts"))
    return own.join(payloads.select("audit_id", "payload_ref", "pre_sha256", "post_sha256"), "audit_id", "left")


def evidence_table(entries: DataFrame) -> DataFrame:
    """Evidence calls with the flag that sanitising changed their payload, and elapsed time; findings aren't evidence."""
    return entries.filter("tool <> 'claim_finding'").withColumn("drift", ~F.col("pre_sha256").eqNullSafe(F.col("post_sha256")))


def finding_table(lines: DataFrame) -> DataFrame:
    """The findings in sealed ledger lines (ledger_id, line_no, raw_line): tier, scale, basis, flags, cited ids."""
    schema = "struct<tool:string,args:struct<hypothesis:string,audit_ids:array<string>>,input_ref:struct<finding:struct<tier:string,c_scale:string,confirmation_basis:string,demoted_for_tamper:boolean,demoted_for_temporal:boolean>>>"
    read = lines.select("ledger_id", "line_no", F.from_json("raw_line", schema).alias("e")).filter("e.tool = 'claim_finding'")
    return read.select("ledger_id", "line_no", F.col("e.args.hypothesis").alias("hypothesis"), F.col("e.args.audit_ids").alias("audit_ids"), "e.input_ref.finding.*")


def payload_integrity(manifest: DataFrame, payloads: DataFrame) -> DataFrame:
    """path and status of each stored digest (path, sha256) and payload (path, content): ok, mismatch, missing or unlisted."""
    both = manifest.join(payloads.select("path", F.sha2("content", 256).alias("found")), "path", "full_outer")
    status = F.when(F.col("sha256").isNull(), "unlisted").when(F.col("found").isNull(), "missing").when(F.lower("sha256") == F.col("found"), "ok").otherwise("mismatch")
    return both.select("path", status.alias("status"))


def negative_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """For each column of counts, the rows in which it is under 0."""
    found = rows.agg(*[F.count_if(F.col(c) < 0).alias(c) for c in columns])
    return found.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in columns])).alias("x")).select("x.field", "x.n")


def out_of_range(rates: DataFrame, columns: list[str]) -> Column:
    """Is one of the rates neither null nor in 0 .. 1?"""
    return reduce(lambda a, b: a | b, [F.coalesce(~F.col(c).between(0, 1), F.lit(False)) for c in columns])


def confident_rate(rows: DataFrame, gateless: list[str]) -> DataFrame:
    """Per arm without a gate: the share of answers that aren't empty and don't begin with ``<``; null for other arms."""
    confident = (F.length("predicted") > 0) & ~F.startswith("predicted", F.lit("<"))
    return rows.groupBy("arm").agg(F.avg(F.when(F.col("arm").isin(*gateless), F.coalesce(confident, F.lit(False)).cast("double"))).alias("confident_rate"))


def run_summary(rows: DataFrame, arm: str, other: str, asked: int) -> DataFrame:
    """Per run: the difference of two arms' accuracies, the time of all answers, and whether questions are missing."""
    right = F.col("correct").cast("double")
    of = lambda name: F.avg(F.when(F.col("arm") == name, right))
    out = rows.groupBy("run_idx").agg((of(arm) - of(other)).alias("arm_delta"), F.sum("wallclock_ms").alias("duration_ms"), F.count_distinct("q_id").alias("questions"))
    return out.withColumn("partial", F.col("questions") < asked)


def scope_counts(rows: DataFrame, in_scope: Column) -> DataFrame:
    """Rows of each family before and after a filter; families without any after it keep a row."""
    return rows.groupBy("family").agg(F.count(F.lit(1)).alias("before"), F.count_if(in_scope).alias("after"))


def tool_text_fields(text: Column) -> dict[str, Column]:
    """What a tool's answer says of itself: all audit ids, the first tier, row count and number of families; else empty or null."""
    number = lambda key: F.nullif(F.regexp_extract(text, rf'"{key}"\s*:\s*(\d+)', 1), F.lit("")).cast("long")
    return {
        "audit_ids": F.regexp_extract_all(text, F.lit(AUDIT_ID), F.lit(1)),
        "tier": F.nullif(F.regexp_extract(text, TIER, 1), F.lit("")),
        "row_count": number("row_count"),
        "n_families": number("n_distinct_families"),
    }


def coverage_split(rows: DataFrame, matches: str) -> DataFrame:
    """known (the patterns catch it) or novel, with the number of scenarios; rows hold the number of matches of each."""
    return rows.groupBy(F.when(F.col(matches) > 0, "known").otherwise("novel").alias("coverage")).agg(F.count(F.lit(1)).alias("n"))


def in_directory(path: Column, folder: str) -> Column:
    """Does the path lie in the folder or below it? Neither case nor the kind of slash counts; null for a null path."""
    plain = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return plain.startswith(folder.lower().replace("\\", "/").rstrip("/") + "/")


def event_facts(events: DataFrame, *by: str, folder: str | None = None) -> DataFrame:
    """Per group: its latest and earliest event_id (ties by id), number of rows, largest size and HH:MM in UTC of the earliest; of the rows in a folder, if one is given."""
    rows = events if folder is None else events.filter(in_directory(F.col("program_path"), folder))
    when = F.struct("ts", "event_id")
    return rows.groupBy(*by).agg(
        F.max_by("event_id", when).alias("latest"), F.min_by("event_id", when).alias("earliest"), F.count(F.lit(1)).alias("n"),
        F.max("evidence_size_bytes").alias("largest"), F.substring(utc_text(F.min("ts")), 12, 5).alias("first_time"),
    )


def case_entries(entries: DataFrame, case_id: str | None = None) -> DataFrame:
    """Ledger entries as a report lists them: each with its case (``unknown`` if it names none) and kind, finding or evidence; of one case, if it is given.

    The lists stay rows, as one case may hold a third of all entries.
    """
    named = entries.withColumn("case_id", F.coalesce("case_id", F.lit("unknown")))
    kept = named if case_id is None else named.filter(F.col("case_id") == case_id)
    return kept.withColumn("kind", F.when(F.col("tool") == "claim_finding", "finding").otherwise("evidence"))
