"""Exported artifact tables -> events (artifact, program_path, ts, evidence_size_bytes, extras). Projections and filters only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.functions import scalars as S

# Names of counters that are no programs, and prefixes before a path.
COUNTERS = ("UEME_CTLSESSION", "UEME_CTLCUACOUNT", "UEME_UISCUT", "UEME_UITOOLBAR", "UEME_UIQCUT", "UEME_UIHOTKEY", "UEME_UIMENU")
PATH_PREFIXES = ("UEME_RUNPATH:", "UEME_RUNPIDL:")
# Optional fields of an inventory entry.
OPTIONAL = ("ProductName", "ProductVersion", "Publisher", "BinaryType", "BinFileVersion", "Language", "Version")
CREATED = (1, 4688)
PATH_LIMIT = 4096


def number_rows(events: DataFrame, artifact: list[str], order: list[str]) -> DataFrame:
    """Adds row_index, from 0 per artifact, over the rows that are left."""
    return events.withColumn("row_index", F.row_number().over(Window.partitionBy(*artifact).orderBy(*order)) - 1)


def over_cap(rows: DataFrame, artifact: list[str], most: int) -> DataFrame:
    """Artifacts with more input rows than ``most``; exactly as many pass."""
    return rows.groupBy(*artifact).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)


def before_fault(rows: DataFrame, faults: DataFrame, artifact: str, position: str) -> DataFrame:
    """Rows before an artifact's first fault, with partial set where there is one; faults (artifact, position)."""
    first = faults.groupBy(artifact).agg(F.min(position).alias("_fault"))
    return rows.join(first, artifact, "left").filter(F.col("_fault").isNull() | (F.col(position) < F.col("_fault"))).withColumn("partial", F.col("_fault").isNotNull()).drop("_fault")


def _path(value: Column) -> Column:
    return F.when((F.length(value) > 0) & (F.length(value) <= PATH_LIMIT) & ~S.is_dirty(value), value)


def _present(pairs: dict[str, Column]) -> Column:
    """A map of the entries that aren't null."""
    return F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())


def amcache(values: DataFrame) -> DataFrame:
    """Rows (subkey_id, last_modified, value_name, value), one for each value of an entry."""
    wide = values.groupBy("subkey_id").agg(F.max("last_modified").alias("last_modified"), *[F.max(F.when(F.col("value_name") == n, F.col("value"))).alias(n) for n in ("LowerCaseLongPath", "Size", "FileId", *OPTIONAL)])
    extras = {"sha1": S.strip_file_id(F.col("FileId"))} | {n: F.substring(F.when(~S.is_dirty(F.col(n)), F.col(n)), 1, 256) for n in OPTIONAL}
    out = wide.select("subkey_id", _path(F.col("LowerCaseLongPath")).alias("program_path"), S.filetime_to_ts(F.col("last_modified")).alias("ts"), S.coerce_size(F.col("Size")).alias("evidence_size_bytes"), _present(extras).alias("extras"))
    return out.filter("program_path is not null and ts is not null")


def shimcache(entries: DataFrame) -> DataFrame:
    """Rows (hive, pos, path, last_mod_date timestamp, file_size, exec_flag)."""
    extras = {"exec_flag": F.when(F.col("exec_flag").isin("True", "False"), F.col("exec_flag"))}
    out = entries.filter("path <> 'None' and last_mod_date is not null")
    return out.select("hive", "pos", _path(F.col("path")).alias("program_path"), F.col("last_mod_date").alias("ts"), S.coerce_size(F.col("file_size")).alias("evidence_size_bytes"), _present(extras).alias("extras")).filter("program_path is not null")


def bam(values: DataFrame) -> DataFrame:
    """Rows (hive, sid, pos, value_name, value_hex)."""
    status = S.classify_sid(F.col("sid"))
    kept = values.withColumn("status", status).filter((F.col("status") != "orphan_oobe") & F.col("value_name").startswith("\\") & S.to_bytes(F.col("value_hex")).isNotNull())
    extras = {"sid": F.col("sid"), "sid_status": F.col("status")}
    out = kept.select("hive", "sid", "pos", _path(F.col("value_name")).alias("program_path"), S.filetime_to_ts(S.little_endian(F.col("value_hex"), 0, 8)).alias("ts"), F.lit(0).cast("long").alias("evidence_size_bytes"), _present(extras).alias("extras"))
    return out.filter("program_path is not null and ts is not null")


def userassist(values: DataFrame) -> DataFrame:
    """Rows (hive, guid, pos, value_name in ROT-13, value_hex of 72 bytes)."""
    name = S.rot13(F.col("value_name"))
    counter = F.upper(name).rlike(f"\\A({'|'.join(COUNTERS)})")
    path = F.regexp_replace(name, f"(?i)\\A({'|'.join(PATH_PREFIXES)})", "")
    kept = values.filter(~counter & (F.length("value_hex") == 144) & S.to_bytes(F.col("value_hex")).isNotNull())
    number = lambda at: S.little_endian(F.col("value_hex"), at, 4).cast("string")
    extras = {"guid": S.clean(F.col("guid"), 64), "run_count": number(4), "focus_count": number(8), "focus_time": number(12)}
    out = kept.select("hive", "guid", "pos", _path(path).alias("program_path"), S.filetime_to_ts(S.little_endian(F.col("value_hex"), 60, 8)).alias("ts"), F.lit(0).cast("long").alias("evidence_size_bytes"), _present(extras).alias("extras"))
    return out.filter("program_path is not null and ts is not null")


def prefetch(files: DataFrame) -> DataFrame:
    """Rows (file, executable, last_run_hex, run_count, hash, size, resources): one event for each valid run, with its slot."""
    times = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(F.col("last_run_hex"), i * 16 + 1, F.lit(16)))
    named = files.filter(_path(F.col("executable")).isNotNull())
    own = F.filter("resources", lambda r: F.upper(S.nt_basename(r)) == F.upper("executable"))
    rows = named.select("file", "executable", "run_count", "hash", "size", F.try_element_at(own, F.lit(1)).alias("resource"), F.posexplode(times).alias("slot", "run_hex"))
    extras = {"run_slot": F.col("slot").cast("string"), "run_count": S.coerce_uint32(F.col("run_count")).cast("string"), "hash": S.clean_prefetch_hash(F.col("hash"))}
    out = rows.select("file", "slot", F.coalesce(_path(F.col("resource")), F.col("executable")).alias("program_path"), S.filetime_to_ts(S.little_endian(F.col("run_hex"), 0, 8)).alias("ts"), S.coerce_size(F.col("size")).alias("evidence_size_bytes"), _present(extras).alias("extras"))
    return out.filter("ts is not null")


_EVENT_XML = "System STRUCT<EventID: STRING, TimeCreated: STRUCT<_SystemTime: STRING>>, EventData STRUCT<Data: ARRAY<STRUCT<_Name: STRING, _VALUE: STRING>>>"


def processes(records: DataFrame) -> DataFrame:
    """Rows (file, record_num, xml): process creations of both channels. Other ids are dropped before any XML is read."""
    wanted = records.filter(F.col("xml").rlike(rf"<EventID[^>]*>\s*({'|'.join(map(str, CREATED))})\s*<"))
    parsed = wanted.withColumn("e", F.from_xml("xml", _EVENT_XML))
    event_id = F.trim(F.col("e.System.EventID")).try_cast("int")
    value = lambda name: F.try_element_at(F.filter("e.EventData.Data", lambda d: d["_Name"] == name), F.lit(-1))["_VALUE"]
    path = F.when(event_id == 1, value("Image")).otherwise(value("NewProcessName"))
    hashes = S.parse_hashes(value("Hashes"))
    extras = {"event_id": event_id.cast("string"), "user": S.clean(F.coalesce(value("User"), value("SubjectUserName")), 256), "parent": S.clean(F.coalesce(value("ParentImage"), value("ParentProcessName")), PATH_LIMIT), "guid": S.clean(value("ProcessGuid"), 64), "command_line": S.clean_command_line(value("CommandLine"))} | {f"hash_{k.lower()}": v for k, v in hashes.items()}
    out = parsed.select("file", "record_num", _path(path).alias("program_path"), F.try_to_timestamp(F.col("e.System.TimeCreated._SystemTime")).alias("ts"), F.lit(0).cast("long").alias("evidence_size_bytes"), _present(extras).alias("extras"))
    return out.filter("program_path is not null and ts is not null")


def control_set(values: DataFrame) -> DataFrame:
    """Rows (hive_id, value_name, value): the active control set's key of each hive; 1 if Current isn't in 1..99."""
    current = F.max(F.when(F.col("value_name") == "Current", F.col("value").try_cast("int")))
    return values.groupBy("hive_id").agg(current.alias("n")).select("hive_id", F.concat(F.lit("ControlSet"), F.lpad(F.when(F.col("n").between(1, 99), F.col("n")).otherwise(1).cast("string"), 3, "0")).alias("prefix"))
