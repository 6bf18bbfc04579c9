"""Scans of sidecar envelopes, ledgers, reports and artifact folders, with quarantine instead of failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroborate.functions import scalars as S

EVENT_FIELDS = "program_path STRING, timestamp STRING, evidence_size_bytes STRING, extras STRING"
ENVELOPE = f"schema_version STRING, family STRING, tool STRING, generated_by STRING, generated_at STRING, source_artifact_sha256 STRING, events ARRAY<STRUCT<{', '.join(f.replace(' ', ': ') for f in EVENT_FIELDS.split(', '))}>>"
#: An artifact's place in a case -> tool and family.
PLACES = (
    (r"/registry/Amcache\.hve", "get_amcache", "AppCompat"),
    (r"/registry/SYSTEM", "get_bam", "Background-service"),
    (r"/registry/NTUSER\.DAT", "get_userassist", "Explorer/NTUSER"),
    (r"/Prefetch/[^/]+\.pf", "get_prefetch", "SysMain"),
    (r"/logs/[^/]+\.evtx", "get_sysmon_4688", "Kernel-ETW"),
)
CASE = r"/([A-Za-z0-9._-]+)/(?:registry|Prefetch|logs)/"


def _by_place(path: Column, which: int) -> Column:
    out = F.lit(None).cast("string")
    for place in PLACES:
        out = F.when(path.rlike(place[0]), F.lit(place[which])).otherwise(out)
    return out


def case_inventory(spark: SparkSession, root: str) -> DataFrame:
    """path, case_id, tool, family, length of each known artifact below root; only names and sizes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    found = files.withColumn("case_id", F.regexp_extract("path", CASE, 1)).withColumn("tool", _by_place(F.col("path"), 1)).withColumn("family", _by_place(F.col("path"), 2))
    return found.filter(F.col("tool").isNotNull() & (F.col("case_id") != "") & ~F.contains("case_id", F.lit("..")))


def fingerprint(spark: SparkSession, inventory: DataFrame, root: str) -> DataFrame:
    """Adds sha256 of each artifact's bytes; null if it is gone."""
    digests = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.sha2("content", 256).alias("sha256"))
    return inventory.join(digests, "path", "left")


def audit_hashes(published: DataFrame, computed: DataFrame) -> DataFrame:
    """(name, hash) of both sides, compared in lower case: match, mismatch, missing or unlisted."""
    both = published.select("name", F.lower("hash").alias("published")).join(computed.select("name", F.lower("hash").alias("computed")), "name", "full")
    status = F.when(F.col("computed").isNull(), "missing").when(F.col("published").isNull(), "unlisted").when(F.col("published") == F.col("computed"), "match").otherwise("mismatch")
    return both.withColumn("status", status)


def read_envelopes(spark: SparkSession, glob: str) -> DataFrame:
    """One row for each sidecar file, with its path and what the path implies."""
    docs = spark.read.schema(ENVELOPE).option("multiLine", True).json(glob).withColumn("path", F.col("_metadata.file_path"))
    return docs.withColumn("case_id", F.regexp_extract("path", CASE, 1)).withColumn("expected_tool", _by_place(F.col("path"), 1)).withColumn("expected_family", _by_place(F.col("path"), 2))


def check_envelopes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(family and tool are those of the path, the rest with its reason)."""
    reason = F.when(~F.col("family").eqNullSafe(F.col("expected_family")), "family_mismatch").when(~F.col("tool").eqNullSafe(F.col("expected_tool")), "tool_mismatch")
    judged = docs.withColumn("reason", reason)
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def explode_events(docs: DataFrame) -> DataFrame:
    """One row for each event in source order; no events, no rows."""
    rows = docs.select("case_id", "tool", "family", F.col("path").alias("source_artifact"), F.posexplode("events").alias("row_index", "e"))
    return rows.select("case_id", "tool", "family", "source_artifact", "row_index", "e.program_path", "e.timestamp", "e.evidence_size_bytes", "e.extras")


def check_events(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid events with ts, a numeric size and extras as a map; rejected rows with the first failing rule)."""
    size = F.col("evidence_size_bytes")
    stamp = F.when(F.col("timestamp").rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})\z"), F.try_to_timestamp(F.col("timestamp")))
    extras = F.from_json("extras", "map<string,string>")
    flat = F.col("extras").isNull() | (F.trim("extras").startswith("{") & ~F.col("extras").rlike(r":\s*([0-9\[{]|true|false|null)"))
    path = F.col("program_path")
    reason = (
        F.when(path.isNull() | (path == ""), "missing_path").when(F.length(path) > 4096, "path_too_long").when(S.is_dirty(path), "dirty_path")
        .when(F.col("timestamp").isNull(), "missing_timestamp").when(stamp.isNull(), "bad_timestamp")
        .when(size.isNull() | ~size.rlike(r"\A[0-9]{1,14}\z"), "bad_size").when(size.try_cast("long") > S.SIZE_LIMIT, "size_out_of_range").when(~flat, "bad_extras")
    )
    judged = rows.withColumn("reason", reason)
    ok = judged.filter("reason is null").drop("reason").withColumn("ts", stamp).withColumn("evidence_size_bytes", size.cast("long")).withColumn("extras", extras).drop("timestamp")
    return ok, judged.filter("reason is not null")


LEDGER_LINE = "audit_id STRING, ts STRING, case_id STRING, tool STRING, args_hash STRING, rowcount BIGINT, elapsed_ms BIGINT, first_event_ts STRING, last_event_ts STRING, prev_hash STRING, line_hash STRING"


def read_ledger(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """ledger_id (the file), line_no over lines that aren't blank, raw_line and its fields; a bad line fails or is skipped."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("ledger_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw_line"))
    lines = lines.filter(F.trim("raw_line") != "").withColumn("line_no", F.row_number().over(Window.partitionBy("ledger_id").orderBy("block", "at")).cast("long"))
    parsed = lines.withColumn("e", F.from_json("raw_line", LEDGER_LINE, {"mode": "FAILFAST" if strict else "PERMISSIVE"}))
    if not strict:
        parsed = parsed.filter(F.try_parse_json("raw_line").isNotNull())
    return parsed.select("ledger_id", "line_no", "raw_line", "e.*")


def write_payloads(payloads: DataFrame, existing: DataFrame | None, root: str) -> DataFrame:
    """Writes (case_id, audit_id, tool, content) once; a known id is an error. Returns the manifest."""
    manifest = payloads.select("case_id", "audit_id", "tool", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), F.octet_length("content").alias("bytes"))
    if not manifest.groupBy("audit_id").count().filter("count > 1").isEmpty():
        raise ValueError("an audit_id comes twice")
    if existing is not None and not payloads.join(existing.select("audit_id"), "audit_id", "left_semi").isEmpty():
        raise ValueError("a payload with this audit_id is there already")
    payloads.write.mode("errorifexists" if existing is None else "append").partitionBy("case_id", "tool").parquet(root)
    return manifest


REPORT = "run_id STRING, partial BOOLEAN, started_at STRING, finished_at STRING, per_question ARRAY<STRUCT<q_id: STRING, family: STRING, arm: STRING, run_idx: INT, predicted: STRING, expected_pattern: STRING, correct: BOOLEAN, claim_status: STRING, wallclock_ms: BIGINT, tokens_in: BIGINT, tokens_out: BIGINT>>"


def read_eval_reports(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.schema(REPORT).option("multiLine", True).json(glob).select("run_id", "partial", F.explode("per_question").alias("q")).select("run_id", "partial", "q.*")


def write_eval_report(rows: DataFrame, path: str) -> None:
    """One JSON document for each run, questions in order; a run is as many questions as were asked."""
    fields = sorted(c for c in rows.columns if c != "run_id")
    rows.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("per_question")).write.mode("overwrite").json(path)


# The keys under which an object holds its records, and those of a question's text and of its evidence; the first that is there counts.
LIST_KEYS = ("questions", "templates", "challenges", "items", "tasks")
TEXT_KEYS = ("question", "Q", "prompt", "stem", "text")
EVIDENCE_KEYS = ("evidence", "artifact", "data", "content", "raw")


def read_corpus(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(position, record map) of a corpus file: a JSON list of objects, or an object that holds such a list under one of LIST_KEYS.

    Without one of these keys, the first list of objects counts; if ``strict``, that is an error, as is any other document.
    """
    text = spark.read.text(path, wholetext=True)
    record = "array<map<string,string>>"
    parts = F.from_json("value", "map<string,string>")
    named = [F.when(F.ltrim(parts[k]).startswith("["), F.from_json(parts[k], record)) for k in LIST_KEYS]
    if strict:
        keys = F.coalesce(F.array_join(F.array_sort(F.map_keys(parts)), ", "), F.lit("none"))
        other = F.raise_error(F.concat(F.lit("a corpus is a list, or holds one under " + "/".join(LIST_KEYS) + "; keys: "), keys)).cast(record)
    else:
        other = F.get(F.filter(F.transform(F.map_values(parts), lambda v: F.from_json(v, record)), lambda v: v.isNotNull()), F.lit(0))
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", record)).otherwise(F.coalesce(*named, other))
    return text.select(F.posexplode(listed).alias("position", "record"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The corpus manifest, one row; its declared evidence_mb must be over 0."""
    out = spark.read.option("multiLine", True).json(path)
    if "evidence_mb" not in out.columns or not out.filter("evidence_mb is null or evidence_mb <= 0").isEmpty():
        raise ValueError("a manifest declares evidence_mb over 0")
    return out


def hydrate(corpus: DataFrame, subset: DataFrame) -> tuple[DataFrame, DataFrame]:
    """subset (line_offset, family) with the text of the corpus record (position, record map) there; the rest with a reason.

    Rows with a synthetic_text (where subset has that column, extra_families and question_type too) are questions by themselves: they
    need no record, have no evidence, and are named by family, further families, offset and type.
    """
    first = lambda keys: F.coalesce(*[F.when(F.trim(F.col("record")[k]) != "", F.col("record")[k]) for k in keys])
    made = F.col("synthetic_text") if "synthetic_text" in subset.columns else F.lit(None).cast("string")
    both = subset.withColumn("_made", made).join(corpus.withColumnRenamed("position", "line_offset"), "line_offset", "left")
    name = F.concat_ws("-", F.lit("q"), "line_offset")
    if "synthetic_text" in subset.columns:
        families = F.array_join(F.transform(F.coalesce("extra_families", F.array().cast("array<string>")), lambda f: F.concat(F.lit("_"), f)), "")
        made_name = F.concat(F.lit("synthetic_"), "family", families, F.lit("_"), F.abs("line_offset").cast("string"), F.lit("_"), "question_type")
        name = F.when(F.col("_made").isNotNull(), made_name).otherwise(name)
    judged = both.withColumn("reason", F.when(F.col("_made").isNotNull(), None).when(F.col("record").isNull(), "out_of_range").when(first(TEXT_KEYS).isNull(), "missing_text"))
    evidence = F.when(F.col("_made").isNotNull(), "").otherwise(first(EVIDENCE_KEYS))
    ok = judged.filter("reason is null").select("line_offset", "family", F.coalesce("_made", first(TEXT_KEYS)).alias("text"), evidence.alias("evidence"), name.alias("q_id"))
    return ok, judged.filter("reason is not null").select("line_offset", "family", "reason")


def load_corpus(corpus: DataFrame) -> DataFrame:
    """(position, record map) rows that are objects with text."""
    text = F.coalesce(*[F.col("record")[k] for k in TEXT_KEYS])
    return corpus.filter(F.col("record").isNotNull() & (F.trim(text) != ""))
