"""Queries of the report tables over the supplied tables, with their SQL; registered with those of the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from corroborate.functions import scalars
from corroborate.operators import gate, ledger, reports, textguard
from corroborate.plans import registry
from corroborate.plans.registry import _FAMILY, _GATE, _PLANTED, _eval, _read, _rounded, KEY, query
from corroborate.plans.views import view, with_views


@query(f"""{with_views("evidence")} SELECT event_id, tool, {_FAMILY} AS family, program_path, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END || '+00:00' AS timestamp FROM evidence WHERE {_FAMILY} IS NOT NULL""")
def wire_rows(spark, sf_dir):
    return reports.wire_rows(view(spark, sf_dir, "evidence"), gate.tools(spark)).select("event_id", "tool", "family", "program_path", "timestamp")


@query(f"""{with_views("evidence")}, x AS (SELECT case_id, {_FAMILY} AS family FROM evidence WHERE tool <> 'get_bam')
SELECT c.case_id, f.family, count(x.family) AS n FROM (SELECT DISTINCT case_id FROM x) c CROSS JOIN (VALUES ('AppCompat'), ('Background-service'), ('Explorer/NTUSER'), ('Kernel-ETW'), ('SysMain')) f(family)
LEFT JOIN x ON x.case_id = c.case_id AND x.family = f.family GROUP BY 1, 2""")
def case_load(spark, sf_dir):
    """All families of all cases; one of them is left empty, as in a case without its artifact."""
    events = view(spark, sf_dir, "evidence").join(gate.tools(spark), "tool")
    parts = {f: events.filter((F.col("family") == f) & (F.col("tool") != "get_bam")) for f in gate.FAMILIES}
    return reports.case_counts(reports.load_cases(parts, ["case_id", "tool", "program_path", "ts"]), list(gate.FAMILIES))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'NEGATIVE_ELAPSED' WHEN o_orderkey % 5 = 0 THEN 'TOKEN_KEYS' END AS problem FROM orders""")
def entry_invariants(spark, sf_dir):
    elapsed = F.when(F.col("o_orderkey") % 11 == 0, -1).otherwise(F.col("o_orderkey") % 11)
    usage = F.when(F.col("o_orderkey") % 5 == 0, F.create_map(F.lit("input"), F.lit(1), F.lit("cached"), F.lit(2))).when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("output"), F.lit(1), F.lit("input"), F.lit(2)))
    return _read(spark, sf_dir, "orders").select("o_orderkey", reports.entry_problem(elapsed, usage).alias("problem"))


@query(f"""{with_views("evidence")}, e AS (SELECT concat(case_id, '-', tool) AS audit_id, * FROM evidence),
p AS (SELECT audit_id, concat('payloads/', audit_id) AS payload_ref, sha256(audit_id) AS pre_sha256, sha256(upper(audit_id)) AS post_sha256 FROM (SELECT DISTINCT audit_id FROM e) WHERE NOT ends_with(audit_id, 'bam'))
SELECT e.audit_id, count(*) AS row_count, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, any_value(payload_ref) AS payload_ref, any_value(pre_sha256) AS pre_sha256, any_value(post_sha256) AS post_sha256
FROM e LEFT JOIN p ON e.audit_id = p.audit_id GROUP BY 1""")
def call_summary(spark, sf_dir):
    events = view(spark, sf_dir, "evidence").withColumn("audit_id", F.concat_ws("-", "case_id", "tool"))
    name = F.col("audit_id")
    payloads = events.select("audit_id").distinct().filter(~F.endswith(name, F.lit("bam")))
    payloads = payloads.select("audit_id", F.concat(F.lit("payloads/"), name).alias("payload_ref"), F.sha2(name, 256).alias("pre_sha256"), F.sha2(F.upper(name), 256).alias("post_sha256"))
    out = reports.call_summary(events, payloads)
    return out.select("audit_id", "row_count", F.unix_micros("first_event_ts").alias("first_us"), F.unix_micros("last_event_ts").alias("last_us"), "payload_ref", "pre_sha256", "post_sha256")


@query("""SELECT conv_id, turn, turn * 7 AS elapsed_ms, replace(coalesce(text, ''), ' the ', ' ') <> coalesce(text, '') AS drift FROM conversations WHERE role <> 'system'""")
def evidence_table(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "system", "claim_finding").otherwise("get_bam").alias("tool"), (F.col("turn") * 7).alias("elapsed_ms"), F.sha2(text, 256).alias("pre_sha256"), F.sha2(F.replace(text, F.lit(" the "), F.lit(" ")), 256).alias("post_sha256"))
    return reports.evidence_table(rows).select("conv_id", "turn", "elapsed_ms", "drift")


@query(_GATE + """SELECT concat('claim ', t.claim_id) AS hypothesis, CASE tr WHEN 0 THEN 'DRAFT_TAMPER_SUSPECTED' WHEN 1 THEN 'DRAFT' WHEN 2 THEN 'CORROBORATED' WHEN 3 THEN 'FINAL' END AS tier,
  CASE tr WHEN 0 THEN 'C0' WHEN 1 THEN 'C2' WHEN 2 THEN 'C4' WHEN 3 THEN 'C5' END AS c_scale, CASE WHEN nf >= 2 THEN 'independent_artifacts' ELSE 'single_family' END AS confirmation_basis,
  t.n_signals > 0 AS demoted_for_tamper, len(l.audit_ids) AS n_cited FROM t JOIN claims l ON t.claim_id = l.claim_id WHERE refusal IS NULL""")
def finding_table(spark, sf_dir):
    """The findings that recorded claims left in their ledgers, read back from the sealed lines."""
    findings = gate.evaluate_claims(view(spark, sf_dir, "claims"), view(spark, sf_dir, "calls"), registry.WINDOW_SECONDS).withColumn("hypothesis", F.concat(F.lit("claim "), "claim_id"))
    out = reports.finding_table(ledger.record_findings(findings, KEY))
    return out.select("hypothesis", "tier", "c_scale", "confirmation_basis", "demoted_for_tamper", F.size("audit_ids").cast("long").alias("n_cited"))


@query("""SELECT concat('doc/', doc_id) AS path, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'unlisted' WHEN doc_id % 9 = 0 THEN 'mismatch' ELSE 'ok' END AS status FROM documents WHERE NOT (doc_id % 11 = 0 AND doc_id % 7 = 0)""")
def payload_integrity(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc/"), "doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    stored = F.upper(F.sha2(F.when(F.col("doc_id") % 9 == 0, F.concat("content", F.lit("."))).otherwise(F.col("content")), 256))
    return reports.payload_integrity(docs.filter("doc_id % 7 <> 0").select("path", stored.alias("sha256")), docs.filter("doc_id % 11 <> 0"))


@query(f"""{with_views("eval_rows")}, r AS (SELECT wallclock_ms - 300 AS a, tokens_in AS b FROM eval_rows) SELECT 'wallclock_ms' AS field, count(*) FILTER (a < 0) AS n FROM r UNION ALL SELECT 'tokens_in', count(*) FILTER (b < 0) FROM r""")
def row_invariants(spark, sf_dir):
    return reports.negative_counts(_eval(spark, sf_dir).withColumn("wallclock_ms", F.col("wallclock_ms") - 300), ["wallclock_ms", "tokens_in"])


@query("""SELECT role AS arm, CASE WHEN role <> 'user' THEN round(avg(CASE WHEN length(coalesce(text, '')) > 0 AND NOT starts_with(text, '<') THEN 1.0 ELSE 0.0 END), 6) END AS confident_rate FROM conversations GROUP BY 1""")
def confident_rate(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").select(F.col("role").alias("arm"), F.col("text").alias("predicted"))
    return _rounded(reports.confident_rate(rows, ["assistant", "system"]))


@query(f"""{with_views("eval_rows")} SELECT run_idx, round(avg(correct::INT) FILTER (arm = 'gated') - avg(correct::INT) FILTER (arm = 'bare'), 6) AS arm_delta, sum(wallclock_ms)::BIGINT AS duration_ms, count(DISTINCT q_id) AS questions, count(DISTINCT q_id) < 1000000 AS partial FROM eval_rows GROUP BY 1""")
def run_summary(spark, sf_dir):
    return _rounded(reports.run_summary(_eval(spark, sf_dir), "gated", "bare", 1_000_000))


@query("""SELECT source AS family, count(*) AS before, count(*) FILTER (lang = 'en') AS after FROM documents GROUP BY 1""")
def scope_counts(spark, sf_dir):
    return reports.scope_counts(_read(spark, sf_dir, "documents").withColumnRenamed("source", "family"), F.col("lang") == "en")


_UUID = "concat_ws('-', substr({0}, 1, 8), substr({0}, 9, 4), substr({0}, 13, 4), substr({0}, 17, 4), substr({0}, 21, 12))"


@query(f"""SELECT o_orderkey, {_UUID.format("md5(o_orderkey::VARCHAR)")} AS last_id, 2 AS n_ids, CASE WHEN o_orderkey % 3 > 0 THEN CASE o_orderkey % 3 WHEN 1 THEN 'FINAL' ELSE 'DRAFT_TAMPER_SUSPECTED' END END AS tier, o_orderkey AS row_count, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 6 END AS n_families FROM orders""")
def tool_text_fields(spark, sf_dir):
    """Answers of tools around each order's number, wrapped and spaced in several ways."""
    uuid = F.expr(_UUID.format("md5(cast(o_orderkey as string))"))
    tier = F.when(F.col("o_orderkey") % 3 == 1, '"tier":"FINAL",').when(F.col("o_orderkey") % 3 == 2, '"tier" : "DRAFT_TAMPER_SUSPECTED",').otherwise('"tier": "OTHER",')
    families = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('"n_distinct_families":'), F.col("o_orderkey") % 6, F.lit(","))).otherwise("")
    text = F.concat(F.lit('<evidence-untrusted>\n{"audit_id": "00000000-0000-0000-0000-000000000000", '), tier, families, F.lit('"audit_id" :"'), uuid, F.lit('", "row_count": '), F.col("o_orderkey"), F.lit("}\n"))
    found = reports.tool_text_fields(text)
    return _read(spark, sf_dir, "orders").select("o_orderkey", F.element_at(found["audit_ids"], -1).alias("last_id"), F.size(found["audit_ids"]).alias("n_ids"), found["tier"].alias("tier"), found["row_count"].alias("row_count"), found["n_families"].alias("n_families"))


@query("""SELECT CASE WHEN doc_id % 13 BETWEEN 1 AND 6 THEN 'known' ELSE 'novel' END AS coverage, count(*) AS n FROM documents GROUP BY 1""")
def coverage_split(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.expr(_PLANTED).alias("text"))
    return reports.coverage_split(textguard.redact(docs, "text", "clean", "matches"), "matches")


# Decoders and guards without a query of their own so far


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey END AS size, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey END AS small, CASE WHEN o_orderkey % 2 = 0 THEN repeat('0', 40) ELSE sha1(o_orderkey::VARCHAR) END AS file_id FROM orders""")
def coerced_fields(spark, sf_dir):
    k = F.col("o_orderkey")
    size = F.when(k % 4 == 0, "-5x").when(k % 4 == 1, F.concat(F.lit("0x"), F.hex(k))).otherwise(k.cast("string"))
    small = F.when(k % 3 == 0, k + (1 << 33)).otherwise(k)
    name = F.when(k % 2 == 0, F.lit("0001")).otherwise(F.lit("0000"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", scalars.coerce_size(size).alias("size"), scalars.coerce_uint32(small).alias("small"), scalars.strip_file_id(F.concat(name, F.upper(F.sha1(k.cast("string").cast("binary"))))).alias("file_id"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'run ' || event_type END AS command_line, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS plain, event_type || '.exe' AS base, 'a?' || event_type AS safe FROM events""")
def cleaned_fields(spark, sf_dir):
    kind, mark = F.col("event_type"), F.when(F.col("event_id") % 5 == 0, F.lit("\u200b")).otherwise(F.lit(""))
    return _read(spark, sf_dir, "events").select(
        "event_id", scalars.clean_command_line(F.concat(F.lit("run "), mark, kind)).alias("command_line"), scalars.clean(F.concat(kind, F.when(F.col("event_id") % 7 == 0, "<").otherwise("")), 4096).alias("plain"),
        scalars.nt_basename(F.concat(F.lit("C:\\\\x\\\\"), kind, F.lit(".exe"))).alias("base"), scalars.safe_field(F.concat(F.lit("a\u202e"), kind), 100).alias("safe"),
    )


@query("""SELECT doc_id, 2 + doc_id % 3 AS stripped, md5(coalesce(text, '')) AS plain_md5 FROM documents""")
def invisible_stripped(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    plain, n = textguard.strip_invisible(F.concat(F.lit("\u200b"), text, F.lit("\ufeff"), F.expr("repeat('\u2060', cast(doc_id % 3 as int))")))
    return _read(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("stripped"), F.md5(plain).alias("plain_md5"))
