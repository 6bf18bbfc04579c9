"""Queries of reasons, expectations and report details over the supplied tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corroborate.functions import scalars
from corroborate.operators import evalmetrics, gate, reports, tamper
from corroborate.plans.registry import _E, _FAMILY, _FLUSH, _SUPPRESS, _TIER, _US, _eval, _read, _rounded, query
from corroborate.plans.views import view, with_views


@query(f"""{with_views("host_facts")}, s AS (SELECT *, {_FLUSH} AS flush, {_SUPPRESS} AS off, {_US} AS us FROM host_facts)
SELECT case_id, CASE flush WHEN 'likely' THEN 'tamper_likely_baseflushappcompatcache' ELSE 'ambiguous_legitimate_flush_consistent' END AS reason, 'AppCompat' AS family, printf('no cache entry; hive written %.1f s before acquisition', us / 1000000) AS rationale FROM s WHERE flush IS NOT NULL
UNION ALL SELECT case_id, CASE off WHEN 'likely' THEN 'tamper_likely_sysmain_disabled' ELSE 'ambiguous_sysmain_disabled_operator_plausible' END, 'SysMain', printf('%d inventory rows and no prefetch file; service %s', amcache_rowcount, sysmain_state) FROM s WHERE off IS NOT NULL""")
def signal_rationales(spark, sf_dir):
    return tamper.host_signals(view(spark, sf_dir, "host_facts"))


_AT = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query(f"""{with_views("file_times")}, t AS (SELECT *, si_btime < timestamp '1980-01-01' AND fn_btime >= timestamp '1980-01-01' AS old, epoch_us(si_btime) < epoch_us(fn_btime) - 86400000000 AS back FROM file_times)
SELECT l_orderkey, l_linenumber, 'tamper_likely_mft_timestomp' AS reason, 'AppCompat' AS family,
  CASE WHEN old THEN 'before the threshold: ' ELSE 'set back: ' END || 'standard time ' || {_AT.format("si_btime")} || ', name''s time ' || {_AT.format("fn_btime")} AS rationale FROM t WHERE old OR back""")
def file_signals(spark, sf_dir):
    return tamper.file_signals(view(spark, sf_dir, "file_times"), "l_orderkey", "l_linenumber")


@query(f"""{with_views("evidence")}, g AS (SELECT case_id, lower(program_path) AS program, count(DISTINCT {_FAMILY}) AS n FROM evidence WHERE program_path IS NOT NULL GROUP BY 1, 2),
x AS (SELECT case_id, program, CASE WHEN program LIKE '%2.exe' THEN 'DRAFT' WHEN program LIKE '%3.exe' THEN 'CORROBORATED' ELSE 'FINAL' END AS expected_tier, n FROM g UNION ALL SELECT DISTINCT case_id, 'c:/absent.exe', 'DRAFT', NULL FROM g),
p AS (SELECT *, CASE WHEN n IS NOT NULL THEN {_TIER.format("n")} END AS tier, least(greatest(n, 1), 3) AS got, CASE expected_tier WHEN 'DRAFT' THEN 1 WHEN 'CORROBORATED' THEN 2 ELSE 3 END AS want FROM x)
SELECT case_id, program, expected_tier, tier, CASE WHEN n IS NULL THEN 'missing' WHEN got = want THEN 'met' WHEN got > want THEN 'higher' ELSE 'lower' END AS verdict FROM p""")
def expected_tiers(spark, sf_dir):
    """Every program of every case with the tier that its name asks for, and one program on each case that nothing saw."""
    events = view(spark, sf_dir, "evidence")
    seen = events.filter("program_path is not null").select("case_id", F.upper("program_path").alias("program")).distinct()
    tier = F.when(F.col("program").endswith("2.EXE"), "DRAFT").when(F.col("program").endswith("3.EXE"), "CORROBORATED").otherwise("FINAL")
    absent = events.filter("program_path is not null").select("case_id").distinct().select("case_id", F.lit("C:/absent.exe").alias("program"), F.lit("DRAFT").alias("expected_tier"))
    return gate.expected_tiers(seen.withColumn("expected_tier", tier).unionByName(absent), gate.program_family_tier(events))


@query(f"""{with_views("evidence")} SELECT case_id, arg_max(event_id, (ts, event_id)) AS latest, arg_min(event_id, (ts, event_id)) AS earliest, count(*) AS n, max(evidence_size_bytes) AS largest, strftime(min(ts), '%H:%M') AS first_time FROM evidence WHERE event_id % 3 <> 2 GROUP BY 1""")
def directory_facts(spark, sf_dir):
    """Facts of the events in one folder: written with either slash, in another case, below it; a folder whose name only begins alike isn't it."""
    k = F.col("event_id") % 3
    folder = F.when(k == 0, "c:\\TEMP\\").when(k == 1, "C:/Temp/sub/").otherwise("C:\\Templates\\")
    events = view(spark, sf_dir, "evidence").withColumn("program_path", F.concat(folder, F.lit("prog.exe")))
    return reports.event_facts(events, "case_id", folder="C:\\Temp\\")


@query(f"""{with_views("calls")} SELECT CASE WHEN audit_id LIKE '%bam' THEN 'unknown' ELSE case_id END AS case_id, audit_id, CASE WHEN tool = 'get_pslist' THEN 'finding' ELSE 'evidence' END AS kind FROM calls""")
def case_entries(spark, sf_dir):
    """All calls as findings or evidence of their cases; some name no case."""
    calls = view(spark, sf_dir, "calls")
    named = calls.withColumn("case_id", F.when(~F.col("audit_id").endswith("bam"), F.col("case_id"))).withColumn("tool", F.when(F.col("tool") == "get_pslist", "claim_finding").otherwise(F.col("tool")))
    return reports.case_entries(named).select("case_id", "audit_id", "kind")


@query(f"""{_E} SELECT family, round(avg(correct::INT) FILTER (arm = 'gated'), 6) AS gated, round(avg(correct::INT) FILTER (arm = 'bare'), 6) AS bare, CASE family WHEN 'family_3' THEN 1 WHEN 'family_1' THEN 2 ELSE 3 END::BIGINT AS place FROM eval_rows GROUP BY 1""")
def family_heatmap_ordered(spark, sf_dir):
    table = evalmetrics.family_heatmap(_eval(spark, sf_dir), ["gated", "bare"])
    return _rounded(table.withColumn("place", evalmetrics.family_place(F.col("family"), ("family_3", "family_1"))))


_COUNT = "CASE WHEN count(*) FILTER (arm = 'gated' AND claim_status = '{0}') > 0 THEN '{0}:' || count(*) FILTER (arm = 'gated' AND claim_status = '{0}') END"


@query(f"""{_E} SELECT q_id, min(1000000 - q_id * 3 + run_idx) AS first_seen, min(family) AS family, count(*) FILTER (arm = 'gated' AND correct) AS gated_correct, count(*) FILTER (arm = 'gated') AS gated_runs,
  count(*) FILTER (arm = 'bare' AND correct) AS bare_correct, count(*) FILTER (arm = 'bare') AS bare_runs, concat_ws(',', {", ".join(_COUNT.format(s) for s in ("CORROBORATED", "DRAFT", "FINAL"))}) AS statuses FROM eval_rows GROUP BY 1""")
def question_table(spark, sf_dir):
    rows = _eval(spark, sf_dir).withColumn("row_no", 1_000_000 - F.col("q_id") * 3 + F.col("run_idx"))
    return evalmetrics.question_table(rows, ["gated", "bare"], "row_no", "gated")


@query(f"""{_E}, r AS (SELECT * FROM eval_rows WHERE run_idx = 0 OR q_id % 5 <> 0)
SELECT run_idx, round(avg(correct::INT) FILTER (arm = 'gated') - avg(correct::INT) FILTER (arm = 'bare'), 6) AS arm_delta, sum(wallclock_ms)::BIGINT AS duration_ms, count(DISTINCT q_id) AS questions, count(DISTINCT q_id) < (SELECT count(DISTINCT q_id) FROM eval_rows) AS partial FROM r GROUP BY 1""")
def run_summary_partial(spark, sf_dir):
    """The first run answers every question, the others leave a fifth of them out."""
    rows = _eval(spark, sf_dir)
    asked = rows.agg(F.count_distinct("q_id")).first()[0]  # one number
    return _rounded(reports.run_summary(rows.filter("run_idx = 0 or q_id % 5 <> 0"), "gated", "bare", asked))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 1 THEN lower(printf('%x', p_partkey)) ELSE '' END AS hash FROM part")
def prefetch_hashes(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat(F.hex(k), F.lit("g"))).when(k % 3 == 1, F.hex(k)).otherwise(F.lpad(F.hex(k), 17, "0"))
    return _read(spark, sf_dir, "part").select("p_partkey", scalars.clean_prefetch_hash(text).alias("hash"))


@query("SELECT c_custkey, md5(c_name) AS md5, CASE WHEN c_custkey % 3 <> 0 THEN sha1(c_name) END AS sha1, sha256(c_name) AS sha256 FROM customer")
def hash_labels(spark, sf_dir):
    """Hash lists of customers' names in mixed case; in a third of them one digest is too short."""
    short = F.when(F.col("c_custkey") % 3 == 0, F.substring(F.sha1("c_name"), 1, 39)).otherwise(F.sha1("c_name"))
    found = scalars.parse_hashes(F.concat(F.lit("sha1="), short, F.lit(", MD5="), F.upper(F.md5("c_name")), F.lit(",Sha256="), F.sha2("c_name", 256)))
    return _read(spark, sf_dir, "customer").select("c_custkey", *[found[k].alias(k.lower()) for k in ("MD5", "SHA1", "SHA256")])
