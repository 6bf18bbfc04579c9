"""Views that map the supplied tables onto the domain: the same SQL for Spark and for DuckDB, but for a few words."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_K = {"spark": "cast(get_json_object(props, '$.k') as bigint)", "duckdb": "cast(json_extract_string(props, '$.k') as bigint)"}
_IDIV = {"spark": "div", "duckdb": "//"}
_TS = {"spark": "cast({} as timestamp)", "duckdb": "cast({} as timestamp)"}
_PLUS = {"spark": "timestamp_micros(unix_micros(cast({0} as timestamp)) + cast({1} as bigint) * 1000000)", "duckdb": "make_timestamp(epoch_us({0}) + cast({1} as bigint) * 1000000)"}
_BASE = {"spark": "timestamp'2024-01-01 00:00:00'", "duckdb": "timestamp '2024-01-01 00:00:00'"}
_OLD = {"spark": "timestamp'1601-01-01 00:00:00'", "duckdb": "timestamp '1601-01-01 00:00:00'"}

TABLES = {"evidence": ("events",), "calls": ("events",), "claims": ("orders",), "host_facts": ("customer",), "file_times": ("lineitem",), "eval_rows": ("documents", "labels")}


def view_sql(name: str, dialect: str) -> str:
    plus = _PLUS[dialect].format
    if name == "evidence":
        return f"""
SELECT event_id, concat('case_', cast(user_id % 50 as varchar(20))) AS case_id,
  CASE event_type WHEN 'view' THEN 'get_amcache' WHEN 'click' THEN 'get_userassist' WHEN 'purchase' THEN 'get_bam'
    WHEN 'error' THEN 'get_sysmon_4688' WHEN 'signup' THEN 'get_prefetch' END AS tool,
  concat('C:/Temp/prog', cast({_K[dialect]} % 20 as varchar(20)), '.exe') AS program_path, {_TS[dialect].format("ts")} AS ts,
  cast(floor(value) as bigint) AS evidence_size_bytes FROM events"""
    if name == "calls":
        return f"""
SELECT concat(case_id, '-', tool) AS audit_id, case_id, tool, count(*) AS row_count, min(ts) AS first_event_ts, max(ts) AS last_event_ts
FROM ({view_sql("evidence", dialect)}) e GROUP BY case_id, tool
UNION ALL
SELECT DISTINCT concat('case_', cast(user_id % 50 as varchar(20)), '-get_pslist'), concat('case_', cast(user_id % 50 as varchar(20))), 'get_pslist', cast(0 as bigint), cast(null as timestamp), cast(null as timestamp) FROM events"""
    if name == "claims":
        case = "concat('case_', cast(o_custkey % 50 as varchar(20)))"
        bit = lambda n, tool: f"CASE WHEN o_orderkey {_IDIV[dialect]} {n} % 2 = 1 THEN concat({case}, '-{tool}') END"
        cite = [bit(1, "get_sysmon_4688"), bit(2, "get_amcache"), bit(4, "get_prefetch"), bit(8, "get_bam"), bit(16, "get_userassist")]
        cite += ["CASE WHEN o_orderkey % 17 = 0 THEN concat('ghost-', cast(o_orderkey as varchar(20))) END", f"CASE WHEN o_orderkey % 19 = 0 THEN concat({case}, '-get_pslist') END"]
        ids = f"filter(array({', '.join(cite)}), x -> x is not null)" if dialect == "spark" else f"list_filter([{', '.join(cite)}], lambda x: x IS NOT NULL)"
        return f"SELECT o_orderkey AS claim_id, {case} AS case_id, {ids} AS audit_ids, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS n_signals FROM orders"
    if name == "host_facts":
        written = plus(_BASE[dialect], "c_custkey * 60")
        return f"""
SELECT c_custkey AS case_id, {written} AS system_hive_last_write, {plus(written, "((c_custkey % 5) - 1) * 1800")} AS image_acquisition,
  c_custkey % 3 AS shimcache_rowcount, c_custkey % 9 AS amcache_rowcount, c_custkey % 2 AS prefetch_filecount,
  CASE c_nationkey % 4 WHEN 0 THEN 'Running' WHEN 1 THEN 'Stopped' WHEN 2 THEN 'Disabled' ELSE 'Unknown' END AS sysmain_state FROM customer"""
    if name == "file_times":
        return f"""
SELECT l_orderkey, l_linenumber, {_TS[dialect].format("l_shipdate")} AS fn_btime,
  CASE WHEN l_orderkey % 101 = 0 THEN {_OLD[dialect]} ELSE {plus("l_shipdate", "(2 - l_linenumber) * 43200")} END AS si_btime FROM lineitem"""
    if name == "eval_rows":
        series = "explode(sequence(0, 2))" if dialect == "spark" else "unnest([0, 1, 2])"
        return f"""
SELECT q_id, family, arm, run_idx, (correct <> ((q_id + run_idx) % 7 = 0)) AS correct,
  CASE WHEN arm = 'gated' THEN CASE n_chars % 4 WHEN 1 THEN 'DRAFT' WHEN 2 THEN 'CORROBORATED' WHEN 3 THEN 'FINAL' END END AS claim_status,
  n_chars AS wallclock_ms, n_chars % 1000 AS tokens_in, n_chars % 1000 AS tokens_out
FROM (SELECT d.doc_id AS q_id, concat('family_', cast(d.doc_id % 5 as varchar(20))) AS family, 'gated' AS arm, l.quality = 1 AS correct, n_chars, {series} AS run_idx FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL SELECT d.doc_id, concat('family_', cast(d.doc_id % 5 as varchar(20))), 'bare', l.toxic = 1, n_chars, {series} FROM documents d JOIN labels l ON d.doc_id = l.doc_id) r"""
    raise KeyError(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame over the tables of sf_dir."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]}
    sql = re.sub(rf"\b(FROM|JOIN) ({'|'.join(frames)})\b", r"\1 {\2}", view_sql(name, "spark"))
    return spark.sql(sql, **frames)


def with_views(*names: str) -> str:
    """The beginning of a DuckDB query: a WITH clause of views."""
    return "WITH " + ",\n".join(f"{n} AS ({view_sql(n, 'duckdb')})" for n in names) + "\n"
