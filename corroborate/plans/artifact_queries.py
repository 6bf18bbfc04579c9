"""Queries of the normalisers over the supplied tables, with their SQL; registered with those of the registry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corroborate.functions import scalars
from corroborate.operators import evalmetrics, forgery, normalise
from corroborate.plans.registry import _eval, _read, _rounded, query
from corroborate.plans.views import with_views

_BASE_US = 1_704_067_200_000_000


def _filetime(seconds: Column) -> Column:
    """Seconds after 2024 began as 100 ns units since 1601."""
    return (F.lit(scalars.EPOCH_1601_US + _BASE_US) + seconds.cast("long") * 1_000_000) * 10


def _le_hex(value: Column, size: int) -> Column:
    """A number as little-endian hex text of ``size`` bytes."""
    big = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.concat(*[F.substring(big, 2 * k + 1, 2) for k in reversed(range(size))])


@query(f"""SELECT o_orderkey AS subkey_id, 'c:\\prog\\' || o_orderkey || '.exe' AS program_path, {_BASE_US} + o_orderkey * 1000000 AS us, o_orderkey AS evidence_size_bytes, sha1(o_orderkey::VARCHAR) AS sha1,
  CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END AS publisher FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0""")
def amcache_events(spark, sf_dir):
    """An inventory entry for each order; some without a path, some without a time, some with a dirty publisher."""
    k = F.col("o_orderkey")
    pair = lambda name, value: F.struct(F.lit(name).alias("value_name"), value.alias("value"))
    path = F.when(k % 7 != 0, F.concat(F.lit("c:\\prog\\"), k, F.lit(".exe"))).otherwise("")
    publisher = F.concat("o_orderstatus", F.when(k % 13 == 0, "\u202e").otherwise(""))
    values = F.array(pair("LowerCaseLongPath", path), pair("Size", F.concat(F.lit("0x"), F.hex(k))), pair("FileId", F.concat(F.lit("0000"), F.upper(F.sha1(k.cast("string").cast("binary"))))), pair("Publisher", publisher), pair("Other", F.lit("x")))
    rows = _read(spark, sf_dir, "orders").select(k.alias("subkey_id"), F.when(k % 11 == 0, F.lit(0).cast("long")).otherwise(_filetime(k)).alias("last_modified"), F.inline(values))
    return normalise.amcache(rows).select("subkey_id", "program_path", F.unix_micros("ts").alias("us"), "evidence_size_bytes", F.col("extras")["sha1"].alias("sha1"), F.col("extras")["Publisher"].alias("publisher"))


@query("""SELECT l_orderkey AS hive, l_linenumber AS pos, 'C:\\x\\' || l_partkey AS program_path, epoch_us(l_shipdate::TIMESTAMP) AS us, l_suppkey AS evidence_size_bytes,
  CASE l_linenumber % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'False' END AS exec_flag FROM lineitem WHERE l_orderkey % 7 <> 0 AND l_orderkey % 5 <> 0 AND l_linenumber <> 4 AND l_shipdate IS NOT NULL AND l_partkey IS NOT NULL""")
def shimcache_events(spark, sf_dir):
    path = F.when(F.col("l_orderkey") % 7 == 0, "None").when(F.col("l_orderkey") % 5 == 0, "").otherwise(F.concat(F.lit("C:\\x\\"), "l_partkey"))
    flag = F.when(F.col("l_linenumber") % 3 == 0, "True").when(F.col("l_linenumber") % 3 == 1, "False").otherwise("maybe")
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hive"), F.col("l_linenumber").alias("pos"), path.alias("path"), F.when(F.col("l_linenumber") != 4, F.col("l_shipdate").cast("timestamp")).alias("last_mod_date"), F.col("l_suppkey").alias("file_size"), flag.alias("exec_flag"))
    return normalise.shimcache(rows).select("hive", "pos", "program_path", F.unix_micros("ts").alias("us"), "evidence_size_bytes", F.col("extras")["exec_flag"].alias("exec_flag"))


@query(f"""WITH c AS (SELECT *, CASE c_custkey % 4 WHEN 0 THEN 'S-1-5-18' WHEN 1 THEN 'S-1-5-21-1-2-3-1001' WHEN 2 THEN 'S-1-5-21-1-2-3-500' ELSE 'S-1-5-21-1-2-3-1002' END AS sid FROM customer)
SELECT c_custkey AS pos, '\\Device\\' || c_name AS program_path, {_BASE_US} + c_custkey * 1000000 AS us, sid, CASE c_custkey % 4 WHEN 0 THEN 'system_account' WHEN 2 THEN 'builtin_admin' ELSE 'user_unverified' END AS sid_status
FROM c WHERE c_custkey % 4 <> 1 AND c_custkey % 5 <> 0 AND c_custkey % 9 <> 0""")
def bam_events(spark, sf_dir):
    """Values of customers: orphaned accounts, names that aren't paths and values of 7 bytes go."""
    k = F.col("c_custkey")
    sid = F.when(k % 4 == 0, "S-1-5-18").otherwise(F.concat(F.lit("S-1-5-21-1-2-3-"), F.when(k % 4 == 1, "1001").when(k % 4 == 2, "500").otherwise("1002")))
    name = F.concat(F.when(k % 5 == 0, "Device\\").otherwise("\\Device\\"), "c_name")
    value = F.when(k % 9 == 0, F.lit("00" * 7)).otherwise(F.concat(_le_hex(_filetime(k), 8), F.lit("ff")))
    rows = _read(spark, sf_dir, "customer").select(F.lit("h").alias("hive"), sid.alias("sid"), k.alias("pos"), name.alias("value_name"), value.alias("value_hex"))
    return normalise.bam(rows).select("pos", "program_path", F.unix_micros("ts").alias("us"), F.col("extras")["sid"].alias("sid"), F.col("extras")["sid_status"].alias("sid_status"))


@query(f"""SELECT c_custkey AS pos, 'C:\\' || c_name || '.exe' AS program_path, {_BASE_US} + c_custkey * 1000000 AS us, c_custkey::VARCHAR AS run_count, c_nationkey::VARCHAR AS focus_count, '7' AS focus_time
FROM customer WHERE c_custkey % 6 <> 0 AND c_custkey % 10 <> 1""")
def userassist_events(spark, sf_dir):
    """Values of customers in ROT-13: counters and values of 71 bytes go, a path's prefix is taken off."""
    k = F.col("c_custkey")
    name = F.when(k % 6 == 0, "UEME_CTLSESSION").otherwise(F.concat(F.when(k % 2 == 0, "UEME_RUNPATH:").when(k % 3 == 0, "ueme_runpidl:").otherwise(""), F.lit("C:\\"), "c_name", F.lit(".exe")))
    body = F.concat(F.lit("00" * 4), _le_hex(k, 4), _le_hex(F.col("c_nationkey"), 4), F.lit("07000000" + "00" * 44), _le_hex(_filetime(k), 8), F.lit("00" * 3), F.when(k % 10 == 1, "").otherwise("00"))
    rows = _read(spark, sf_dir, "customer").select(F.lit("h").alias("hive"), F.lit("g").alias("guid"), k.alias("pos"), scalars.rot13(name).alias("value_name"), body.alias("value_hex"))
    extras = F.col("extras")
    return normalise.userassist(rows).select("pos", "program_path", F.unix_micros("ts").alias("us"), extras["run_count"].alias("run_count"), extras["focus_count"].alias("focus_count"), extras["focus_time"].alias("focus_time"))


@query(f"""WITH p AS (SELECT p_partkey, unnest(range(8)) AS slot FROM part)
SELECT p_partkey AS file, slot, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '\\apps\\' END || 'PROG' || p_partkey || '.EXE' AS program_path, {_BASE_US} + (p_partkey + slot) * 1000000 AS us, (p_partkey % 50)::VARCHAR AS run_count FROM p
WHERE slot % 3 <> 1 AND (p_partkey % 2 = 0 OR slot = 0)""")
def prefetch_events(spark, sf_dir):
    """Files of parts with one or eight run slots, of which some are empty; a third of the files don't list their own path."""
    k = F.col("p_partkey")
    slot = lambda i: F.lit("00" * 8) if i % 3 == 1 else _le_hex(_filetime(k + i), 8)
    runs = F.concat(slot(0), F.when(k % 2 == 0, F.concat(*[slot(i) for i in range(1, 8)])).otherwise(""))
    program = F.concat(F.lit("PROG"), k, F.lit(".EXE"))
    resources = F.array(F.lit("\\win\\x.dll"), F.concat(F.when(k % 3 == 0, "\\apps\\no").otherwise("\\apps\\"), program))
    rows = _read(spark, sf_dir, "part").select(k.alias("file"), program.alias("executable"), runs.alias("last_run_hex"), (k % 50).alias("run_count"), F.lit("AB12").alias("hash"), F.lit("0").alias("size"), resources.alias("resources"))
    return normalise.prefetch(rows).select("file", F.col("slot").cast("long").alias("slot"), "program_path", F.unix_micros("ts").alias("us"), F.col("extras")["run_count"].alias("run_count"))


@query("""SELECT event_id AS record_num, 'C:\\' || event_type || '.exe' AS program_path, 1704067200000000 + event_id % 86400 * 1000000 AS us, CASE event_type WHEN 'view' THEN '1' ELSE '4688' END AS id,
  CASE WHEN event_id % 5 <> 0 THEN 'u' || user_id END AS "user", CASE WHEN event_type = 'view' THEN md5(event_id::VARCHAR) END AS md5 FROM events WHERE event_type IN ('view', 'click')""")
def process_events(spark, sf_dir):
    """Event records in XML: two ids are process creations, the others go."""
    k, kind = F.col("event_id"), F.col("event_type")
    number = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
    second = k % 86_400
    time = F.concat(F.lit("2024-01-01T"), number(F.floor(second / 3600)), F.lit(":"), number(F.floor(second / 60) % 60), F.lit(":"), number(second % 60), F.lit("Z"))
    data = lambda name, value: F.concat(F.lit(f'<Data Name="{name}">'), value, F.lit("</Data>"))
    user = F.concat(F.lit("u"), "user_id", F.when(k % 5 == 0, "\u202e").otherwise(""))
    path = F.concat(F.lit("C:\\"), kind, F.lit(".exe"))
    body = F.when(kind == "view", F.concat(data("Image", path), data("NewProcessName", F.lit("no")), data("User", user), data("Hashes", F.concat(F.lit("SHA1=1,MD5="), F.md5(k.cast("string").cast("binary"))))))
    body = body.otherwise(F.concat(data("Image", F.lit("no")), data("NewProcessName", path), data("SubjectUserName", user)))
    event = F.when(kind == "view", "1").when(kind == "click", "4688").otherwise("5")
    xml = F.concat(F.lit("<Event><System><EventID>"), event, F.lit('</EventID><TimeCreated SystemTime="'), time, F.lit('"/></System><EventData>'), body, F.lit("</EventData></Event>"))
    rows = _read(spark, sf_dir, "events").select(F.lit("f").alias("file"), k.alias("record_num"), xml.alias("xml"))
    extras = F.col("extras")
    return normalise.processes(rows).select("record_num", "program_path", F.unix_micros("ts").alias("us"), extras["event_id"].alias("id"), extras["user"].alias("user"), extras["hash_md5"].alias("md5"))


@query("""SELECT s_suppkey AS hive_id, 'ControlSet' || lpad(CASE WHEN s_suppkey % 120 BETWEEN 1 AND 99 THEN s_suppkey % 120 ELSE 1 END::VARCHAR, 3, '0') AS prefix FROM supplier""")
def control_sets(spark, sf_dir):
    pair = lambda name, value: F.struct(F.lit(name).alias("value_name"), value.cast("string").alias("value"))
    values = F.array(pair("Current", F.col("s_suppkey") % 120), pair("Default", F.lit(5)))
    return normalise.control_set(_read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("hive_id"), F.inline(values)))


@query("""WITH f AS (SELECT l_orderkey, min(l_linenumber) AS fault FROM lineitem WHERE l_linenumber >= 3 AND l_orderkey % 4 = 0 GROUP BY 1)
SELECT l.l_orderkey, l_linenumber, fault IS NOT NULL AS partial FROM lineitem l LEFT JOIN f ON l.l_orderkey = f.l_orderkey WHERE fault IS NULL OR l_linenumber < fault""")
def rows_before_fault(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    faults = rows.filter("l_linenumber >= 3 and l_orderkey % 4 = 0")
    return normalise.before_fault(rows, faults, "l_orderkey", "l_linenumber")


@query(f"""{with_views("eval_rows")} SELECT arm, sum(CASE WHEN run_idx = 0 THEN 0 ELSE tokens_in + wallclock_ms END)::BIGINT AS n_in, sum(CASE WHEN run_idx = 0 THEN 0 ELSE tokens_out END)::BIGINT AS n_out,
  round(sum(tokens_in * 3.0 + tokens_out * 15.0) / 1e6, 6) AS cost FROM eval_rows GROUP BY 1""")
def usage_cost(spark, sf_dir):
    """Tokens of each arm as its answers count them (none for the first run), and their price."""
    rows = _eval(spark, sf_dir)
    seen = lambda c: F.when(F.col("run_idx") > 0, F.col(c))
    n_in, n_out = scalars.token_usage(F.struct(seen("tokens_in").alias("input"), seen("wallclock_ms").alias("cache_read"), F.lit(None).cast("long").alias("cache_write"), seen("tokens_out").alias("output")))
    price = evalmetrics.cost(rows, {"tokens_in": 3.0, "tokens_out": 15.0, "not_there": 9.0})
    return _rounded(rows.groupBy("arm").agg(F.sum(n_in).alias("n_in"), F.sum(n_out).alias("n_out"), F.sum(price).alias("cost")))


@query(f"""{with_views("eval_rows")} SELECT q_id, arm, run_idx, CASE WHEN q_id % 3 = 0 THEN arm = 'gated' AND claim_status IS NOT NULL AND claim_status = 'DRAFT' WHEN arm = 'gated' AND q_id % 7 = 0 THEN false ELSE correct END AS verdict FROM eval_rows""")
def question_verdicts(spark, sf_dir):
    kind = F.when(F.col("q_id") % 3 == 0, "adversarial").otherwise("plain")
    answer = F.when(F.col("q_id") % 7 == 0, "<no answer>").otherwise("text")
    verdict = evalmetrics.question_correct(kind, F.col("claim_status"), F.col("arm"), answer, F.col("correct"))
    return _eval(spark, sf_dir).select("q_id", "arm", "run_idx", verdict.alias("verdict"))


@query("""WITH s AS (SELECT s_suppkey, 1 + s_suppkey % 40 AS n, s_suppkey % 7 AS k FROM supplier), t AS (SELECT s_suppkey, k, n, unnest(range(0, n + 1)) AS i FROM s)
SELECT s_suppkey, round(sum(CASE WHEN i >= k THEN exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.3) + (n - i) * ln(0.7)) ELSE 0 END), 6) AS tail FROM t GROUP BY 1""")
def binomial_tails(spark, sf_dir):
    k = F.col("s_suppkey")
    return _rounded(_read(spark, sf_dir, "supplier").select("s_suppkey", forgery.binomial_tail(1 + k % 40, k % 7, F.lit(0.3)).alias("tail")))
