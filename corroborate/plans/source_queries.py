"""Queries of sources, ledgers that were tampered with, and tier changes over the supplied tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corroborate.operators import curation, gate, ledger, textguard
from corroborate.plans.registry import _FAMILY, _TIER, KEY, ORACLE_SQL, WINDOW_SECONDS, _entries, _read, query
from corroborate.plans.views import view, with_views
from corroborate.sources import artifacts
from corroborate.streaming import flows


@query(f"""{with_views("evidence")}, f AS (SELECT case_id, lower(program_path) AS program, {_FAMILY} AS family, min(ts) AS seen FROM evidence WHERE {_FAMILY} IS NOT NULL GROUP BY 1, 2, 3),
t AS (SELECT DISTINCT case_id, program, seen, count(*) OVER w AS n FROM f WINDOW w AS (PARTITION BY case_id, program ORDER BY seen)),
c AS (SELECT *, {_TIER.format("n")} AS tier, lag({_TIER.format("n")}) OVER (PARTITION BY case_id, program ORDER BY seen) AS old_tier FROM t)
SELECT case_id, program, epoch_us(seen) AS at_us, n AS n_families, old_tier, tier FROM c WHERE tier IS DISTINCT FROM old_tier""")
def tier_changes(spark, sf_dir):
    """When a program's tier changes on a case; the batch twin of the stream of changes."""
    out = flows.tier_changes_batch(view(spark, sf_dir, "evidence"))
    return out.select("case_id", "program", F.unix_micros("at").alias("at_us"), F.size("families").cast("long").alias("n_families"), "old_tier", "tier")


@query(f"""{with_views("calls")}, n AS (SELECT case_id, audit_id, row_number() OVER (PARTITION BY case_id ORDER BY audit_id) AS line FROM calls)
SELECT case_id AS ledger_id, min(CASE WHEN case_id LIKE '%7' AND line = 2 THEN audit_id WHEN case_id LIKE '%3' AND line = 4 THEN audit_id END) AS first_bad_id,
  CASE WHEN case_id LIKE '%7' AND count(*) >= 2 THEN 2 WHEN case_id LIKE '%3' AND count(*) >= 4 THEN 4 END AS first_bad,
  NOT ((case_id LIKE '%7' AND count(*) >= 2) OR (case_id LIKE '%3' AND count(*) >= 4)) AS ok FROM n GROUP BY case_id""")
def chain_first_bad(spark, sf_dir):
    """Ledgers of all calls, in which some cases' second line says something else, and others lack their third."""
    lines = ledger.seal(_entries(spark, sf_dir), KEY)
    changed = F.when(F.col("ledger_id").endswith("7") & (F.col("line_no") == 2), F.regexp_replace("raw_line", '"row_count": ', '"row_count": 1')).otherwise(F.col("raw_line"))
    kept = lines.filter(~(F.col("ledger_id").endswith("3") & (F.col("line_no") == 3))).withColumn("raw_line", changed)
    return ledger.verify(kept, KEY, most=3).select("ledger_id", "first_bad_id", "first_bad", "ok")


@query(ORACLE_SQL["recorded_findings"].replace("true AS ok", "NOT (count(*) >= 3 AND CAST(substr(case_id, 6) AS INT) % 2 = 1) AS ok, CASE WHEN count(*) >= 3 AND CAST(substr(case_id, 6) AS INT) % 2 = 1 THEN 3 END AS first_bad"))
def altered_findings(spark, sf_dir):
    """Findings of all claims, sealed; in every other case the third one's hypothesis is then changed."""
    findings = gate.evaluate_claims(view(spark, sf_dir, "claims"), view(spark, sf_dir, "calls"), WINDOW_SECONDS).withColumn("hypothesis", F.concat(F.lit("claim "), "claim_id"))
    lines = ledger.record_findings(findings, KEY)
    odd = (F.substring("ledger_id", 6, 9).cast("int") % 2 == 1) & (F.col("line_no") == 3)
    checked = ledger.verify(lines.withColumn("raw_line", F.when(odd, F.replace("raw_line", F.lit('"claim '), F.lit('"no claim '))).otherwise(F.col("raw_line"))), KEY, counted=True)
    return checked.select("ledger_id", F.col("n_lines").alias("n_findings"), "ok", "first_bad")


@query(f"""{with_views("evidence")}, r AS (SELECT case_id, CASE event_id % 11 WHEN 0 THEN 'missing_path' WHEN 1 THEN 'path_too_long' WHEN 2 THEN 'dirty_path' WHEN 3 THEN 'missing_timestamp' WHEN 4 THEN 'bad_timestamp' WHEN 5 THEN 'bad_size' WHEN 6 THEN 'size_out_of_range' WHEN 7 THEN 'bad_extras' END AS reason, evidence_size_bytes AS size FROM evidence)
SELECT case_id, reason, count(*) AS n, sum(CASE WHEN reason IS NULL THEN size END)::BIGINT AS bytes FROM r GROUP BY 1, 2""")
def expectations_split(spark, sf_dir):
    """Events as sidecars hold them, with a fault of each kind in some: valid rows and rejected ones by their reason."""
    k = F.col("event_id") % 11
    rows = view(spark, sf_dir, "evidence").select(
        "case_id",
        F.when(k == 0, "").when(k == 1, F.repeat(F.col("program_path"), 300)).when(k == 2, F.concat("program_path", F.lit("‮"))).otherwise(F.col("program_path")).alias("program_path"),
        F.when(k == 3, None).when(k == 4, F.lit("2024-01-01T00:00:00")).otherwise(F.lit("2024-01-01T00:00:00+00:00")).alias("timestamp"),
        F.when(k == 5, F.lit("12kb")).when(k == 6, F.lit("99999999999999")).otherwise(F.col("evidence_size_bytes").cast("string")).alias("evidence_size_bytes"),
        F.when(k == 7, F.lit('{"a": 1}')).when(k == 8, F.lit('{"a": "b"}')).alias("extras"),
    )
    ok, bad = artifacts.check_events(rows)
    both = ok.select("case_id", F.lit(None).cast("string").alias("reason"), F.col("evidence_size_bytes").alias("size")).unionByName(bad.select("case_id", "reason", F.lit(None).cast("long").alias("size")))
    return both.groupBy("case_id", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query("""WITH p AS (SELECT 'f' || doc_id AS name, upper(sha256(coalesce(text, ''))) AS hash FROM documents WHERE doc_id % 11 <> 5),
c AS (SELECT 'f' || doc_id AS name, sha256(coalesce(text, '') || CASE WHEN doc_id % 10 = 3 THEN ' ' ELSE '' END) AS hash FROM documents WHERE doc_id % 7 <> 2)
SELECT name, lower(p.hash) AS published, c.hash AS computed, CASE WHEN c.hash IS NULL THEN 'missing' WHEN p.hash IS NULL THEN 'unlisted' WHEN lower(p.hash) = c.hash THEN 'match' ELSE 'mismatch' END AS status FROM p FULL JOIN c USING (name)""")
def hash_audit(spark, sf_dir):
    """Digests of all documents against published ones: some texts altered, some not there, some not listed."""
    docs, text = _read(spark, sf_dir, "documents"), F.coalesce("text", F.lit(""))
    name = F.concat(F.lit("f"), "doc_id")
    published = docs.filter("doc_id % 11 <> 5").select(name.alias("name"), F.upper(F.sha2(text, 256)).alias("hash"))
    computed = docs.filter("doc_id % 7 <> 2").select(name.alias("name"), F.sha2(F.concat(text, F.when(F.col("doc_id") % 10 == 3, " ").otherwise("")), 256).alias("hash"))
    return artifacts.audit_hashes(published, computed)


def _records(spark, sf_dir):
    """Every benchmark item as a corpus record whose text stands under one of several keys, is blank, or isn't a record at all."""
    k = F.col("item_id") % 7
    key = F.when(k == 0, "Q").when(k == 1, "prompt").when(k == 2, "stem").when(k == 3, "text").otherwise("question")
    text = F.when(k == 5, F.lit("  ")).otherwise(F.col("text"))
    return _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("position"), F.when(k != 6, F.create_map(key, text, F.lit("raw"), F.md5("text"))).alias("record"))


@query("""SELECT item_id AS position, CASE item_id % 7 WHEN 0 THEN 'Q' WHEN 1 THEN 'prompt' WHEN 2 THEN 'stem' WHEN 3 THEN 'text' ELSE 'question' END AS text_key FROM benchmark WHERE item_id % 7 < 5""")
def corpus_load(spark, sf_dir):
    loaded = artifacts.load_corpus(_records(spark, sf_dir))
    return loaded.select("position", F.filter(F.map_keys("record"), lambda x: x != "raw")[0].alias("text_key"))


@query("""WITH s AS (SELECT doc_id AS line_offset, source AS family FROM documents)
SELECT line_offset, family, CASE WHEN item_id IS NULL OR item_id % 7 = 6 THEN 'out_of_range' WHEN item_id % 7 = 5 THEN 'missing_text' END AS reason, CASE WHEN item_id % 7 < 5 THEN md5(text) END AS text_md5, CASE WHEN item_id % 7 < 5 THEN 'q-' || line_offset END AS q_id
FROM s LEFT JOIN benchmark ON item_id = line_offset""")
def corpus_hydrate(spark, sf_dir):
    """Every document as a question that points into the corpus of benchmark items: its text, or why there is none."""
    subset = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_offset"), F.col("source").alias("family"))
    ok, bad = artifacts.hydrate(_records(spark, sf_dir), subset)
    empty = F.lit(None).cast("string")
    good = ok.filter("evidence = md5(text)").select("line_offset", "family", empty.alias("reason"), F.md5("text").alias("text_md5"), "q_id")
    return good.unionByName(bad.select("line_offset", "family", "reason", empty.alias("text_md5"), empty.alias("q_id")))


@query("""WITH r AS (SELECT doc_id AS position, doc_id // 3 AS "offset", source AS family, text AS reason FROM documents), k AS (SELECT * FROM r WHERE family <> (SELECT max(source) FROM documents) AND "offset" IN (SELECT doc_id FROM labels)),
f AS (SELECT *, row_number() OVER (PARTITION BY "offset" ORDER BY position) AS n FROM k)
SELECT "offset", family, substr(reason, 1, 200) AS reason FROM f WHERE n = 1""")
def classification_cleanup(spark, sf_dir):
    """Three verdicts an offset, of known and unknown families and offsets: the first known one of each stays."""
    docs = _read(spark, sf_dir, "documents")
    known = tuple(sorted(r[0] for r in docs.filter("source is not null").select("source").distinct().collect())[:-1])  # a handful of names
    rows = docs.select(F.col("doc_id").alias("position"), F.expr("doc_id div 3").alias("offset"), F.col("source").alias("family"), F.col("text").alias("reason"))
    return curation.clean_classification(rows, _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("offset")).distinct(), known)


@query("""WITH t AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS following FROM conversations WHERE text IS NOT NULL OR conv_id % 3 = 0)
SELECT conv_id, count(*) FILTER (conv_id % 3 = 0 AND turn % 2 = 0 AND following % 2 = 1) AS joined_matches, 0 AS row_matches, count(*) FILTER (conv_id % 3 = 0 AND turn % 2 = 0 AND following % 2 = 1) > 0 AS split FROM t GROUP BY 1""")
def split_instructions(spark, sf_dir):
    """Conversations in which an instruction begins at the end of one turn and ends at the start of the next."""
    head = F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") % 2 == 1), "previous instructions ").otherwise("")
    tail = F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") % 2 == 0), " ignore all").otherwise("")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(head, F.coalesce("text", F.lit("")), tail).alias("text"))
    out = textguard.split_across_rows(rows, "conv_id", "turn", "text")
    return out.select("conv_id", "joined_matches", F.col("row_matches").cast("int").alias("row_matches"), "split")


@query()
def banded_paraphrases(spark, sf_dir):
    """The approximate form of jaccard_allpairs; a subset of its rows, whose recall the tests measure."""
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return curation.paraphrases_approx(_read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entry_id"), "text"), docs)
