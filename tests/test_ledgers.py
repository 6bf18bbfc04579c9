"""Ledgers: sealing in sorted partitions, verification by ranges, HMAC in the JVM, growing ledgers and tier changes as streams."""

import datetime as dt
import hashlib
import hmac
import json
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corroborate.functions import canon
from corroborate.operators import gate, ledger
from corroborate.streaming import flows

KEY = b"0" * 32
BODY, RAW = "ledger_id string, line_no long, body string", "ledger_id string, line_no long, raw_line string"


def entries(spark, sizes):
    return spark.createDataFrame([(name, n, json.dumps({"audit_id": f"{name}-{n}", "é": n, "z": {"line_hash": "x"}})) for name, k in sizes.items() for n in range(1, k + 1)], BODY)


def plain_verify(rows, key=KEY):
    """Line by line, as a reader of the file would."""
    out = {}
    for name in {r[0] for r in rows}:
        before, bad = ledger.GENESIS, None
        for _, number, text in sorted(r for r in rows if r[0] == name):
            mark, _, good = flows._Tail(key, 1)._judge(text, before)
            if not good and bad is None:
                bad = (number, json.loads(text).get("audit_id"))
            before = mark if mark is not None else ledger.GENESIS
        out[name] = bad or (None, None)
    return out


def verified(spark, rows, key=KEY, **more):
    return {r.ledger_id: (r.first_bad, r.first_bad_id) for r in ledger.verify(spark.createDataFrame(rows, RAW), key, **more).collect()}


def changed(rows, seed):
    rng, out = random.Random(seed), []
    for name, number, text in rows:
        what = rng.random()
        if what < 0.02:
            continue
        if what < 0.04:
            text = text.replace(f"{name}-{number}", f"{name}-{number}x")
        elif what < 0.06:
            text = json.dumps(json.loads(text), indent=1)  # other bytes, the same entry
        elif what < 0.07:
            out.append((name, number, text))
        out.append((name, number, text))
    return out


@pytest.fixture(scope="module")
def sealed(spark):
    return [(r.ledger_id, r.line_no, r.raw_line) for r in ledger.seal(entries(spark, {"a": 40, "b": 7, "c": 1, "d": 90}), KEY).collect()]


@pytest.mark.parametrize("most", [1, 8, 100_000])
def test_verify_by_ranges_equals_a_plain_reader(spark, sealed, most):
    assert verified(spark, sealed, most=most) == {k: (None, None) for k in "abcd"}
    for seed in range(3):
        rows = changed(sealed, seed)
        assert verified(spark, rows, most=most) == plain_verify(rows)
    assert verified(spark, sealed, b"1" * 32, most=most) == {k: (1, f"{k}-1") for k in "abcd"}


def test_no_task_holds_a_ledger(spark, sealed):
    plan = ledger.verify(spark.createDataFrame(sealed, RAW), KEY)._jdf.queryExecution().toString()
    for exchange in re.findall(r"hashpartitioning\(([^)]*)\)", plan.split("Physical Plan")[-1]):
        assert "part#" in exchange or exchange.count("#") == 1  # by ledger alone: only the rows that stand for ranges
    scanned = plan.split("Physical Plan")[-1].rsplit("hashpartitioning(", 1)[-1]
    assert "part#" in scanned.split(")")[0]


@pytest.mark.parametrize("key", [b"k", b"0" * 32, b"long" * 40])
def test_hmac_in_the_jvm(spark, key):
    lines = ledger.seal(entries(spark, {"a": 30, "é": 3}), key)
    both = lines.select("line_hash", canon.stored_hmac(F.col("raw_line"), key).alias("jvm"), canon.line_hmac(F.col("raw_line"), key).alias("python"))
    assert all(r.line_hash == r.jvm == r.python for r in both.collect())
    assert "Python" not in spark.createDataFrame([("a", 1, "{}")], RAW).select(canon.stored_hmac(F.col("raw_line"), key))._jdf.queryExecution().toString()
    odd = spark.createDataFrame([("a", 1, None), ("a", 2, "{}"), ("a", 3, "no json")], RAW)
    assert [r[0] for r in odd.select(canon.stored_hmac(F.col("raw_line"), key)).collect()] == [None] * 3


def test_seal_carries_its_mark_over_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        lines = ledger.seal(entries(spark, {"a": 100, "b": 50}), KEY).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert plain_verify([(r.ledger_id, r.line_no, r.raw_line) for r in lines]) == {"a": (None, None), "b": (None, None)}
    assert ledger.seal(entries(spark, {}), KEY).count() == 0


def tail_of(spark, folder, batches):
    seen = {}
    for part in batches:
        spark.createDataFrame(part, RAW).coalesce(1).write.mode("append").json(f"{folder}/in")
        rows = flows.ledger_tail(spark.readStream.schema(RAW).json(f"{folder}/in"), KEY)
        run = rows.writeStream.outputMode("update").foreachBatch(lambda b, _: seen.update({r.ledger_id: r.asDict() for r in b.collect()})).option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start()
        run.awaitTermination(120)
    return seen


def test_tail_of_shuffled_lines(spark, sealed, tmp_path):
    rows = [r for r in changed(sealed, 4) if r[0] != "b"]
    rows = [r for k, r in enumerate(sorted(rows)) if not k or r[:2] != sorted(rows)[k - 1][:2]]
    numbers = {k: [r[1] for r in rows if r[0] == k] for k in "acd"}
    rows += [r for r in sealed if r[0] != "b" and r[1] not in numbers[r[0]]]
    random.Random(1).shuffle(rows)
    seen = tail_of(spark, tmp_path, [rows[:40], rows[40:80], rows[80:]])
    assert {k: (v["first_bad"], v["first_bad_id"]) for k, v in seen.items()} == verified(spark, rows) == plain_verify(rows)
    assert {k: (v["verified_to"], v["waiting"]) for k, v in seen.items()} == {"a": (40, 0), "c": (1, 0), "d": (90, 0)}


def test_tail_with_gaps_and_repeats(spark, sealed, tmp_path):
    a = {r[1]: r for r in sealed if r[0] == "a"}
    forged = ("a", 3, a[3][2].replace("a-3", "q-3"))
    steps = [[a[1], a[2], a[5]], [a[2], a[4]], [a[3]], [forged]]
    got = []
    for k in range(1, 5):
        seen = tail_of(spark, tmp_path / str(k), steps[:k])["a"]
        got.append((seen["last_line"], seen["verified_to"], seen["waiting"], seen["first_bad"], seen["first_bad_id"], seen["ok"]))
    assert got == [(5, 2, 1, 5, "a-5", False), (5, 2, 2, 4, "a-4", False), (5, 5, 0, None, None, True), (5, 5, 0, 3, "q-3", False)]
    for k in range(1, 4):
        assert verified(spark, sorted(set(sum(steps[:k], []))))["a"] == got[k - 1][3:5]


def at(minute):
    return dt.datetime(2024, 1, 1, 12) + dt.timedelta(minutes=minute)


def test_tier_changes_equal_their_batch_twin(spark, tmp_path):
    tools = [r.tool for r in gate.tools(spark).collect()]
    rng, kind = random.Random(8), "case_id string, tool string, program_path string, ts timestamp"
    rows = [(f"c{rng.randrange(3)}", rng.choice([*tools, "no_such_tool"]), f"C:\\P{rng.randrange(4)}.EXE", at(rng.randrange(600))) for _ in range(160)]
    rows.sort(key=lambda r: r[3])
    late = [r for r in rows[40:60] if rng.random() < 0.3]  # within the watermark: they come one file later
    files = [[r for r in rows[:80] if r not in late], late + rows[80:]]
    files[0] = [r for r in files[0] if r[3] <= max(x[3] for x in rows[:80])]
    wait = "600 minutes"
    gone = ("c0", tools[0], "C:\\LATE.EXE", at(-3000))
    files += [[("c9", tools[0], "end", at(1500))], [gone, ("c9", tools[1], "end", at(1501))]]
    out = []
    for part in files:
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        changes = flows.tier_changes(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), wait)
        run = changes.writeStream.outputMode("append").foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        run.awaitTermination(120)
    final = at(1501) - dt.timedelta(minutes=600)
    seen = [r for part in files for r in part if r != gone]
    twin = [r for r in flows.tier_changes_batch(spark.createDataFrame(seen, kind)).collect() if r["at"] <= final]
    key = lambda r: (r.case_id, r.program, r["at"])
    assert sorted(out, key=key) == sorted(twin, key=key) and len(twin) > 12
    assert {(r.old_tier, r.tier) for r in twin} >= {(None, "DRAFT"), ("DRAFT", "CORROBORATED"), ("CORROBORATED", "FINAL")}


def test_entries_are_numbered_in_the_sort_that_seals_them(spark):
    rows = [(f"c{k % 3}", (k * 7) % 50, json.dumps({"audit_id": f"a{k}", "z": "<prev_hash of this line>", "a": '"line_hash": "<line_hash of this line>", '})) for k in range(90)]
    entries = spark.createDataFrame(rows, "ledger_id string, place long, body string")
    number = F.row_number().over(Window.partitionBy("ledger_id").orderBy("place", "body"))
    want = {tuple(r) for r in ledger.seal(entries.withColumn("line_no", number), KEY).collect()}
    lines = ledger.seal(entries, KEY, order=["place"])
    assert {tuple(r) for r in lines.collect()} == want and len(want) == 90
    for r in lines.collect():
        entry = json.loads(r.raw_line)
        mark = entry.pop("line_hash")
        assert mark == r.line_hash == hmac.new(KEY, json.dumps(entry, sort_keys=True, ensure_ascii=False).encode(), hashlib.sha256).hexdigest()
    heads = ledger.heads(lines)
    more = ledger.seal(entries, KEY, heads, order=["place"])
    both = ledger.verify(lines.unionByName(more), KEY, most=7, counted=True)
    assert {(r.ledger_id, r.ok, r.n_lines) for r in both.collect()} == {(f"c{k}", True, 60) for k in range(3)}


@pytest.mark.parametrize("name", ["recorded_findings", "altered_findings"])
def test_findings_are_sealed_once(spark, name):
    """The lines were made twice, once to verify them and once to count them, and their cases were sorted before that."""
    from __spark_entry__ import queries

    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("row_number") <= 2
