"""Reasons of signals, expected tiers, folders, case lists and tables of questions on small rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corroborate.operators import evalmetrics, gate, reports, tamper

NOON = dt.datetime(2024, 1, 1, 12)


def test_host_signals(spark):
    second = dt.timedelta(seconds=1)
    rows = [
        (1, NOON, NOON + 1800 * second, 0, 9, 1, "Running"), (2, NOON, NOON + second, 0, 9, 0, "Disabled"), (3, NOON, NOON + 3601 * second, 0, 5, 0, "Unknown"),
        (4, NOON, NOON, 1, 4, 0, "Stopped"), (5, None, NOON, 0, None, 0, None),
    ]
    facts = spark.createDataFrame(rows, "case_id int, system_hive_last_write timestamp, image_acquisition timestamp, shimcache_rowcount long, amcache_rowcount long, prefetch_filecount long, sysmain_state string")
    assert sorted(map(tuple, tamper.host_signals(facts).collect())) == [
        (1, "tamper_likely_baseflushappcompatcache", "AppCompat", "no cache entry; hive written 1800.0 s before acquisition"),
        (2, "ambiguous_legitimate_flush_consistent", "AppCompat", "no cache entry; hive written 1.0 s before acquisition"),
        (2, "tamper_likely_sysmain_disabled", "SysMain", "9 inventory rows and no prefetch file; service Disabled"),
        (3, "ambiguous_sysmain_disabled_operator_plausible", "SysMain", "5 inventory rows and no prefetch file; service Unknown"),
    ]


def test_file_signals(spark):
    day = dt.timedelta(days=1)
    rows = [(1, dt.datetime(1979, 1, 1), NOON), (2, NOON - 2 * day, NOON), (3, NOON - day, NOON), (4, NOON, NOON - day), (5, None, NOON)]
    out = tamper.file_signals(spark.createDataFrame(rows, "id int, si_btime timestamp, fn_btime timestamp"), "id").collect()
    assert {r.id: r.rationale.split(":")[0] for r in out} == {1: "before the threshold", 2: "set back"}
    assert {(r.reason, r.family) for r in out} == {("tamper_likely_mft_timestomp", "AppCompat")}


def test_signals_without_facts(spark):
    facts = spark.createDataFrame([], "case_id int, system_hive_last_write timestamp, image_acquisition timestamp, shimcache_rowcount long, amcache_rowcount long, prefetch_filecount long, sysmain_state string")
    assert tamper.host_signals(facts).count() == 0


def test_expected_tiers(spark):
    graded = spark.createDataFrame([("c", "a.exe", "FINAL"), ("c", "b.exe", "DRAFT"), ("d", "a.exe", "CORROBORATED")], "case_id string, program string, tier string")
    expected = spark.createDataFrame([("c", "A.exe", "FINAL"), ("c", "b.exe", "CORROBORATED"), ("d", "a.exe", "DRAFT"), ("d", "b.exe", "DRAFT")], "case_id string, program string, expected_tier string")
    assert {(r.case_id, r.program): (r.tier, r.verdict) for r in gate.expected_tiers(expected, graded).collect()} == {
        ("c", "a.exe"): ("FINAL", "met"), ("c", "b.exe"): ("DRAFT", "lower"), ("d", "a.exe"): ("CORROBORATED", "higher"), ("d", "b.exe"): (None, "missing"),
    }


@pytest.mark.parametrize("folder", ["C:\\Temp", "c:/temp/", "C:\\TEMP\\"])
def test_paths_in_a_folder(spark, folder):
    paths = ["C:\\Temp\\a.exe", "c:/temp/x/b.exe", "C:\\Temp", "C:\\Temperature\\a.exe", "D:\\C:\\Temp\\a", None]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select(reports.in_directory(F.col("p"), folder).alias("x")).collect()
    assert [r.x for r in rows] == [True, True, False, False, False, None]


def test_entries_of_a_case(spark):
    entries = spark.createDataFrame([("a", "get_bam", 1), ("a", "claim_finding", 2), (None, "get_bam", 3), ("b", None, 4)], "case_id string, tool string, n int")
    listed = lambda out: sorted((r.n, r.case_id, r.kind) for r in out.collect())
    assert listed(reports.case_entries(entries)) == [(1, "a", "evidence"), (2, "a", "finding"), (3, "unknown", "evidence"), (4, "b", "evidence")]
    assert listed(reports.case_entries(entries, "a")) == [(1, "a", "evidence"), (2, "a", "finding")] and listed(reports.case_entries(entries, "z")) == []


def test_table_of_questions(spark):
    rows = [(7, "q2", "f", "gated", True, "FINAL"), (5, "q2", "f", "gated", False, "DRAFT"), (6, "q2", "f", "gated", None, "FINAL"), (3, "q1", "g", "bare", True, "FINAL"), (9, "q2", "f", "bare", False, None)]
    df = spark.createDataFrame(rows, "row_no int, q_id string, family string, arm string, correct boolean, claim_status string")
    got = [tuple(r) for r in evalmetrics.question_table(df, ["gated", "bare"], "row_no", "gated").orderBy("first_seen").collect()]
    assert got == [("q1", 3, "g", 0, 0, 1, 1, ""), ("q2", 5, "f", 1, 3, 0, 1, "DRAFT:1,FINAL:2")]


def test_families_in_order(spark):
    df = spark.createDataFrame([(f,) for f in ("Zeta", "SysMain", "BAM", "Alpha", "AppCompat")], "family string")
    assert [r.family for r in df.orderBy(evalmetrics.family_place(F.col("family")), "family").collect()] == ["AppCompat", "BAM", "SysMain", "Alpha", "Zeta"]
