"""Corpora under several keys, synthetic questions, needles in several fields, shares of known and novel attacks, gaps of two arms."""

import json

import pytest
from pyspark.sql import functions as F

from corroborate.operators import evalmetrics, gate, textguard
from corroborate.sources import artifacts


def corpus(spark, folder, value):
    (folder / "c.json").write_text(json.dumps(value))
    return [r.record for r in artifacts.read_corpus(spark, str(folder / "c.json"), strict=True).collect()]


@pytest.mark.parametrize("key", artifacts.LIST_KEYS)
def test_a_corpus_under_a_known_key(spark, tmp_path, key):
    assert corpus(spark, tmp_path, {"version": "2", key: [{"Q": "a"}, {"Q": "b"}]}) == [{"Q": "a"}, {"Q": "b"}]


def test_a_corpus_under_other_keys_is_an_error(spark, tmp_path):
    assert corpus(spark, tmp_path, {"tasks": [{"Q": "late"}], "items": "none", "challenges": [{"Q": "first"}]}) == [{"Q": "first"}]
    for value in ({"rows": [{"Q": "a"}]}, {"questions": "text"}, "text"):
        with pytest.raises(Exception, match="questions/templates/challenges/items/tasks"):
            corpus(spark, tmp_path, value)


def test_synthetic_questions(spark):
    kind = "line_offset long, family string, synthetic_text string, extra_families array<string>, question_type string"
    rows = [(-3, "SysMain", "made up?", ["A", "B"], "count"), (-4, "SysMain", "other?", None, "name"), (0, "AppCompat", None, None, None), (9, "AppCompat", None, None, None)]
    records = spark.createDataFrame([(0, {"Q": "real?", "raw": "bytes"})], "position long, record map<string,string>")
    ok, bad = artifacts.hydrate(records, spark.createDataFrame(rows, kind))
    assert sorted(map(tuple, ok.collect())) == [
        (-4, "SysMain", "other?", "", "synthetic_SysMain_4_name"), (-3, "SysMain", "made up?", "", "synthetic_SysMain_A_B_3_count"), (0, "AppCompat", "real?", "bytes", "q-0"),
    ]
    assert [tuple(r) for r in bad.collect()] == [(9, "AppCompat", "out_of_range")]


def test_a_needle_in_several_fields(spark):
    df = spark.createDataFrame([(1, "C:/EVIL.exe", None, 5), (2, None, "x evil.EXE y", 6), (3, "good", None, 7), (4, None, None, 8)], "id int, program_path string, image string, raw int")
    ids = lambda out: sorted(r.id for r in out.collect())
    assert ids(gate.needle(df, "Evil.exe")) == [1]
    assert ids(gate.needle(df, "evil.exe", ("program_path", "image_path", "image", "path", "raw"))) == [1, 2]
    assert ids(gate.needle(df, "7", ("raw",))) == [3] and ids(gate.needle(df, "x", ("absent",))) == []


def test_shares_of_known_and_novel_attacks(spark):
    rows = [("m", "resisted", False), ("m", "followed", False), ("m", "resisted", True), ("n", "ambiguous", True)]
    got = {r.model: r for r in textguard.outcome_summary(spark.createDataFrame(rows, "model string, outcome string, novel boolean"), "model", "novel").collect()}
    assert (got["m"].resisted_known, got["m"].resisted_novel, got["m"].resisted) == (0.5, 1.0, 2)
    assert (got["n"].resisted_known, got["n"].resisted_novel, got["n"].resisted_share) == (None, 0.0, 0.0)


def test_gaps_of_exactly_two_arms(spark):
    df = spark.createDataFrame([("a", 0.9, 0.8, 0.95), ("b", 0.5, 0.4, 0.6), ("c", 0.55, 0.5, 0.7)], "arm string, accuracy double, ci_low double, ci_high double")
    gap = lambda d: [(r.arm_a, r.arm_b, round(r.difference, 6), r.overlap, r.reading) for r in evalmetrics.two_arm_gap(d).collect()]
    assert gap(df) == [] and gap(df.filter("arm = 'a'")) == []
    assert gap(df.filter("arm <> 'c'")) == [("a", "b", 0.4, False, "significant")]
    assert gap(df.filter(F.col("arm") != "a")) == [("b", "c", -0.05, True, "inconclusive")]
