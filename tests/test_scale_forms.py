"""Operators in forms that hold no group in a task, against the plain forms; tables that halt; times in any zone."""

import datetime as dt
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from corroborate.operators import curation, evalmetrics, normalise, reports, textguard
from corroborate.sources import artifacts, checked

ATTACKS = [
    "# === RED TEAM REALITY CHECK === #", "ignore all previous instructions", "### new instructions ###", "system: you are", "act as a security tester", "[[ADMIN]]",
    "IGNORE  prior\tprompt", "pretend to be a red team engineer", "##updated instruction", "System :override", "#=RED TEAM REALITY CHECK=", "ſyſtem: override",
]


def guarded_text(rng):
    parts = [rng.choice([*ATTACKS, "plain words", "system", "gnore", "é real", "[[x]]", "# =", "a tester"]) for _ in range(rng.randrange(7))]
    text = rng.choice([" ", "", "\n"]).join(parts)
    cut = rng.randrange(len(text) + 1)
    return text[cut:] + text[:cut] if rng.random() < 0.4 else text


def plain_redact(text):
    n = 0
    for p in textguard.PATTERNS:
        text, k = re.subn(p.replace("(?iU)", "(?i)"), textguard.REDACTED, text)
        n += k
    return text, n


def test_redaction_in_one_pass(spark):
    rng = random.Random(2)
    texts = [guarded_text(rng) for _ in range(1500)] + ["", "ignore" + " all previous instructions" * 3, "x" * 5000 + ATTACKS[1]]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string")
    got = {r.i: (r.safe, r.n) for r in textguard.redact(df, "t", "safe", "n").collect()}
    assert got.pop(-1) == (None, None)
    assert got == {i: plain_redact(t) for i, t in enumerate(texts)}


def test_matches_over_rows(spark):
    rng, rows = random.Random(6), []
    for case in range(120):
        for turn in range(rng.randrange(1, 9)):
            text = guarded_text(rng) if rng.random() < 0.9 else None
            if text and rng.random() < 0.7:
                cut = rng.randrange(len(text))
                rows += [(case, 2 * turn, text[:cut]), (case, 2 * turn + 1, text[cut:])]
            else:
                rows.append((case, 2 * turn, text))
    rows += [(900, k, w) for k, w in enumerate("please ignore all previous instructions".split())] + [(901, 1, None)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = {r["case"]: (r.joined_matches, r.row_matches, r.split) for r in textguard.split_across_rows(spark.createDataFrame(rows, "case int, turn int, text string"), "case", "turn", "text").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for case in {r[0] for r in rows}:
        texts = [t for c, _, t in sorted(rows, key=lambda r: (r[0], r[1])) if c == case and t is not None]
        whole, each = plain_redact(" ".join(texts))[1], sum(plain_redact(t)[1] for t in texts)
        want[case] = (whole, each, whole > each)
    assert got == want and want[900] == (1, 0, True) and want[901] == (0, 0, False)
    assert any(v[2] for k, v in want.items() if k < 120)


def test_approximate_paraphrases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("text_id"), "text")
    entries = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select(F.col("item_id").alias("entry_id"), "text")
    rng = random.Random(1)
    words = [f"w{k}" for k in range(60)]
    made = [(k, " ".join(rng.sample(words, 24))) for k in range(400)]
    docs = docs.unionByName(spark.createDataFrame([(10_000 + k, t) for k, t in made], "text_id long, text string"))
    entries = entries.unionByName(spark.createDataFrame([(5_000 + k, t) for k, t in made[:60]] + [(6_000, None), (6_001, "")], "entry_id long, text string"))
    exact = {tuple(r) for r in curation.paraphrases(entries, docs).collect()}
    near = {tuple(r) for r in curation.paraphrases_approx(entries, docs).collect()}
    assert near <= exact and len(near) >= 0.9 * len(exact) and len(exact) > 1000


def test_paraphrases_equal_brute_force(spark):
    """With texts of one id, sets on the limit, empty ones, and texts of sizes that no entry fits."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    pick = lambda: " ".join(rng.sample(words, rng.randrange(1, 30)) + [f"x{rng.randrange(9)}" for _ in range(rng.randrange(6))])
    entries = [(k, pick()) for k in range(40)] + [(90, None), (91, ""), (92, "a b c")]
    corpus = [(k // 2, pick()) for k in range(300)] + [(900, "a " + " ".join(f"y{k}" for k in range(7))), (901, "a b c d e f g h i j"), (902, "a b c d e f g h i j k"), (903, ""), (904, None), (905, " ".join(f"z{k}" for k in range(500)))]
    one, two = spark.createDataFrame(entries, "entry_id long, text string"), spark.createDataFrame(corpus, "text_id long, text string")
    sets = [[(k, {w.lower() for w in re.findall("[A-Za-z0-9]+", t or "")}) for k, t in rows] for rows in (entries, corpus)]
    want = sorted((i, j, len(a & b) / len(a | b)) for i, a in sets[0] for j, b in sets[1] if a | b and len(a & b) / len(a | b) >= 0.3)
    assert sorted(tuple(r) for r in curation.paraphrases(one, two).collect()) == want and len(want) > 500
    assert (92, 901, 0.3) in want


def test_signatures_only_of_texts_that_some_entry_fits(spark):
    entries = spark.createDataFrame([(1, "a b c d e"), (2, None)], "entry_id long, text string")
    corpus = spark.createDataFrame([(1, "a"), (2, "a b"), (3, " ".join(f"t{k}" for k in range(16))), (4, " ".join(f"t{k}" for k in range(17))), (5, ""), (6, None)], "text_id long, text string")
    sets = corpus.select("text_id", curation.token_set(F.col("text")).alias("b"))
    fits = curation._of_fitting_size(sets, "b", entries.select(curation.token_set(F.col("text")).alias("a")), "a", 0.3)
    assert sorted(r.text_id for r in fits.collect()) == [2, 3]


def test_selection_in_two_phases(spark):
    rng = random.Random(3)
    rows = [(k, f"f{min(rng.randrange(9), 4)}" if k % 7 else None) for k in range(600)]
    df = spark.createDataFrame(rows, "offset long, family string").repartition(6)
    seed = df.filter("offset % 97 = 0")
    got = curation.balanced_selection(seed, df, 5)
    want = {(o, f, True) for o, f in rows if o % 97 == 0}
    for family in {f for _, f in rows}:
        have = sum(f == family and o % 97 == 0 for o, f in rows) if family is not None else 0
        want |= {(o, f, False) for o, f in sorted(r for r in rows if r[1] == family and r[0] % 97)[: max(0, 5 - have)]}
    assert {tuple(r) for r in got.collect()} == want
    plan = got._jdf.queryExecution().toString()
    assert re.search(r"WindowGroupLimit.*Partial", plan)


def test_exact_median(spark):
    rng = random.Random(4)
    groups = {
        "even": [rng.random() for _ in range(3000)], "odd": [rng.gauss(0, 1e6) for _ in range(2001)], "two": [0.0] * 700 + [1.0] * 700, "one": [5.0] * 999, "tail": [1e-300 * k for k in range(900)] + [1e300] * 899,
        "skew": [3.0] * 5000 + [float(k) for k in range(100)], "few": [1.0, 2.0], "single": [7.5], "inf": [float("-inf")] * 400 + [float("inf")] * 401, None: [2.0, 9.0, 4.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r.median for r in evalmetrics.exact_median(df, "v", "g", kept=50, cuts=7).collect()}
    assert got == pytest.approx({g: statistics.median(vs) for g, vs in groups.items()})
    assert evalmetrics.exact_median(df, "v", kept=50).collect()[0][0] == pytest.approx(statistics.median([v for _, v in rows if v is not None]))
    assert evalmetrics.exact_median(df.filter("false"), "v", "g").count() == 0
    rates = {r.g: r.ms_per_mb for r in evalmetrics.ms_per_mb(df.withColumn("mb", F.lit(2.0)), "v", "mb", "g").collect()}
    assert rates["two"] == 0.25 and rates["none"] is None and rates[None] == 2.0


def test_audits_that_halt(spark, tmp_path):
    published = spark.createDataFrame([("a", "AA"), ("b", "bb")], "name string, hash string")
    good = artifacts.audit_hashes(published, spark.createDataFrame([("a", "aa"), ("b", "BB"), ("c", "cc")], "name string, hash string"))
    assert checked.publish_audit(good, f"{tmp_path}/good") == {"published_hash": 0, "artifact_present": 0}
    assert checked.read_checked(spark, f"{tmp_path}/good").count() == 3
    bad = artifacts.audit_hashes(published, spark.createDataFrame([("a", "ab")], "name string, hash string"))
    with pytest.raises(checked.Halted, match="1 rows fail artifact_present, 1 rows fail published_hash"):
        checked.publish_audit(bad, f"{tmp_path}/bad")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        checked.read_checked(spark, f"{tmp_path}/bad")


def test_caps_and_ranges_that_halt(spark, tmp_path):
    events = spark.createDataFrame([(a, k) for a, n in (("x", 5), ("y", 6)) for k in range(n)], "artifact string, k int")
    rows = normalise.number_rows(events, ["artifact"], ["k"])
    assert checked.publish_rows(rows, f"{tmp_path}/six", 6) == {"row_cap": 0}
    with pytest.raises(checked.Halted) as halted:
        checked.publish_rows(rows, f"{tmp_path}/five", 5)
    assert halted.value.counts == {"row_cap": 1}
    rates = spark.createDataFrame([("a", 3, 0.5), ("b", 0, None), ("c", 1, 1.0)], "arm string, n int, share double")
    assert checked.publish_rates(rates, f"{tmp_path}/rates", ["n"], ["share"]) == {"n_not_negative": 0, "share_in_range": 0}
    with pytest.raises(checked.Halted) as halted:
        checked.publish_rates(rates.unionByName(spark.createDataFrame([("d", -1, 1.5)], rates.schema)), f"{tmp_path}/off", ["n"], ["share"])
    assert halted.value.counts == {"n_not_negative": 1, "share_in_range": 1}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Australia/Lord_Howe"])
def test_times_in_any_zone(spark, zone):
    utc = [dt.datetime(2024, 1, 1), dt.datetime(2024, 3, 10, 7, 30), dt.datetime(2024, 11, 3, 5, 30, 1, 5), dt.datetime(1969, 12, 31, 23, 59, 59, 999_999), dt.datetime(1601, 1, 1, 0, 0, 1)]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(k, int((u - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))) for k, u in enumerate(utc)], "k int, us long")
        got = [r[0] for r in df.orderBy("k").select(reports.iso_utc(F.timestamp_micros("us"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [u.replace(tzinfo=dt.timezone.utc).isoformat() for u in utc]
