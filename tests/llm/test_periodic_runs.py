"""Periodic runs against brute force: random words with repeats, whole queries, and odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corroborate.llm import periodic_runs
from corroborate.llm.common import table

DATA = "/root/testdata/sf0.001"


def brute(ids, least=12):
    n, found = len(ids), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if ids[i] != ids[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.append((i, j + q, q))
            i = j
    smallest = lambda s, e, q: not any(ids[s : e - p] == ids[s + p : e] for p in range(1, q))
    return sorted((r for r in found if smallest(*r)), key=lambda r: (r[0], r[2]))


def some_words(rng):
    kinds, out = rng.choice([1, 2, 2, 3, 5, 50]), []
    for _ in range(rng.randrange(9)):
        if out and rng.random() < 0.5:
            a = rng.randrange(len(out))
            p = rng.randrange(1, min(20, len(out) - a) + 1)
            out += [out[a + i % p] for i in range(rng.randrange(1, 40))]
        else:
            out += [rng.randrange(kinds) for _ in range(rng.randrange(1, 15))]
    return out


@pytest.mark.parametrize("least", [4, 12])
def test_runs_of_random_words(least):
    rng = random.Random(least)
    for _ in range(300):
        docs = [some_words(rng) for _ in range(rng.randrange(1, 5))]
        ids = np.array([x for d in docs for x in d], np.int64)
        got = periodic_runs.runs_of(ids, np.repeat(np.arange(len(docs)), [len(d) for d in docs]), least)
        begin, want = 0, []
        for d in docs:
            want += [(s + begin, e + begin, q) for s, e, q in brute(d, least)]
            begin += len(d)
        assert [tuple(map(int, r)) for r in got] == want


def test_long_periods_and_one_word(monkeypatch):
    monkeypatch.setattr(periodic_runs, "CHUNK", 1000)
    for ids in (np.zeros(60_000, np.int64), np.arange(60_000) % 7, np.arange(60_000) % 9_999):
        assert periodic_runs.runs_of(ids, np.zeros(60_000, np.int64)).tolist() == [[0, 60_000, int(ids.max()) + 1]]


def test_the_grammar_derives_the_text():
    rng = random.Random(3)
    for _ in range(50):
        docs = [w for w in (some_words(rng) for _ in range(3)) if w]
        if not docs:
            continue
        ids, zone = np.unique(np.array([x for d in docs for x in d]), return_inverse=True)[1], np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        g = periodic_runs.Grammar(ids, zone)
        text = lambda s: [s] if s < g.terminals else text(int(g.left[s])) + text(int(g.right[s]))  # noqa: E731, B023
        assert sum((text(int(r)) for r in g.roots), []) == ids.tolist()
        for s in range(g.terminals, g.n):
            assert text(s) == ids[g.place[s] : g.place[s] + g.length[s]].tolist()


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words) if n < 3000 else [tuple(r) for r in periodic_runs.runs_of(np.unique(words, return_inverse=True)[1], np.zeros(n, np.int64)).tolist()]
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(((s - e, s, q) for s, e, q in runs), default=None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    first = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, digest("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_brute_force(spark):
    got = periodic_runs.op13_periodic_runs(spark, DATA)
    docs = table(spark, DATA, "documents").select("doc_id", "text").collect()
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(expected(r.doc_id, r.text) for r in docs)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (None, "a b " * 9), (None, None), (4, "x " * 5000), (4, "x " * 5000), (5, "é ñ　ü " * 7 + "z"), (6, "one two three"),
        (7, "v" * 70_000 + " w"), (20, "k l m"), (8, "a b c d e f g h i j k l " * 2), (8, "p q " * 6 + "p"), (9, " ".join(f"w{i}" for i in range(90))),
    ]
    df = spark.createDataFrame([(i, t, "c", 1, 2) for i, t in rows], "doc_id long, text string, runs string, n_words int, h int")
    found = periodic_runs.periodic_runs(df).collect()
    want = lambda t: [(s, e - s, q) for s, e, q in brute(re.findall(r"[^\x20\x09-\x0D]+", t or ""))] if len(t or "") < 5000 else None
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(([tuple(x) for x in r.runs], r.collapsed))
    assert by[4] == [([(0, 5000, 1)], "x")] * 2
    assert sorted(by[None]) == [([], ""), (want("a b " * 9), "a b")]
    assert by[5] == [(want("é ñ　ü " * 7 + "z"), "é ñ　ü z")]
    assert by[1] == by[2] == by[3] == [([], "")]
    assert sorted(by[8]) == sorted([([(0, 24, 12)], "a b c d e f g h i j k l"), ([(0, 13, 2)], "p q")])
    assert by[7] == [([], "v" * 70_000 + " w")]
    assert periodic_runs.periodic_runs(df.filter("false")).count() == 0


def test_planted_texts(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(" a  b\tc d e f g h").alias("text"))
    for r in periodic_runs.planted(df).collect():
        words = "a b c d e f g h".split()
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % 8
            p = 1 + (8 - a) // (3 + g % 8)
            assert r.text.split() == words[:a] + [words[a + (i - a) % p] for i in range(a, 8)]
        else:
            assert r.text == " a  b\tc d e f g h"
