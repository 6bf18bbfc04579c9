"""Spelling variants against brute force: random vocabularies, hot nodes, long words, odd rows."""

import random
import re
import zlib
from collections import Counter

import pytest

from corroborate.llm import common
from corroborate.llm import spelling_variants as sv

SCHEMA = "doc_id long, text string, word int, n int, edge string"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(words):
    out = {}
    for w, n in words.items():
        around = [v for v in words if near(w, v)]
        best = min(around, key=lambda v: (-words[v], v), default=None)
        out[w] = (best if best is not None and words[best] >= 5 * n else None, n, len(around))
    root = lambda w: w if out[w][0] is None else root(out[w][0])
    return sorted((w, f, root(w), n, k, words.get(f)) for w, (f, n, k) in out.items())


def result(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in df.collect())


def made_up(seed, letters="abé", sizes=(2, 9), many=220):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(*sizes))): 5 ** rng.randrange(1, 8) for _ in range(many)}
    tail = "".join(rng.choice("xy") for _ in range(300))
    return words | {tail: 7, tail[:150] + "q" + tail[151:]: 40, tail[1:]: 900, tail + "é": 36, "z" * 400: 5, "z" * 399: 30, "z" * 401: 5, "z" * 398 + "y": 2000}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_words_of_random_vocabularies(spark, seed):
    words = made_up(seed)
    assert result(sv.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == brute(words)


def test_hot_nodes_are_split(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 20)
    words = made_up(5, "ab", (6, 9), 400) | {"common" + a + b: 9 for a in "abcdefghij" for b in "klmnopqrst"}
    assert result(sv.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == brute(words)


def damaged(rows):
    found = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def test_odd_rows(spark):
    rng = random.Random(9)
    stems = ["Zebras", "zebras", "ZÉBRAS", "zébras", "zebra", "zebrass", "œuvre", "straße", "overÀll×es", "x" * 20_000]
    rows = [(k % 400, " ".join(rng.choice(stems) + rng.choice([",", "1", "-", " "]) for _ in range(30))) for k in range(600)]
    rows += [(None, None), (1, ""), (2, "12 34"), (None, "zebras " * 50), (3, "Zebras " * 4000), (3, "Zebras " * 4000)]
    df = spark.createDataFrame([(i, t, 1, 2, "e") for i, t in rows], SCHEMA)
    words = damaged(rows)
    assert any(len(w) in (19_999, 20_000) for w in words) and len(words) > 8
    got = sv.vocabulary(df)
    assert {r.word: r.n for r in got.collect()} == words
    assert result(sv.spelling_variants(got)) == brute(words)


def test_empty(spark):
    assert result(sv.spelling_variants(sv.vocabulary(spark.createDataFrame([], SCHEMA)))) == []
    assert result(sv.spelling_variants(spark.createDataFrame([("lonely", 6)], "word string, n long"))) == [("lonely", None, "lonely", 6, 0, None)]
