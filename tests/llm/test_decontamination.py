"""Decontamination against brute force: random texts and items, tiles, odd rows."""

import hashlib
import random
import re

import pytest

from corroborate.llm import decontamination as dc

DOCS, ITEMS = "doc_id long, text string, window int, place int, item_id int", "item_id string, text string, document string, k int"
FOLD = str.maketrans(dc.UPPER, dc.LOWER)


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(FOLD))


def brute(docs, items, window=10):
    out = []
    for i, t in docs:
        w, hit, named = words(t), set(), set()
        for item, u in items:
            v = words(u)
            size = min(window, len(v))
            for s in range(len(v) - size + 1 if v else 0):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == v[s : s + size]:
                        hit.update(range(p, p + size))
                        named.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), sorted(named)))
    return sorted(out, key=repr)


def found(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "d", 4) for i, t in items], ITEMS)
    return sorted((tuple(r) for r in dc.contaminated(d, b, **more).collect()), key=repr)


def a_text(rng, kinds, n):
    return " ".join(rng.choice(["W", "w", "é", "9"]) + str(rng.randrange(kinds)) + rng.choice(["", ",", "!\n"]) for _ in range(n))


def odd():
    rng = random.Random(4)
    items = [(str(k), a_text(rng, 3, rng.choice([1, 2, 3, 9, 10, 11, 25]))) for k in range(12)]
    items += [(None, "only null names this"), ("7", "a second row of item seven"), ("12", items[5][1]), ("13", None), ("14", " ., "), ("15", "a a a a a a a a a a a a a a")]
    docs = [(k, " ".join(rng.choice([a_text(rng, 3, 8), rng.choice(items)[1] or ""]) for _ in range(rng.randrange(1, 6)))) for k in range(25)]
    docs += [(30, None), (31, ""), (32, "\x00 ;"), (None, items[3][1]), (None, None), (33, "A a " * 400), (33, "A a " * 400), (34, "only null names THIS and a second row of item seven"), (34, "x")]
    return docs, items


@pytest.mark.parametrize("tile", [7, 200_000])
def test_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(dc, "TILE", tile)
    monkeypatch.setattr(dc, "SHINGLE_TILE", tile)
    docs, items = odd()
    assert found(spark, docs, items) == brute(docs, items)


def test_other_windows(spark):
    docs, items = odd()
    assert found(spark, docs, items, window=4, shingle=2) == brute(docs, items, 4)


def test_empty_tables(spark):
    docs, items = odd()
    assert found(spark, [], items) == []
    assert found(spark, docs, []) == brute(docs, [])
    assert found(spark, docs, [("1", None), ("2", "")]) == brute(docs, [])


def test_query_columns(spark):
    got = dc.op12_decontamination(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    rows = got.collect()
    assert any(r.contaminated for r in rows)
    assert all(r.items_sha256 == hashlib.sha256(b"").hexdigest() for r in rows if not r.contaminated)


def test_texts_are_not_shuffled_and_no_python_runs(spark):
    docs, items = odd()
    d = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], DOCS)
    known, _ = dc.windows_of(spark.createDataFrame([(i, t, "d", 4) for i, t in items], ITEMS))
    plan = dc._passing(d, [3]).join(dc.F.broadcast(known), dc.F.col("h") == dc.F.col("window"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange hashpartitioning" not in plan
