"""Words, lines and units that a polynomial hash can't tell apart: the Thue-Morse word and its complement, in each operator that hashes."""

import re
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corroborate.llm import ngram_jaccard, packing, passages, quality_rules, textkit, token_counts, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def thue_morse(n, flip=False):
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


@pytest.fixture(scope="module", params=[1024, 2048, 8192])
def pair(request):
    return thue_morse(request.param), thue_morse(request.param, True)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)


def test_spans_differ(pair):
    part = next(textkit.slices(pa.array([" ".join(pair)])))
    start, end, _ = part.words()
    assert len(np.unique(part.hash_spans(start, end))) == 2


def test_digests_depend_on_the_bytes_alone():
    rng = np.random.default_rng(7)
    units = list(dict.fromkeys([b"", b"\0", b"\0\0", b"\0" * 8, b"\0" * 9, b"a" * 1024, b"a" * 1025, b"b" * 1025] + [rng.bytes(int(n)) for n in rng.integers(1, 1100, 3000)]))
    found = textkit.digests(pa.array(units, pa.large_binary()))
    assert len(np.unique(found)) == len(units)
    order = rng.permutation(len(units))
    mixed = pa.array([units[k] for k in order], pa.large_binary()).slice(5, 400)
    assert (textkit.digests(mixed) == found[order[5:405]]).all() and not len(textkit.digests(mixed.slice(0, 0)))


def test_packed_ids_and_token_counts(spark, pair):
    df, tok = frame(spark, [pair[0], pair[1], " ".join(pair)]), vocabulary.tokenizer(packing.FILE)
    for r in packing.tokenised(df, keep_ids=True).collect():
        ids = tok.encode([pair[0], pair[1], " ".join(pair)][r.doc_id], add_special_tokens=False).ids + [packing.END]
        piece = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(piece) and bytes(r.ids) == piece
    count = vocabulary.tokenizer(token_counts.FILE)
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df).collect()} == {i: len(count.encode(t, add_special_tokens=False).ids) for i, t in enumerate([pair[0], pair[1], " ".join(pair)])}


def test_units_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(vocabulary, "digests", lambda units: np.zeros(len(units), np.uint64))
    known = vocabulary.UnitTable(lambda texts: [[len(t), ord(t[0])] for t in texts])
    for text in ("aa b ccc aa", "b ccc dddd aa", "ccc"):
        part = next(textkit.slices(pa.array([text])))
        start, end, _ = part.words()
        assert known.ids(known.rows(part, start, end)).tolist() == [v for w in text.split() for v in (len(w), ord(w[0]))]


def test_a_table_of_units_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(vocabulary, "KEPT_BYTES", 50_000, raising=False)
    known, rng = vocabulary.UnitTable(lambda texts: [[len(t), ord(t[0])] for t in texts]), np.random.default_rng(5)
    for _ in range(60):
        words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 400)) for _ in range(20)]
        part = next(textkit.slices(pa.array([" ".join(words + words[:3])])))
        start, end, _ = part.words()
        assert known.ids(known.rows(part, start, end)).tolist() == [v for w in words + words[:3] for v in (len(w), ord(w[0]))]
        assert known.body.n + 4 * known.pool.n <= 50_000 and len(known.body.room) <= 100_000


def test_the_tokenizer_has_no_threads_of_its_own(monkeypatch):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    monkeypatch.setattr(vocabulary, "_loaded", {})
    vocabulary.tokenizer(packing.FILE)
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"


def test_lines_and_windows(pair):
    part = next(textkit.slices(pa.array(["\n".join(pair), "\n".join([pair[0]] * 2), " ".join(["x y z"] + list(pair) + ["x y z", pair[1], pair[0]])])))
    assert quality_rules.statistics(part)[:, :5].astype(int).tolist() == [[2, 2 * len(pair[0]), 0, 0, 0], [2, 2 * len(pair[0]), 0, 1, 0], [10, 6 + 4 * len(pair[0]), 0, 0, 0]]


def test_sets_of_shingles(spark, pair):
    got = ngram_jaccard.jaccard_components(frame(spark, [f"one two {pair[0]} four", f"one two {pair[1]} four", f"one two {pair[0]} four"]))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(0, 0), (1, 1), (2, 0)]


def test_passages(spark, pair):
    words = [pair[int(b)] for b in re.sub("[^01]", "", bin(0x5DEECE66D5DEECE66D5DEECE66D)[2:])][:60]
    other = [pair[1] if w == pair[0] else pair[0] for w in words]
    assert passages.shared_passages(frame(spark, [" ".join(words), " ".join(other)])).filter("doc_id = 1 and source_doc_id = 0").isEmpty()
    assert not passages.shared_passages(frame(spark, [" ".join(words), " ".join(words)])).isEmpty()
