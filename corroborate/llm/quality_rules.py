"""Quality rules: document statistics, two fixed base rules, and boosted trees over the statistics.

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. The trees are fitted on at most SAMPLE labelled documents
(a documented bound: ids are taken by a hash at the rate that gives about SAMPLE of them, and an id gives one row) and
scored in numpy on every document. Shares of symbols, repeated words and repeated lines can only lower
a score, whatever else holds (monotonic constraints).

Null text: no words, so it fails the base rules, as the empty text does. Null doc_id: judged like any other row.
Repeated rows and equal texts are judged alike, whatever their ids. Very long texts are read whole, in slices. Without usable labels every
document that passes the base rules is kept. An empty table gives an empty result. ``keep_good`` returns all columns of docs as they are,
whatever their names; ``judge`` looks at doc_id and text alone.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm import boosting
from corroborate.llm.common import small_batches, table
from corroborate.llm.textkit import Slice, bounds, shingles, slices

SAMPLE = 8000
#: A document goes if the trees give it less than this probability of quality 1.
KEEP_FROM = 0.35

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "chars_per_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share", "log_line_words", "end_marks")
#: Direction in which a feature may move the score.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1}

_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _LETTER, _DIGIT = _class(b"#*$%&|<>"), _class(bytes(range(65, 91))), _class(bytes([*range(65, 91), *range(97, 123)])), _class(b"0123456789")
_MARK, _END = _class(b"!?.,;:|-_=~^"), _class(b"!?")


def _per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry, is its key found again in its document; for each document, entries beyond the first of their key."""
    again, extra = np.zeros(len(key), bool), np.zeros(len(at) - 1, np.int64)
    for d in range(len(at) - 1):
        one = key[at[d] : at[d + 1]]
        if len(one) > 1:
            order = np.argsort(one, kind="stable")
            same = one[order][1:] == one[order][:-1]
            if same.any():
                twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
                again[at[d] + order[twice]] = True
                extra[d] = same.sum()
    return again, extra


def statistics(part: Slice) -> np.ndarray:
    """BASE and then FEATURES, a row for each document of the slice."""
    data, offsets, n = part.data, part.offsets, part.n
    start, end, document = part.words()
    at = bounds(document, n)
    words = np.diff(at)
    code_points = np.concatenate(([0], np.cumsum(~_CONTINUES[data], dtype=np.int64)))
    in_words = np.concatenate(([0], np.cumsum(code_points[end] - code_points[start])))
    word_chars = in_words[at[1:]] - in_words[at[:-1]]
    symbols = _per_document(_SYMBOL[data], offsets)
    # 5-word windows found twice or more: every word inside one counts
    hashes = part.hash_spans(start, end)
    full = document[: max(0, len(start) - 4)] == document[4:]
    first = np.flatnonzero(full)
    window, owner = shingles(hashes, document, n)
    own = words[owner] >= 5 if len(owner) else np.zeros(0, bool)
    window, owner = window[own], owner[own]
    again, _ = _repeats(window, bounds(owner, n))
    cover = np.zeros(len(start) + 1, np.int64)
    np.add.at(cover, first[again], 1)
    np.add.at(cover, first[again] + 5, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(cover)[:-1] > 0)))
    repeat_words = covered[at[1:]] - covered[at[:-1]]
    # lines with a word, equal to an earlier line
    breaks = np.flatnonzero(data == 10)
    line_start = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks + 1)
    line_start = line_start[line_start < len(data)]
    line_owner = np.searchsorted(offsets, line_start, side="right") - 1
    stop = np.append(line_start[1:], len(data)) if len(line_start) else line_start
    line_end = np.minimum(stop, offsets[line_owner + 1]) if len(line_start) else stop
    line_end = line_end - (data[line_end - 1] == 10) if len(line_start) else line_end
    with_word = np.searchsorted(start, line_start) < np.searchsorted(start, line_end)
    line_start, line_end, line_owner = line_start[with_word], line_end[with_word], line_owner[with_word]
    line_at = bounds(line_owner, n)
    _, dup_lines = _repeats(part.hash_spans(line_start, line_end), line_at)
    _, dup_words = _repeats(hashes, at)
    lines, letters = np.diff(line_at), np.maximum(1, _per_document(_LETTER[data], offsets))
    one, chars = np.maximum(1, words), np.maximum(1, word_chars)
    final = _END[data[end - 1]] if len(end) else np.zeros(0, bool)
    final = np.concatenate(([0], np.cumsum(final)))
    return np.stack(
        [
            words, word_chars, symbols, dup_lines, repeat_words,
            np.log1p(words), word_chars / one, symbols / chars, dup_lines / np.maximum(1, lines), repeat_words / one,
            _per_document(_UPPER[data], offsets) / letters, _per_document(_DIGIT[data], offsets) / chars, _per_document(_MARK[data], offsets) / chars,
            1 - dup_words / one, np.log1p(words / np.maximum(1, lines)), (final[at[1:]] - final[at[:-1]]) / one,
        ],
        axis=1,
    ).astype(float)


def _stats(texts: pa.Array) -> np.ndarray:
    parts = [statistics(x) for x in slices(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(BASE) + len(FEATURES)))


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < 10) | (100 * stats[:, 4] > 20 * stats[:, 0])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stats = _stats(batch.column(0))
        keep = ~base_failed(stats)
        x = stats[keep][:, len(BASE) :]
        yield pa.RecordBatch.from_arrays([pa.array([*x], pa.list_(pa.float64())), batch.column(1).filter(pa.array(keep))], names=["x", "y"])


def labelled(docs: DataFrame, labels: DataFrame, column: str, bound: int, only: str = "true") -> DataFrame:
    """Columns text and y of about ``bound`` labelled rows at most, chosen by a hash of doc_id.

    Labels that are null or not 0/1 and null ids are left out; of several labels of an id the largest counts, and of several
    texts the least, so each chosen id gives one row.
    """
    small_batches(docs.sparkSession)
    labels = labels.filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("y")).filter(only)
    share = min(1.0, bound / max(1, labels.count()))
    chosen = labels.filter((F.expr("pmod(xxhash64(doc_id, 'sample'), 1000000)") < share * 1_000_000))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")).select("text", "y")


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> boosting.Trees:
    """Trees for quality, from documents that pass the base rules; ``bound`` limits the rows that reach the driver."""
    rows = labelled(docs, labels, "quality", bound).mapInArrow(_sampled, "x array<double>, y int").toArrow()
    y = rows.column("y").to_numpy().astype(float)
    x = np.array(rows.column("x").to_pylist(), float).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y))  # the same trees whatever the order of rows
    return boosting.fit(x[order], y[order], np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def _judge(batches: Iterator[pa.RecordBatch], trees: boosting.Trees) -> Iterator[pa.RecordBatch]:
    limit = np.log(KEEP_FROM / (1 - KEEP_FROM))
    for batch in batches:
        stats = _stats(batch.column(batch.schema.get_field_index("text")))
        failed = base_failed(stats)
        margin = trees.margin(stats[:, len(BASE) :])
        kept = ~failed & ((margin >= limit) | (len(trees.roots) == 0))
        columns = [pa.array(stats[:, k].astype(np.int64)) for k in range(len(BASE))]
        columns += [pa.array(failed), pa.array(kept), pa.array(1 / (1 + np.exp(-margin)))]
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *columns], names=[*rest, *BASE, "base_failed", "kept", "quality_score"])


def judge(docs: DataFrame, trees: boosting.Trees) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality_score of each row."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality_score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(functools.partial(_judge, trees=trees), schema)


def _passing(batches: Iterator[pa.RecordBatch], trees: boosting.Trees, text: int) -> Iterator[pa.RecordBatch]:
    limit = np.log(KEEP_FROM / (1 - KEEP_FROM))
    for batch in batches:
        stats = _stats(batch.column(text))
        kept = ~base_failed(stats) & ((trees.margin(stats[:, len(BASE) :]) >= limit) | (len(trees.roots) == 0))
        yield batch.filter(pa.array(kept))


def keep_good(docs: DataFrame, trees: boosting.Trees) -> DataFrame:
    """The rows of docs that ``judge`` keeps, with all their columns, in one pass and without a shuffle."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(functools.partial(_passing, trees=trees, text=docs.columns.index("text")), docs.schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))
