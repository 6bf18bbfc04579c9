"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding: lower case, look-alike letters of other scripts and full-width ones to plain ones (accented letters
stay, they tell words of one language apart), combining marks and zero-width characters dropped, digits and signs inside
words to the letters they stand for, everything else between
words to one space. The lexicon holds whole words and word beginnings with a weight each, learned from at
most SAMPLE labelled documents (a documented bound): terms whose share among toxic documents far exceeds
that among others. A hit inside an exception phrase does not count; phrases are given, or learned as
pairs of words around all hits of the same documents: those in EXCEPTION or more that are not toxic, and in no toxic one. The weights' sum, by itself and per word of the text, goes
through a logistic curve fitted on the same rows.

Null and empty texts are scored as texts without hits. Very long texts are read whole. Null ids and repeated rows are scored like any
other, equal texts alike. An empty table gives an empty result. Columns other than doc_id and text aren't looked at.
Without toxic labels the lexicon is empty and every score is the share of toxic rows, 0 if there are none.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm.common import scratch, small_batches, table
from corroborate.llm.quality_rules import labelled

SAMPLE = 12_000
#: Documents that a phrase needs to be an exception.
EXCEPTION = 3
#: Letters of a word's beginning that can be a term.
SHORTEST, LONGEST = 3, 10
#: A term needs this many toxic documents, these log-odds against the others, this product of the two, and
#: this much more than the best kept beginning of itself.
LEAST, ODDS, EVIDENCE, GAIN = 4, 1.5, 12.0, 0.7

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝвкмнтгαεικνορτυχѵөıɡɑ", "aeopcyxijshdqwbkmhtraeikvoptuxvoiga"))
#: What digits and signs stand for inside words.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
_INVISIBLE = "­​‌‍⁠﻿"


def _letters() -> dict[int, str | None]:
    import unicodedata

    out: dict[int, str | None] = {ord(c): None for c in _INVISIBLE} | {ord(k): v for k, v in LOOKALIKES.items()}
    for code in [*range(0xFF01, 0xFF5F), *range(0x2460, 0x2500), *range(0x1D400, 0x1D800)]:
        plain = unicodedata.normalize("NFKC", chr(code)).lower()
        if len(plain) == 1 and plain.isascii():
            out[code] = plain
    return out | {code: None for code in range(0x300, 0x370)}


_FOLD = _letters()
_LEET = str.maketrans(LEET)
_SIGNS = re.compile(r"(?<=[a-z])[0-9@$!|+]+(?=[a-z])|(?<![^\W\d_])[0-9@$|+]+(?=[a-z]{2})|(?<=[a-z]{2})[0-9@$]+(?![^\W\d_])")
_BETWEEN = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """The words of a text, folded, each with a space before and after."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    text = _SIGNS.sub(lambda m: m[0].translate(_LEET), text)
    return f" {_BETWEEN.sub(' ', text).strip()} "


def terms_of(folded: str) -> set[str]:
    """Whole words (with a space on both sides) and beginnings of 3 to 10 letters (with one before)."""
    out: set[str] = set()
    for w in set(folded.split()):
        if len(w) >= SHORTEST:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in range(SHORTEST, min(LONGEST + 1, len(w))))
    return out


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    _machine: list = field(default_factory=list, compare=False, repr=False)

    def __reduce__(self):
        return Lexicon, (self.weights, self.exceptions, self.curve)

    def machine(self):
        """The automaton, built once in each process; values are (length, weight), weight 0 for an exception."""
        if not self._machine:
            import ahocorasick

            one = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                one.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                one.add_word(phrase, (len(phrase), 0.0))
            if len(one):
                one.make_automaton()
            self._machine.append(one)
        return self._machine[0]

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """Start, end and weight of each counted hit: the heaviest at each start, none inside an exception."""
        machine = self.machine()
        if not len(machine):
            return []
        found = [(end - length + 1, end + 1, weight) for end, (length, weight) in machine.iter(folded)]
        spared = sorted((s, e) for s, e, w in found if not w)
        # of the phrases that begin up to a place, the end that lies furthest
        begins, reach = [s for s, _ in spared], [0, *accumulate((e for _, e in spared), max)]
        best: dict[int, tuple[int, float]] = {}
        for s, e, w in found:
            if w > best.get(s, (0, 0.0))[1] and reach[bisect_right(begins, s)] < min(e, len(folded)):
                best[s] = (e, w)
        return [(s, e, w) for s, (e, w) in best.items()]

    def features(self, folded: str) -> tuple[float, float, float, float]:
        total = sum(w for _, _, w in self.hits(folded))
        words = max(1, folded.count(" ") - 1)
        return 1.0, float(total > 0), float(np.log1p(total)), float(np.log1p(100 * total / words))

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.curve), -30, 30)))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([fold(t or "") for t in batch.column(0).to_pylist()], pa.string()), batch.column(1)], names=["folded", "y"])


def _counted(batches: Iterator[pa.RecordBatch], found: Callable[[str], set[str]]) -> Iterator[pa.RecordBatch]:
    """(folded, y) -> for each term that ``found`` gives, the documents with it by label."""
    counts: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for folded, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[y].update(found(folded))
    terms = sorted(counts[0].keys() | counts[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([counts[y][t] for t in terms], pa.int64()) for y in (0, 1))], names=["term", "other", "toxic"])


def _by_label(sample: DataFrame, found: Callable[[str], set[str]]) -> DataFrame:
    """term, other, toxic: documents of the sample (folded, y) with each term."""
    counted = sample.mapInArrow(functools.partial(_counted, found=found), "term string, other long, toxic long")
    return counted.groupBy("term").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))


def learn_weights(sample: DataFrame) -> dict[str, float]:
    """Weights of the terms that mark toxic documents, from a sample (folded, y) of bounded size, which bounds the terms."""
    rows = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = rows.get(1, 0), rows.get(0, 0)
    share, least = toxic / max(1, toxic + other), max(LEAST, toxic // 200)
    often = {r["term"]: (r["toxic"], r["other"]) for r in _by_label(sample, terms_of).filter(F.col("toxic") >= least).collect()}
    odds = {t: float(np.log((n + share) / (toxic + share)) - np.log((m + 1 - share) / (other + 1))) for t, (n, m) in often.items()}
    good = {t: w for t, w in odds.items() if w >= ODDS and w * often[t][0] >= EVIDENCE}
    kept: dict[str, float] = {}
    for t in sorted(good, key=lambda t: (len(t.strip()), t.endswith(" "), t)):
        word = t.strip()
        if good[t] >= max((kept.get(f" {word[:k]}", 0.0) for k in range(SHORTEST, len(word) + 1)), default=0.0) + GAIN:
            kept[t] = good[t]
    return kept


def phrases(folded: str, lexicon: Lexicon) -> set[str]:
    """The pairs of words around each hit: its word with the one before, and with the one after."""
    out: set[str] = set()
    for s, _, _ in lexicon.hits(folded):
        stop = folded.find(" ", s + 1)
        before = folded.rfind(" ", 0, s) if s > 0 else -1
        after = folded.find(" ", stop + 1)
        if before >= 0:
            out.add(folded[before : stop + 1])
        if after >= 0:
            out.add(folded[s : after + 1])
    return out


def learn_exceptions(sample: DataFrame, lexicon: Lexicon) -> tuple[str, ...]:
    """Pairs of words around hits that occur in EXCEPTION documents that are not toxic, and in no toxic one."""
    counted = _by_label(sample, functools.partial(phrases, lexicon=lexicon))
    return tuple(sorted(r["term"] for r in counted.filter(f"other >= {EXCEPTION} and toxic = 0").collect()))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> tuple[float, ...]:
    """Logistic regression by Newton's method with a small ridge (not on the constant)."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _features(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [list(lexicon.features(f)) for f in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Lexicon, exceptions and curve from about ``bound`` labelled documents; labels (doc_id, toxic)."""
    # copies of one text are one witness; texts are folded once
    sample = labelled(docs, labels, "toxic", bound).dropDuplicates(["text", "y"])
    sample = scratch(sample.mapInArrow(_folded, "folded string, y int"), "toxicity-sample")
    lexicon = Lexicon(learn_weights(sample), exceptions)
    lexicon = Lexicon(lexicon.weights, exceptions + learn_exceptions(sample, lexicon))
    rows = sample.mapInArrow(functools.partial(_features, lexicon=lexicon), "x array<double>, y int").collect()
    if not rows:
        return Lexicon({}, exceptions, (-30.0, 0.0, 0.0, 0.0))
    rows.sort(key=lambda r: (r["x"], r["y"]))
    return Lexicon(lexicon.weights, lexicon.exceptions, fit_curve(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)))


def _scored(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        folded = (fold(t or "") for t in batch.column(1).to_pylist())
        x = np.array([lexicon.features(f) for f in folded], float).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lexicon.score(x))], names=["doc_id", "score"])


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score (0 to 1) of each row of docs (doc_id long, text)."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(functools.partial(_scored, lexicon=lexicon), "doc_id long, score double")


#: SQL: is a row kept out of training?
HELD_OUT = "coalesce(crc32(cast(doc_id as string)) % 5 = 0, true)"


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(f"not ({HELD_OUT})")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
