"""Periodic runs: stretches of words that repeat themselves, found in a Re-Pair grammar of the word ids.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of at least
max(least, 2 * q) words, that no neighbouring word extends while the period stays q.

1. Words get ids by their bytes. A run of at least ``least`` words and two periods holds each of its words in a window
   of ``least // 2`` words that occurs again in the document, so only zones of such windows are looked at. (Windows are
   told apart by hashes here; a collision could only make a zone larger.)
2. Re-Pair over the zones: in each round the pairs that occur most often among their neighbours become nonterminals,
   until no pair occurs twice. What is left of a zone becomes a balanced tree over its symbols.
3. Once for each nonterminal, the runs inside its expansion that cross the boundary of its two halves. A run's words near the
   boundary occur again one period away; how far such a match goes is read from tables of equal stretches
   of 1, 2, 4, ... ids, which are exact.
4. The intervals are carried to all derivation positions. A run lies whole in the lowest node that holds it, and all other intervals
   of its period are parts of it, so intervals of one period that share a period's length are merged.

Documents are independent of each other: no shuffle, and a task holds a slice of half a megabyte or one longer document.
Null text: no words, so no runs and an empty collapsed text. Empty texts alike. Null doc_id: analysed like any other; ``planted``
leaves its words as they are. Repeated rows give repeated results. An empty table gives an empty result. Only doc_id and
text are read, so other columns may have any names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm.common import small_batches, table
from corroborate.llm.textkit import U64, Slice, bounds, mix, slices

LEAST = 12
#: Stretches of up to 2**TOP ids have tables of their own; longer matches are several of them.
TOP = 12
#: Candidate pairs of positions that are looked at in one go.
CHUNK = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of count[k] numbers from first[k]: all the numbers, and for each its range k."""
    owner = np.repeat(np.arange(len(count)), count)
    return np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner], owner


def zones(ids: np.ndarray, document: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (word numbers) of the stretches that windows of ``size`` words cover which occur twice in a document."""
    windows = max(0, len(ids) - size + 1)
    inside = np.flatnonzero(document[:windows] == document[size - 1 :])
    marks = mix(ids.astype(U64), 3)
    weights = mix(np.arange(size, dtype=U64), 31) | U64(1)
    total = mix(document[inside].astype(U64), 7)
    for k in range(size):
        total = total + marks[inside + k] * weights[k]
    order = np.argsort(total, kind="stable")
    same = total[order][1:] == total[order][:-1]
    again = inside[order[(np.append(same, False) | np.append(False, same))[: len(order)]]]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + size, -1)
    covered = np.cumsum(edge)[:-1] > 0
    before, after = np.ones(len(ids), bool), np.ones(len(ids), bool)
    before[1:] = ~covered[:-1] | (document[1:] != document[:-1])
    after[:-1] = ~covered[1:] | (document[1:] != document[:-1])
    start, end = np.flatnonzero(covered & before), np.flatnonzero(covered & after) + 1
    long = end - start >= least
    return start[long], end[long]


class Grammar:
    """Binary rules over terminals 0 .. terminals - 1: halves, length and one place in the text of each symbol; one root for each zone."""

    def __init__(self, ids: np.ndarray, zone: np.ndarray):
        self.terminals = int(ids.max()) + 1
        self.left, self.right = [np.full(self.terminals, -1)], [np.full(self.terminals, -1)]
        self.length, self.place = [np.ones(self.terminals, np.int64)], [np.full(self.terminals, -1)]
        self.n = self.terminals
        symbol, at = ids.astype(np.int64), np.arange(len(ids))
        size = np.ones(len(ids), np.int64)
        while True:
            chosen = self._frequent(symbol, zone)
            if chosen is None:
                break
            symbol, at, zone, size = self._replaced(chosen, symbol, at, zone, size)
        while (zone[1:] == zone[:-1]).any():
            number = np.arange(len(zone)) - bounds(zone, int(zone[-1]) + 1)[zone]
            chosen = np.flatnonzero((number[:-1] % 2 == 0) & (zone[1:] == zone[:-1]))
            symbol, at, zone, size = self._replaced(chosen, symbol, at, zone, size)
        self.roots, self.root_at = symbol, at
        self.left, self.right = np.concatenate(self.left), np.concatenate(self.right)
        self.length, self.place = np.concatenate(self.length), np.concatenate(self.place)

    @staticmethod
    def _frequent(symbol: np.ndarray, zone: np.ndarray) -> np.ndarray | None:
        """Places of pairs that occur twice or more, and at least as often as the pairs they overlap; none of them overlap."""
        inside = np.flatnonzero(zone[1:] == zone[:-1])
        pairs, which, count = np.unique(symbol[inside] * (int(symbol.max()) + 1) + symbol[inside + 1], return_inverse=True, return_counts=True)
        if not len(count) or count.max() < 2:
            return None
        order = np.lexsort((mix(pairs.astype(U64), 11), count))
        rank = np.empty(len(pairs), np.int64)
        rank[order] = np.arange(len(pairs))
        weight = np.full(len(symbol) + 1, -1)
        weight[inside + 1] = np.where(count[which] > 1, rank[which], -1)
        before, own, after = weight[:-2], weight[1:-1], np.append(weight[2:-1], -1)
        place = np.arange(len(own))
        # the pairs of one symbol that repeats overlap themselves: every other one is taken
        begin = np.maximum.accumulate(np.where(own != before, place, 0))
        return np.flatnonzero((own >= 0) & (own >= before) & (own >= after) & ((place - begin) % 2 == 0))

    def _replaced(self, chosen: np.ndarray, symbol: np.ndarray, at: np.ndarray, zone: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        pairs, first, which = np.unique(symbol[chosen] * self.n + symbol[chosen + 1], return_index=True, return_inverse=True)
        self.left.append(pairs // self.n)
        self.right.append(pairs % self.n)
        self.length.append((size[chosen] + size[chosen + 1])[first])
        self.place.append(at[chosen][first])
        symbol, size = symbol.copy(), size.copy()
        size[chosen] += size[chosen + 1]
        symbol[chosen] = self.n + which
        self.n += len(pairs)
        stays = np.ones(len(symbol), bool)
        stays[chosen + 1] = False
        return symbol[stays], at[stays], zone[stays], size[stays]


class Stretches:
    """Tables of the numbers of stretches of 1, 2, 4, ... ids: equal numbers mean equal ids."""

    def __init__(self, ids: np.ndarray):
        self.number = [ids.astype(np.int64)]
        while len(self.number) <= TOP and 1 << len(self.number) <= len(ids):
            half, last = 1 << (len(self.number) - 1), self.number[-1]
            self.number.append(np.unique(last[:-half] * (int(last.max()) + 1) + last[half:], return_inverse=True)[1])

    def windows(self, size: int) -> np.ndarray:
        """Numbers of all windows of ``size`` ids."""
        k = min(size.bit_length() - 1, len(self.number) - 1)
        step, one = 1 << k, self.number[k]
        n = len(self.number[0]) - size + 1
        out, done = one[:n], step
        while done < size:
            shift = min(done, size - step)
            out = np.unique(out * (int(one.max()) + 1) + one[shift : shift + n], return_inverse=True)[1]
            done = shift + step
        return out

    def equal(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """How many ids from i and j on (or before i and j) are the same, at most ``most``."""
        done = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.number))):
            step, numbers = 1 << k, self.number[k]
            while True:
                open_ = np.flatnonzero(done + step <= most)
                shift = -(done[open_] + step) if back else done[open_]
                same = open_[numbers[i[open_] + shift] == numbers[j[open_] + shift]]
                done[same] += step
                if k + 1 < len(self.number) or not len(same):
                    break
        return done


def boundary_runs(grammar: Grammar, text: Stretches, least: int) -> np.ndarray:
    """Rows (symbol, start, end, period) of the runs that cross a nonterminal's boundary, inside its expansion; sorted by symbol."""
    size, n = least // 2, len(text.number[0])
    windows = text.windows(size)
    order = np.argsort(windows, kind="stable")
    keys = windows[order] * n + order
    rules = grammar.terminals + np.flatnonzero(grammar.length[grammar.terminals :] >= least)
    start = grammar.place[rules]
    middle, end = start + grammar.length[grammar.left[rules]], start + grammar.length[rules]
    # windows at the boundary, and the places of the same window within the expansion
    anchor, rule = _spread(middle - size, np.full(len(rules), size + 1))
    fits = (anchor >= start[rule]) & (anchor + size <= end[rule])
    anchor, rule = anchor[fits], rule[fits]
    low = np.searchsorted(keys, windows[anchor] * n + start[rule])
    count = np.searchsorted(keys, windows[anchor] * n + end[rule] - size, side="right") - low
    found, total = [], np.cumsum(count)
    cut = 0
    while cut < len(anchor):
        # rules stay whole within a chunk, so that a period is looked at once
        stop = int(np.searchsorted(total, (total[cut - 1] if cut else 0) + CHUNK, side="right"))
        stop = max(stop, cut + 1)
        stop = int(np.searchsorted(rule, rule[stop - 1], side="right"))
        other, k = _spread(low[cut:stop], count[cut:stop])
        lag, of = order[other] - anchor[cut:stop][k], rule[cut:stop][k]
        lag, of = lag[lag != 0], of[lag != 0]
        key = np.unique(of * (2 * n + 1) + lag + n)
        of, lag = key // (2 * n + 1), key % (2 * n + 1) - n
        m, q = middle[of], np.abs(lag)
        # words around the boundary m against those one period later (lag > 0) or earlier
        ok = (2 * q <= end[of] - start[of]) & np.where(lag > 0, m + q <= end[of], m - q >= start[of])
        of, m, q, later = of[ok], m[ok], q[ok], lag[ok] > 0
        i = np.where(later, m, m - q)
        ahead = text.equal(i, i + q, end[of] - i - q)
        behind = text.equal(i, i + q, i - start[of], back=True)
        ok = (ahead + behind >= np.maximum(q, least - q)) & np.where(later, behind > 0, ahead > 0)
        found.append(np.stack([rules[of[ok]], i[ok] - behind[ok] - start[of[ok]], i[ok] + q[ok] + ahead[ok] - start[of[ok]], q[ok]], axis=1))
        cut = stop
    if not found:
        return np.zeros((0, 4), np.int64)
    rows = np.concatenate(found)
    # an interval that is found with a multiple of its period has the same ends
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))] if len(rows) else rows


def derived(grammar: Grammar, runs: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of the runs at all places where their nonterminals are derived."""
    first, stop = np.searchsorted(runs[:, 0], np.arange(grammar.n)), np.searchsorted(runs[:, 0], np.arange(grammar.n), side="right")
    holds = stop > first
    # symbols are numbered after those they are made of: marks rise until nothing changes, a level at a time
    rules = np.arange(grammar.terminals, grammar.n)
    while True:
        more = ~holds[rules] & (holds[grammar.left[rules]] | holds[grammar.right[rules]])
        if not more.any():
            break
        holds[rules[more]] = True
    out, symbol, at = [], grammar.roots, grammar.root_at
    while len(symbol):
        keep = holds[symbol] & (symbol >= grammar.terminals)
        symbol, at = symbol[keep], at[keep]
        row, k = _spread(first[symbol], stop[symbol] - first[symbol])
        out.append(np.stack([at[k] + runs[row, 1], at[k] + runs[row, 2], runs[row, 3]], axis=1))
        left = grammar.left[symbol]
        symbol, at = np.concatenate([left, grammar.right[symbol]]), np.concatenate([at, at + grammar.length[left]])
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def merged(rows: np.ndarray) -> np.ndarray:
    """Intervals of one period that share at least that many ids become one."""
    if not len(rows):
        return rows
    rows = np.unique(rows, axis=0)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0], rows[:, 2]))]
    wide = int(rows[:, 1].max()) + 1
    reach = np.maximum.accumulate(rows[:, 2] * wide + rows[:, 1])
    new = np.append(True, (rows[1:, 2] != rows[:-1, 2]) | (reach[:-1] - rows[1:, 2] * wide - rows[1:, 0] < rows[1:, 2]))
    at = np.flatnonzero(new)
    return np.stack([rows[at, 0], np.maximum.reduceat(rows[:, 1], at), rows[at, 2]], axis=1)


def runs_of(ids: np.ndarray, document: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of all runs of word ids, by start and period. ids count from 0; a run stays in one document."""
    start, end = zones(ids, document, least // 2, least)
    if not len(start):
        return np.zeros((0, 3), np.int64)
    word, zone = _spread(start, end - start)
    known = np.unique(ids[word], return_inverse=True)[1]
    grammar = Grammar(known, zone)
    rows = merged(derived(grammar, boundary_runs(grammar, Stretches(known), least)))
    rows = np.stack([word[rows[:, 0]], word[rows[:, 1] - 1] + 1, rows[:, 2]], axis=1)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


_FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _analysed(part: Slice, least: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Words, runs and collapsed text of each document of the slice."""
    start, end, document = part.words()
    at = bounds(document, part.n)
    ids, _ = part.units(start, end)
    runs = runs_of(ids, document, least)
    owner = document[runs[:, 0]]
    fields = [runs[:, 0] - at[owner], runs[:, 1] - runs[:, 0], runs[:, 2]]
    listed = pa.ListArray.from_arrays(pa.array(bounds(owner, part.n), pa.int32()), pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in fields], ["start", "length", "period"]))
    # words beyond a run's first period go
    edge = np.zeros(len(start) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    stays = np.cumsum(edge)[:-1] == 0
    start, end, document = start[stays], end[stays], document[stays]
    last = np.append(document[1:] != document[:-1], True)[: len(document)]
    room = end - start + ~last
    body = np.full(int(room.sum()), 32, np.uint8)
    from_, word = _spread(start, end - start)
    to, _ = _spread(np.cumsum(room) - room, end - start)
    body[to] = part.data[from_]
    size = np.bincount(document, weights=room, minlength=part.n).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(size)))
    text = pa.Array.from_buffers(pa.large_string(), part.n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body)])
    return np.diff(at), listed, text.cast(pa.string())


def _found(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch.column(1)):
            words, runs, text = _analysed(part, least)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.n), pa.array(words, pa.int64()), runs, text], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row for each row of docs (doc_id long, text): n_words, its runs by start and period (starts are word numbers
    from 0), and its text without the words that a run repeats after its first period, joined by single spaces."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(functools.partial(_found, least=least), _FOUND)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where a tenth of the ids, by their CRC, have words that repeat from some word on."""
    change = f"""
      transform(array(regexp_extract_all(text, r'{WORD}', 0)), w -> transform(array(named_struct('n', size(w), 'a', g % size(w))), s ->
        transform(array(1 + (s.n - s.a) div (3 + g % 8)), p -> array_join(transform(w, (x, i) -> if(i < s.a, x, w[cast(s.a + (i - s.a) % p as int)])), ' '))[0])[0])[0]"""
    marked = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h")).withColumn("g", F.expr("h div 10"))
    return marked.select("doc_id", F.when((F.col("h") % 10 == 0) & F.col("text").rlike(WORD), F.expr(change)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    # the longest; of equal ones the first, then that of the smaller period
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"]))), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = F.when(F.size("runs") > 0, F.struct(-best["col1"], best["start"], best["period"]))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.col1").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.col1 div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
