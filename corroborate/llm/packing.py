"""Best-fit packing of token sequences, planned on the histogram of lengths.

Each document is tokenised to ids plus one end id, and cut into pieces of MAX tokens only if it is longer.
The planner sees just how many pieces there are of each length (MAX numbers, whatever the corpus): best-fit
decreasing over counts, where bins of the same free space are handled together as ranges of sequence
numbers. It gives runs (length, first rank, count, first sequence, offset), and a piece takes its slot by
joining on its length and its rank within that length. A rank is the piece's number among those of its
length in its task plus a running sum over tasks, so no length is ever gathered in one place.

Null text counts as empty: one piece, the end id. Null ids and repeated rows are packed like any other. Very long texts are
tokenised whole, in slices. Pieces of one length are alike to the planner. An empty table gives an empty result. Columns other than
doc_id and text aren't looked at, whatever their names.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroborate.llm.common import scratch, small_batches, table
from corroborate.llm.textkit import slices
from corroborate.llm.vocabulary import UnitTable, tokenizer

FILE, END, MAX = "word_bpe_49k.json", 0, 2048

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, place long"
_tables: dict[str, UnitTable] = {}


def _table(file: str) -> UnitTable:
    # This vocabulary drops white space and ends words at it, so a word's ids don't depend on its neighbours.
    if file not in _tables:
        _tables[file] = UnitTable(lambda texts: [e.ids for e in tokenizer(file).encode_batch_fast(texts, add_special_tokens=False)])
    return _tables[file]


def token_ids(texts: pa.Array, file: str = FILE) -> Iterator[np.ndarray]:
    """The ids of each text of a batch, in order, without the end id."""
    units = _table(file)
    for part in slices(texts):
        start, end, document = part.words()
        rows = units.rows(part, start, end)
        ids = units.ids(rows)
        total = np.concatenate(([0], np.cumsum(units.counts(rows))))
        edges = total[np.searchsorted(document, np.arange(part.n + 1))]
        for i in range(part.n):
            yield ids[edges[i] : edges[i + 1]]


def _pieces(batches: Iterator[pa.RecordBatch], file: str, end: int, most: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    seen = np.zeros(most + 1, np.int64)
    last = np.array([end], np.uint32)
    for batch in batches:
        out: list[tuple] = []
        bodies: list[bytes] = []
        names = batch.column(0).to_pylist()
        for k, ids in enumerate(token_ids(batch.column(1), file)):
            ids = np.concatenate([ids, last])
            for piece, s in enumerate(range(0, len(ids), most)):
                one = ids[s : s + most]
                body = one.astype("<u4").tobytes()
                out.append((names[k], piece, s, len(one), zlib.crc32(body), task, int(seen[len(one)])))
                seen[len(one)] += 1
                if keep_ids:
                    bodies.append(body)
        if out:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
            fields = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"]
            if keep_ids:
                columns, fields = [*columns, pa.array(bodies, pa.binary())], [*fields, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=fields)


def plan(histogram: dict[int, int], most: int = MAX) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset) of best-fit decreasing over counts.

    Bins with the same free space wait as ranges of sequence numbers. All pieces of a length are placed
    together: into the range with the least space that holds them, else into new bins as many to a bin as fit.
    """
    ranges: dict[int, list[tuple[int, int]]] = {}  # free space -> (first sequence, count)
    runs: list[tuple[int, int, int, int, int]] = []
    following = 0

    def wait(space: int, first: int, count: int) -> None:
        if space and count:
            ranges.setdefault(space, []).append((first, count))

    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            fits = min((s for s in ranges if s >= length and ranges[s]), default=None)
            if fits is None:
                each = most // length
                full, odd = divmod(left, each)
                for k in range(each if full else 0):
                    runs.append((length, rank, full, following, k * length))
                    rank += full
                wait(most - each * length, following, full)
                following += full
                for k in range(odd):
                    runs.append((length, rank, 1, following, k * length))
                    rank += 1
                if odd:
                    wait(most - odd * length, following, 1)
                    following += 1
                left = 0
            else:
                first, count = ranges[fits].pop()
                take = min(count, left)
                runs.append((length, rank, take, first, most - fits))
                if count > take:
                    ranges[fits].append((first + take, count - take))
                rank, left = rank + take, left - take
                wait(fits - length, first, take)
    return runs


def tokenised(docs: DataFrame, file: str = FILE, end: int = END, most: int = MAX, keep_ids: bool = False) -> DataFrame:
    """The pieces of docs (doc_id long, text), as a table in the shared folder."""
    small_batches(docs.sparkSession)
    schema = _PIECES + (", ids binary" if keep_ids else "")
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(functools.partial(_pieces, file=file, end=end, most=most, keep_ids=keep_ids), schema)
    return scratch(pieces, "packing-pieces")


def pack(pieces: DataFrame, most: int = MAX) -> DataFrame:
    """Adds sequence_id and offset to ``tokenised`` pieces, and drops their task columns."""
    spark = pieces.sparkSession
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shift = by_task.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "task", "shift")
    # at most `most` rows: the one thing that comes to the driver
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    schema = "length long, first long, count long, sequence long, offset long"
    runs = spark.createDataFrame(plan(histogram, most), schema)
    per_length = runs.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "count", "sequence", "offset"))).alias("runs"))
    # both sides are bounded by lengths (and tasks), not by rows
    slots = shift.join(per_length, "length")
    ranked = pieces.join(F.broadcast(slots) if slots_small(slots) else slots, ["length", "task"]).withColumn("rank", F.col("place") + F.col("shift"))
    found = F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["first"] + r["count"]))[0]
    return ranked.withColumn("run", found).drop("runs", "task", "place", "shift").withColumn("sequence_id", F.col("run.sequence") + F.col("rank") - F.col("run.first")).withColumn("offset", F.col("run.offset")).drop("run", "rank")


def slots_small(slots: DataFrame, runs: int = 500_000) -> bool:
    """Do all (length, task) rows together hold few enough runs, of 32 bytes each, to broadcast them?"""
    return (slots.agg(F.sum(F.size("runs") + 1)).first()[0] or 0) <= runs


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(tokenised(table(spark, sf_dir, "documents"))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
