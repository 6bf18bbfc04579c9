"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of up to CHUNK bytes is counted at once. A longer one is cut into chunks of CHUNK bytes that overlap their
successor by OVERLAP bytes. Each chunk is encoded whole with offsets, wherever Spark puts it, and gives its number of
tokens and the tokens (place and id) of its overlaps. Two chunks are spliced where their encodings of the overlap
between them have resynchronised: at the first place that

*   is a *stable boundary* by its bytes (below),
*   begins a token in both encodings, and
*   from which on both have the same tokens up to the overlap's last stable boundary, one at least.

The tokens of the first chunk from there on and those of the second before it don't count. Where there is no such place
(no boundary, or the encodings disagree), the document is cut again with overlaps WIDER times as wide, up to one whole
chunk, and at last encoded in one piece.

Position p is a stable boundary if byte p is a space (20) and the byte before is in 21..7E, or the byte after is over 20
and can't begin a Unicode white space (C2, E1, E2, E3 can). The tokenizer's pattern lets a space only begin a token or
stand in a run of white space, and such a run gives its last space to a following non-space; so in either case a token
begins at p, whatever else the text holds, and no added token contains a space. That is the proof for this vocabulary; the
comparison of both encodings checks it.

In texts of up to CHUNK bytes, spans between stable boundaries are the units that a worker encodes once (see vocabulary).
Null text counts as empty: no tokens. Null ids and repeated rows are counted like any other; equal huge texts are encoded
once, and told from others by a 64-bit hash and their length. An empty table gives an empty result. Columns other than
doc_id and text aren't looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm.common import hot_of, scratch, small_batches, split_join, table
from corroborate.llm.textkit import Slice, slices
from corroborate.llm.vocabulary import UnitTable, tokenizer

FILE, LIMIT = "byte_bpe_50k.json", 1024
CHUNK, OVERLAP, WIDER = 16 << 10, 1 << 10, 16

_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_STARTS = np.zeros(256, bool)
_STARTS[0x21:] = True
_STARTS[[0xC2, 0xE1, 0xE2, 0xE3]] = False


def stable(data: np.ndarray) -> np.ndarray:
    """Positions of stable boundaries that the bytes themselves prove."""
    at = np.flatnonzero(data[1:-1] == 32) + 1
    return at[_SOLID[data[at - 1]] | _STARTS[data[at + 1]]]


_tables: dict[str, UnitTable] = {}


def _table(file: str) -> UnitTable:
    if file not in _tables:
        _tables[file] = UnitTable(lambda texts: [[len(e.ids)] for e in tokenizer(file).encode_batch_fast(texts, add_special_tokens=False)])
    return _tables[file]


def _count(part: Slice, file: str) -> np.ndarray:
    """Tokens of each text of the slice, from its units."""
    at = stable(part.data) if len(part.data) > 2 else np.zeros(0, np.int64)
    edges = part.offsets
    # a boundary right at a document's edge would look at a neighbour's bytes
    at = at[~np.isin(at, edges) & ~np.isin(at + 1, edges)]
    start = np.union1d(edges[:-1][np.diff(edges) > 0], at)
    end = np.append(start[1:], len(part.data))[: len(start)]
    units = _table(file)
    rows = units.rows(part, start, end)
    tokens = units.ids(rows).astype(np.int64)  # each unit has one entry: its number of tokens
    total = np.concatenate(([0], np.cumsum(tokens)))
    where = np.searchsorted(start, edges)
    return total[where[1:]] - total[where[:-1]]


_KEY = ["row", "n_bytes"]
_CUT = "row long, n_bytes long, chunk long, next_at long, overlap long, text string"


def _cut(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """(row, n_bytes, text) -> a row for each chunk; cuts move to the next code point. Without overlap: one chunk."""
    names = [c.split()[0] for c in _CUT.split(", ")]
    for batch in batches:
        out: list[tuple] = []
        for k in range(batch.num_rows):
            body = (batch.column(2)[k].as_py() or "").encode()

            def whole(p: int) -> int:
                while p < len(body) and 0x80 <= body[p] < 0xC0:
                    p += 1
                return p

            cuts = [whole(p) for p in range(0, max(1, len(body) - overlap), chunk)] if overlap else [0]
            for i, s in enumerate(cuts):
                e = whole(cuts[i + 1] + overlap) if i + 1 < len(cuts) else len(body)
                out.append((batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), i, cuts[i + 1] - s if i + 1 < len(cuts) else -1, overlap, body[s:e].decode()))
        for lot in range(0, len(out), 64):
            columns = list(zip(*out[lot : lot + 64]))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.string())], names=names)


def token_starts(text: str, encoding) -> tuple[np.ndarray, np.ndarray]:
    """The byte at which each token of an encoding begins, and its id."""
    data = np.frombuffer(text.encode(), np.uint8)
    points = np.flatnonzero((data & 0xC0) != 0x80)
    starts = np.array([s for s, _ in encoding.offsets], np.int64)
    return points[starts] if len(starts) else starts, np.array(encoding.ids, np.int64)


_ENCODED = "row long, n_bytes long, chunk long, tokens long, head binary, head_ids binary, boundaries binary, tail binary, tail_ids binary"


def _encoded(batches: Iterator[pa.RecordBatch], file: str) -> Iterator[pa.RecordBatch]:
    """A chunk's number of tokens, and the tokens that begin in the overlap with its predecessor (head) and its successor (tail).

    Places count from the chunk's start in the head, and from the successor's start in the tail.
    """
    names = [c.split()[0] for c in _ENCODED.split(", ")]
    for batch in batches:
        texts = batch.column("text").to_pylist()
        overlaps, nexts = batch.column("overlap").to_numpy(), batch.column("next_at").to_numpy()
        for s in range(0, len(texts), 32):
            out: list[tuple] = []
            for k, encoding in enumerate(tokenizer(file).encode_batch(texts[s : s + 32], add_special_tokens=False), s):
                at, ids = token_starts(texts[k], encoding)
                data = np.frombuffer(texts[k].encode(), np.uint8)[: overlaps[k]]
                places = stable(data) if len(data) > 2 else np.zeros(0, np.int64)
                head = at < overlaps[k]
                tail = (at >= nexts[k]) & (nexts[k] >= 0)
                out.append((len(ids), *(v.astype("<i4").tobytes() for v in (at[head], ids[head], places, at[tail] - nexts[k], ids[tail]))))
            columns = list(zip(*out))
            keys = [batch.column(c).slice(s, len(out)) for c in ("row", "n_bytes", "chunk")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=names)


def common_boundary(head: np.ndarray, head_ids: np.ndarray, boundaries: np.ndarray, tail: np.ndarray, tail_ids: np.ndarray) -> int:
    """The first boundary at which two encodings of one overlap have resynchronised, or -1."""
    shared = boundaries[np.isin(boundaries, head) & np.isin(boundaries, tail)]
    if not len(shared):
        return -1
    last = int(boundaries[-1])
    i, j = np.searchsorted(head, last), np.searchsorted(tail, last)
    # how many tokens before the last boundary are the same in both, counted backwards
    n = min(i, j)
    same = (head[i - n : i] == tail[j - n : j]) & (head_ids[i - n : i] == tail_ids[j - n : j])
    agreed = n if same.all() else n - 1 - int(np.flatnonzero(~same)[-1])
    if not agreed:
        return -1
    found = shared[(shared >= head[i - agreed]) & (shared < last)]
    return int(found[0]) if len(found) else -1


_SPLICED = "row long, n_bytes long, surplus long, aligned boolean"


def _spliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's tail beside its successor's head -> the tokens that both together have too many."""
    for batch in batches:
        surplus, aligned = [], []
        for r in batch.select(["head", "head_ids", "boundaries", "tail", "tail_ids"]).to_pylist():
            v = {k: np.frombuffer(x, "<i4") for k, x in r.items()}
            p = common_boundary(**v)
            aligned.append(p >= 0)
            surplus.append(int((v["tail"] >= p).sum() + (v["head"] < p).sum()))
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n_bytes"), pa.array(surplus, pa.int64()), pa.array(aligned, pa.bool_())], names=[c.split()[0] for c in _SPLICED.split(", ")])


def _counts(batches: Iterator[pa.RecordBatch], file: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [_count(part, file) for part in slices(batch.column(2))]
        tokens = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens)], names=["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, file: str = FILE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row for each row of docs (doc_id long, text): doc_id, n_bytes, n_tokens."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    short = docs.filter(F.col("n_bytes") <= chunk).mapInArrow(functools.partial(_counts, file=file, limit=chunk), "doc_id long, n_bytes long, n_tokens long")
    huge = docs.filter(F.col("n_bytes") > chunk)
    named = huge.select("doc_id", "n_bytes", F.xxhash64("text", F.lit(9)).alias("row"), "text")
    left, done, width = named.select(*_KEY, "text").dropDuplicates(_KEY), None, overlap
    while True:
        # beyond one whole chunk there is nothing to widen: one piece
        cut = left.mapInArrow(functools.partial(_cut, chunk=chunk, overlap=0 if width > chunk else width), _CUT)
        got = scratch(cut.repartition(*_KEY, "chunk").mapInArrow(functools.partial(_encoded, file=file), _ENCODED), "token-chunks")
        heads = got.filter("chunk > 0").select(*_KEY, (F.col("chunk") - 1).alias("chunk"), "head", "head_ids", "boundaries")
        pairs = got.select(*_KEY, "chunk", "tail", "tail_ids").join(heads, [*_KEY, "chunk"])
        spliced = pairs.mapInArrow(_spliced, _SPLICED).groupBy(*_KEY).agg(F.sum("surplus").alias("surplus"), F.bool_and("aligned").alias("aligned"))
        whole = got.groupBy(*_KEY).agg(F.sum("tokens").alias("tokens")).join(spliced, _KEY, "left")
        pieces = scratch(whole.select(*_KEY, (F.col("tokens") - F.coalesce("surplus", F.lit(0))).alias("n_tokens"), F.coalesce("aligned", F.lit(True)).alias("aligned")), "token-texts")
        good = pieces.filter("aligned").select(*_KEY, "n_tokens")
        done = good if done is None else done.unionByName(good)
        failed = pieces.filter("not aligned").select(*_KEY)
        if width > chunk or failed.isEmpty():
            break
        left, width = left.join(failed, _KEY, "left_semi"), width * WIDER
    asked = named.select("doc_id", *_KEY)
    counted = split_join(asked, done, _KEY, hot_of(asked, _KEY)).select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(counted)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
