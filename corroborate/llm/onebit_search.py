"""Nearest neighbours by largest inner product, with randomly rotated one-bit codes.

Every vector o is centred, scaled to length 1, padded to bits dimensions (LEAST_BITS, or the dimension up to a whole
number of 64) and rotated by a fixed random
rotation; its code keeps the bits signs, packed, with two correction scalars: the length of o - c, and the
inner product of the rotated vector with its own code. A query is rotated likewise and quantised to PLANES
bit planes, so its inner product with a code comes from counts of common bits. The estimate is unbiased
and off by more than EPSILON standard errors only rarely, so every candidate is dropped whose upper bound lies under the
block's k-th best lower bound, or under the k-th best exact product that the task has found before; the rest are ranked
by the exact inner product in double precision. Where an estimate isn't finite, the exact product decides.

Every row is encoded and every code is compared with every query, in blocks: rows are dealt out once and stay where they
are, with their codes; queries come to them in broadcast tiles of TILE_BYTES, and a task gives its k best for each.
The work grows with queries times rows, what is shuffled with rows plus queries times tasks.

Vectors that are null, zero, of another dimension than most, or hold null or non-finite components take no
part, nor do rows with a null vec_id. Rows that share a vec_id count as one candidate (their best) and as one
query (the least vector in array order). With fewer candidates than k all are returned; an empty table gives an empty result. Ties go to the
smaller vec_id. Columns other than vec_id and embedding aren't looked at, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroborate.llm.common import scratch, table

LEAST_BITS, PLANES, EPSILON, SEED = 256, 5, 3.0, 20240607
QUERY_BLOCK, BLOCK, TILE_BYTES = 512, 4096, 16 << 20


@functools.cache
def rotation(dimension: int, bits: int) -> np.ndarray:
    """The first columns of a random orthogonal matrix of bits x bits, the same everywhere."""
    square = np.random.default_rng(SEED).standard_normal((bits, bits))
    return np.linalg.qr(square)[0][:, :dimension].copy()


def bits_for(dimension: int) -> int:
    return max(LEAST_BITS, -(-dimension // 64) * 64)


def encode(vectors: np.ndarray, centre: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes (rows of uint64), lengths of o - c, and inner products of each unit vector with its code."""
    rest = vectors - centre
    length = np.linalg.norm(rest, axis=1)
    turned = (rest / np.maximum(length, 1e-300)[:, None]) @ rotation(vectors.shape[1], bits).T
    own = np.abs(turned).sum(axis=1) / np.sqrt(bits)
    return np.packbits(turned >= 0, axis=1, bitorder="little").view(np.uint64), length, own


def estimate(codes: np.ndarray, length: np.ndarray, own: np.ndarray, queries: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x codes), and the size of one EPSILON error bound for each."""
    bits = codes.shape[1] * 64
    turned = queries @ rotation(queries.shape[1], bits).T
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum((turned.max(axis=1, keepdims=True) - low) / ((1 << PLANES) - 1), 1e-300)
    level = np.rint((turned - low) / step).astype(np.int64)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    common = np.zeros((len(queries), len(codes)), np.float32)
    for plane in range(PLANES):
        mask = np.packbits((level >> plane & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)
        for w in range(codes.shape[1]):
            common += np.bitwise_count(mask[:, w, None] & codes[None, :, w]).astype(np.float32) * np.float32(1 << plane)
    dot = (2 * (low * ones[None, :] + step * common) - turned.sum(axis=1, keepdims=True)) / np.sqrt(bits)
    shape = length / np.maximum(own, 1e-12)
    spread = np.sqrt(np.maximum(0, 1 - own**2) / (bits - 1))
    size = np.linalg.norm(queries, axis=1)[:, None] * spread[None, :] + step * np.sqrt(1 / 12)
    return (queries @ centre)[:, None] + dot * shape[None, :], EPSILON * size * shape[None, :]


def _vectors(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, dimension)


def _sums(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(dimension), 0
    for batch in batches:
        total, n = total + _vectors(batch.column(1), dimension).sum(axis=0), n + batch.num_rows
    yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], names=["total", "n"])


_INDEX = "ids binary, vectors binary, codes binary, length binary, own binary"
_KINDS = (np.int64, np.float64, np.uint64, np.float64, np.float64)


def _index(batches: Iterator[pa.RecordBatch], centre: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) -> blocks of BLOCK rows and one of the rest, whatever the batches' sizes."""
    names = [c.split()[0] for c in _INDEX.split(", ")]

    def block(ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        with np.errstate(all="ignore"):
            codes, length, own = encode(vectors, centre, bits_for(len(centre)))
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, vectors, codes, length, own)], names=names)

    ids, vectors = np.zeros(0, np.int64), np.zeros((0, len(centre)))
    for batch in batches:
        ids = np.concatenate([ids, batch.column(0).to_numpy().astype(np.int64)])
        vectors = np.concatenate([vectors, _vectors(batch.column(1), len(centre))])
        while len(ids) >= BLOCK:
            yield block(ids[:BLOCK], vectors[:BLOCK])
            ids, vectors = ids[BLOCK:], vectors[BLOCK:]
    if len(ids):
        yield block(ids, vectors)


class Best:
    """The k best of each query so far: scores (-inf where there is none yet) and ids, best first."""

    def __init__(self, names: np.ndarray, queries: np.ndarray, k: int):
        self.names, self.queries, self.k = names, queries, k
        self.score = np.full((len(names), k), -np.inf)
        self.ids = np.zeros((len(names), k), np.int64)
        self.found = np.zeros(len(names), np.int64)

    def look(self, rows: slice, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, length: np.ndarray, own: np.ndarray, centre: np.ndarray) -> None:
        """Compares some queries with a block."""
        names, queries, k = self.names[rows], self.queries[rows], self.k
        with np.errstate(all="ignore"):
            value, error = estimate(codes, length, own, queries, centre)
            low, high = value - error, value + error
        mine = names[:, None] == ids[None, :]
        low[mine | np.isnan(low)] = -np.inf
        floor = np.where(self.found[rows] >= k, self.score[rows, k - 1], -np.inf)
        # rows that share an id are one candidate, so a bound from the block needs ids that differ
        if len(ids) > k and len(np.unique(ids)) == len(ids):
            floor = np.maximum(floor, np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k])
        # what isn't under the floor for certain is looked at
        chosen = ~(high < floor[:, None]) & ~mine
        for q in np.flatnonzero(chosen.any(axis=1)).tolist():
            at = np.flatnonzero(chosen[q])
            with np.errstate(all="ignore"):
                score = (vectors[at] * queries[q]).sum(axis=1)
            row, n = rows.start + q, self.found[rows.start + q]
            score, near = np.concatenate([self.score[row, :n], score]), np.concatenate([self.ids[row, :n], ids[at]])
            order = np.lexsort((near, -score))
            order = order[~np.isnan(score[order])]
            _, first = np.unique(near[order], return_index=True)
            keep = order[np.sort(first)][:k]
            self.score[row, : len(keep)], self.ids[row, : len(keep)], self.found[row] = score[keep], near[keep], len(keep)

    def rows(self) -> pa.RecordBatch:
        has = np.arange(self.k)[None, :] < self.found[:, None]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.names, self.found)), pa.array(self.ids[has]), pa.array(self.score[has])], names=["query_id", "vec_id", "score"])


def _search(batches: Iterator[pa.RecordBatch], tile, centre: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    best = Best(*tile.value, k)
    for batch in batches:
        for row in range(batch.num_rows):
            ids, vectors, codes, length, own = (np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in enumerate(_KINDS))
            block = (ids, vectors.reshape(len(ids), -1), codes.reshape(len(ids), -1), length, own)
            for s in range(0, len(best.names), QUERY_BLOCK):
                best.look(slice(s, min(s + QUERY_BLOCK, len(best.names))), *block, centre)
    yield best.rows()


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The rows that take part, and their dimension: the most frequent one (the smallest of several)."""
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and embedding is not null and size(embedding) > 0")
    common = plain.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dimension = common["d"] if common else 0
    finite = "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < cast('Infinity' as double))"
    return plain.filter((F.size("embedding") == dimension) & F.expr(finite) & F.expr("exists(embedding, x -> x <> 0)")), dimension


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of vectors (vec_id, embedding) to each row of queries."""
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    rows, dimension = usable(vectors)
    asked, _ = usable(queries)
    asked = scratch(asked.filter(F.size("embedding") == dimension).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "search-queries")
    n = asked.count()
    if not n or not dimension:
        return spark.createDataFrame([], schema)
    sums = rows.mapInArrow(functools.partial(_sums, dimension=dimension), "total array<double>, n long")
    sums = scratch(sums, "search-sums")
    total = sums.select(F.posexplode("total")).groupBy("pos").agg(F.sum("col").alias("total")).orderBy("pos").collect()
    count = sums.agg(F.sum("n")).first()[0] or 0
    centre = np.array([r["total"] for r in total], float) / max(1, count)
    # dealt out once, in tasks for all cores and of 1 << 20 rows at most
    tasks = max(1, min(-(-count // BLOCK), max(2 * spark.sparkContext.defaultParallelism, count >> 20)))
    index = scratch(rows.repartition(tasks).mapInArrow(functools.partial(_index, centre=centre), _INDEX), "search-index")
    tiles = -(-n // max(1, TILE_BYTES // (8 * dimension)))
    found: DataFrame | None = None
    for t in range(tiles):
        # about TILE_BYTES of queries, by the hash: all that passes through the driver at a time
        part = asked.filter(F.expr(f"pmod(xxhash64(vec_id), {tiles}L) = {t}L")).toArrow().combine_chunks()
        if not part.num_rows:
            continue
        names = part.column("vec_id").to_numpy().astype(np.int64)
        tile = spark.sparkContext.broadcast((names, _vectors(part.column("embedding").combine_chunks(), dimension)))
        one = index.mapInArrow(functools.partial(_search, tile=tile, centre=centre, k=k), "query_id long, vec_id long, score double")
        if tiles > 1:
            one = scratch(one, "search-found")
            tile.unpersist()
        found = one if found is None else found.unionByName(one)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_onebit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 20 = 0"), 20)
