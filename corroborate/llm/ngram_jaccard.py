"""N-gram Jaccard join: documents whose sets of 5-word shingles have a Jaccard similarity of 0.75 or more.

Texts are lower-cased (A-Z) and cut into words ``[^\\x20\\x09-\\x0D]+``. Documents with equal shingle sets
form a class, and classes are joined:

1.  Each class carries a parity bitmap (bit = hash modulo a power of two near the set's size, toggled by
    each shingle) and a sketch. Shingles that over HOT documents have among their LOOK first in hash order are *hot*, the others
    cold. So what many documents have in common doesn't bring together those that have enough else to be told by. Which
    shingles are hot is a matter of cost alone; with prefix a quarter of a set's size and one, its sketch is

    *   the first min(prefix, SKETCH) cold shingles in hash order, if two thirds of the set or more are cold,
    *   else the first prefix cold ones, and, if a third or less are cold, the first min(prefix, HOT_SKETCH) hot ones as well.

    A linked partner lacks less than a third of a set's size of the union. So if over a third of one set is cold, the two share a
    cold shingle, and the first such is among the first prefix cold ones of both. It is among the first SKETCH of a set that is
    cold for two thirds with probability 1 - 2 ** -SKETCH or more, as half of the union's cold shingles are shared. If both
    sets are cold for a third at most and share no cold shingle, three quarters of the union's hot ones are shared, and a
    link is missed with probability 0.25 ** HOT_SKETCH = 2 ** -48 at most. In sets of under 4 * HOT_SKETCH shingles no prefix is
    cut, and no link is missed.
2.  A tile holds the classes that share a sketch shingle. Tiles of over SMALL classes are split into size
    bands (sizes in one band are within 4/3, so partners are in the same or the next band). Tiles of over HOT classes are
    dealt into blocks, in DEALS ways.
3.  In a tile, popcount(bitmap xor bitmap) bounds the symmetric difference from below, and so the overlap
    from above. Of the pairs that pass, the minimum spanning forest (nearest first) is verified by exact
    intersection of sorted arrays.
4.  Where tiles hold classes of different components after that, all their passing pairs between components are
    verified too, after a second look with bitmaps WIDE times as long. So each pair that passes is either verified or
    inside a verified component. Tiles of over BLOCK classes are split into blocks for it: the members of a component that holds half
    of the tile are in one block each and meet those of others, which are in every block; others meet in pairs of blocks.

Rows with a null doc_id take no part in links of their own: they belong to the class of their text.
Rows that share a doc_id count as one node; repeated rows are one. Null and empty texts, and texts without words, have no
shingles and no links. Very long texts are read whole, in slices. An empty table gives an empty result. Columns other
than doc_id and text aren't looked at, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm.common import components, hot_keys, hot_of, scratch, small_batches, split_join, table
from corroborate.llm.textkit import U64, bounds, mix, shingles, slices

SKETCH, HOT_SKETCH, LOOK, SMALL, HOT = 48, 24, 72, 64, 512
#: Classes in a block of a large tile.
BLOCK = 2048
#: Ways in which large tiles are dealt into blocks in the first search.
DEALS = 4
#: The most frequent shingles that are held back, of 8 bytes each; others make larger tiles, no other result.
MOST = 200_000
#: Bits for each shingle in the bitmaps of the second search; the first has one.
WIDE = 8
#: Ids of candidates are broadcast to fetch their texts up to this number; beyond it the join shuffles.
BROADCAST_IDS = 300_000

_SKETCH_SCHEMA = "doc_id long, class binary, n_shingles long, bitmap binary, sketch array<long>"


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of each text of a batch, in order."""
    for part in slices(texts):
        part = part.folded()
        start, end, document = part.words()
        value, owner = shingles(part.hash_spans(start, end), document, part.n)
        at = bounds(owner, part.n)
        for i in range(part.n):
            one = np.sort(value[at[i] : at[i + 1]])
            if len(one) > 1:
                one = one[np.concatenate(([True], one[1:] != one[:-1]))]
            yield part.first + i, one


def bitmap(hashes: np.ndarray, scale: int = 1) -> bytes:
    """Bit b is the parity of the number of hashes that are b modulo the size: the power of two from scale * hashes up."""
    size = max(64, 1 << (scale * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & U64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch_of(one: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The sketch of a set (sorted hashes), where ``hot`` are the sorted hashes held back."""
    if not len(one):
        return one
    prefix = len(one) // 4 + 1
    held = hot[np.minimum(np.searchsorted(hot, one), len(hot) - 1)] == one if len(hot) else np.zeros(len(one), bool)
    cold = one[~held]
    if 3 * len(cold) >= 2 * len(one):
        return cold[: min(prefix, SKETCH)]
    if 3 * len(cold) > len(one):
        return cold[:prefix]
    return np.sort(np.concatenate([cold[:prefix], one[held][: min(prefix, HOT_SKETCH)]]))


def _looks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> the LOOK first shingles of each set, in one column."""
    for batch in batches:
        found = [one[:LOOK] for _, one in shingle_sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())], names=["h"])


def _sketches(batches: Iterator[pa.RecordBatch], hot: bytes) -> Iterator[pa.RecordBatch]:
    held = np.frombuffer(hot, U64)
    for batch in batches:
        names, counts, maps, firsts = [], [], [], []
        for _, one in shingle_sets(batch.column(1)):
            counts.append(len(one))
            firsts.append(sketch_of(one, held).view(np.int64))
            maps.append(bitmap(one) if len(one) else b"")
            names.append(np.array([mix(one, 11).sum(dtype=U64), mix(one, 12).sum(dtype=U64)], U64).tobytes())
        if not counts:
            continue
        ends = np.concatenate(([0], np.cumsum([len(x) for x in firsts]))).astype(np.int32)
        sketch = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(names, pa.binary()), pa.array(counts, pa.int64()), pa.array(maps, pa.binary()), sketch],
            names=["doc_id", "class", "n_shingles", "bitmap", "sketch"],
        )


def _unpack(maps: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, U64) for x in maps]


def _fold(x: np.ndarray, words: int) -> np.ndarray:
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def tile_pairs(size: np.ndarray, maps: list[np.ndarray], apart: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of a tile that pass the bound on the overlap, with their distance.

    ``apart``: group of each member; then only pairs of different groups count.
    """
    words = np.array([len(x) for x in maps])
    left, right, distance = [], [], []
    for level in np.unique(words):
        rows = np.flatnonzero(words == level)
        cols = np.flatnonzero((words == level) | (words == 2 * level))
        a = np.stack([maps[i] for i in rows])
        b = np.stack([_fold(maps[j], level) for j in cols])
        step = max(1, (1 << 21) // (len(cols) * int(level)))
        for k in range(0, len(rows), step):
            r = rows[k : k + step]
            d = np.zeros((len(r), len(cols)), np.int64)
            for w in range(level):
                d += np.bitwise_count(a[k : k + step, w, None] ^ b[None, :, w])
            x, y = size[r][:, None], size[cols][None, :]
            ok = (7 * d <= x + y) & (4 * np.minimum(x, y) >= 3 * np.maximum(x, y)) & ((words[cols] > level)[None, :] | (r[:, None] < cols[None, :]))
            if apart is not None:
                ok &= apart[r][:, None] != apart[cols][None, :]
            i, j = np.nonzero(ok)
            left.append(r[i])
            right.append(cols[j])
            distance.append(d[i, j])
    return np.concatenate(left), np.concatenate(right), np.concatenate(distance)


def forest(n: int, i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> list[tuple[int, int]]:
    """A minimum spanning forest of the pairs (i, j)."""
    if len(i) <= 64:
        root, kept = list(range(n)), []

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for k in np.argsort(distance, kind="stable"):
            a, b = top(int(i[k])), top(int(j[k]))
            if a != b:
                root[a] = b
                kept.append((int(i[k]), int(j[k])))
        return kept
    far = np.int32(1 << 30)
    dense = np.full((n, n), far, np.int32)
    dense[i, j] = dense[j, i] = distance
    near, via, left, kept = np.full(n, far, np.int32), np.zeros(n, np.int64), np.ones(n, bool), []
    for _ in range(n):
        k = int(np.argmin(np.where(left, near, far + 1)))
        if near[k] < far:
            kept.append((int(via[k]), k))
        left[k] = False
        closer = left & (dense[k] < near)
        near[closer], via[closer] = dense[k][closer], k
    return kept


def _tiles(batches: Iterator[pa.RecordBatch], all_pairs: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile -> pairs of node ids. A tile is never larger than a few blocks of HOT classes."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    rest: pa.Table | None = None

    def pairs_of(rows: pa.Table) -> pa.RecordBatch:
        key = np.stack([rows.column(c).to_numpy() for c in ("h", "band", "one", "two")])
        cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        at = np.concatenate(([0], cut, [key.shape[1]]))
        node, size = rows.column("node").to_numpy(), rows.column("n").to_numpy()
        group = rows.column("component").to_numpy() if all_pairs else None
        band, block, main = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("own", "block", "main"))
        maps = _unpack(rows.column("bitmap").to_pylist())
        a, b = [], []
        # tiles of two classes all at once, by bitmap length
        two = at[:-1][np.diff(at) == 2]
        words = np.array([len(x) for x in maps])
        for level in np.unique(np.minimum(words[two], words[two + 1])) if len(two) else []:
            t = two[np.minimum(words[two], words[two + 1]) == level]
            t = t[(np.maximum(words[t], words[t + 1]) <= 2 * level) & (4 * np.minimum(size[t], size[t + 1]) >= 3 * np.maximum(size[t], size[t + 1]))]
            if group is not None:
                t = t[group[t] != group[t + 1]]
            if len(t):
                x = np.stack([_fold(maps[k], level) for k in t]) ^ np.stack([_fold(maps[k + 1], level) for k in t])
                t = t[7 * np.bitwise_count(x).sum(axis=1, dtype=np.int64) <= size[t] + size[t + 1]]
                a.append(node[t])
                b.append(node[t + 1])
        for s, e in zip(at[:-1], at[1:]):
            if e - s < 3 or (group is not None and (group[s:e] == group[s]).all()):
                continue
            i, j, d = tile_pairs(size[s:e], maps[s:e], None if group is None else group[s:e])
            if len(i):
                # a pair of one band belongs to that band's tile, a pair of one block to that block's
                ok = (np.minimum(band[s:e][i], band[s:e][j]) == key[1, s]) | (key[1, s] < 0)
                if key[3, s] < 0:
                    ok &= main[s:e][i] != main[s:e][j]
                else:
                    ok &= (np.minimum(block[s:e][i], block[s:e][j]) == key[2, s]) & (np.maximum(block[s:e][i], block[s:e][j]) == key[3, s])
                i, j, d = i[ok], j[ok], d[ok]
            if len(i):
                if not all_pairs:
                    kept = np.array(forest(e - s, i, j, d), np.int64).reshape(-1, 2)
                    i, j = kept[:, 0], kept[:, 1]
                a.append(node[s:e][i])
                b.append(node[s:e][j])
        if not a:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, schema=schema)
        a, b = np.concatenate(a), np.concatenate(b)
        low, high = np.minimum(a, b), np.maximum(a, b)
        both = np.unique(np.stack([low, high], axis=1)[low != high], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)], schema=schema)

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if rest is not None:
            rows = pa.concat_tables([rest, rows]).combine_chunks()
        if not rows.num_rows:
            continue
        last = [rows.column(c)[rows.num_rows - 1] for c in ("h", "band", "one", "two")]
        same = np.ones(rows.num_rows, bool)
        for c, v in zip(("h", "band", "one", "two"), last):
            same &= rows.column(c).to_numpy() == v.as_py()
        begin = int(np.flatnonzero(same)[0])
        rest = rows.slice(begin)
        if begin:
            yield pairs_of(rows.slice(0, begin).combine_chunks())
    if rest is not None and rest.num_rows:
        yield pairs_of(rest.combine_chunks())


#: SQL: sizes in one band are within 4/3.
_BAND = f"cast(floor(ln(n) / {math.log(4 / 3)}D + 1e-9D) as long)"
_TILE = ["h", "band", "one", "two"]


def _tagged(classes: DataFrame, groups: DataFrame | None) -> DataFrame:
    """node, tiles (h, members, large): each class with its tiles of several classes, or with groups of several components; large is one of those that holds half of the tile."""
    seeds = classes.select("node", F.explode("sketch").alias("h"))
    if groups is None:
        shared = seeds.groupBy("h").agg(F.count(F.lit(1)).alias("members"), F.lit(None).cast("long").alias("large")).filter("members > 1")
    else:
        each = seeds.join(groups, "node").groupBy("h", "component").agg(F.count(F.lit(1)).alias("k"))
        largest = F.min(F.struct((-F.col("k")).alias("k"), "component"))
        shared = each.groupBy("h").agg(F.sum("k").alias("members"), largest.alias("top"), F.count(F.lit(1)).alias("c")).filter("c > 1")
        shared = shared.select("h", "members", F.when(-2 * F.col("top.k") >= F.col("members"), F.col("top.component")).alias("large"))
    shared = scratch(shared, "jaccard-tiles")
    total = shared.agg(F.sum("members")).first()[0] or 0
    joined = split_join(seeds, shared, ["h"], hot_keys(shared.select("h", F.col("members").alias("n")), ["h"], total))
    return scratch(joined.groupBy("node").agg(F.collect_list(F.struct("h", "members", "large")).alias("tiles")), "jaccard-tagged")


def _compared(rows: DataFrame, groups: bool) -> DataFrame:
    """Pairs (a, b) that pass, from rows (one, two, the tile's other columns): each tile's spanning forest, or with groups all pairs between components."""
    extra = ["component"] if groups else []
    rows = rows.withColumn("band", F.explode(F.when(F.col("own") > 0, F.array(F.col("own"), F.col("own") - 1)).otherwise(F.array("own"))))
    return (
        rows.select(*_TILE, "node", "n", "bitmap", *extra, "own", "block", "main")
        .repartition(*[F.col(c) for c in _TILE])
        .sortWithinPartitions(*_TILE, "n", "node")
        .mapInArrow(functools.partial(_tiles, all_pairs=groups), "a long, b long")
        .distinct()
    )


def _of_tiles(tagged: DataFrame, classes: DataFrame, which: str) -> DataFrame:
    """Rows (node, n, bitmap, h, members, large, own) of the tiles for which the SQL condition on t holds."""
    full = classes.select("node", F.col("n_shingles").alias("n"), "bitmap", *[c for c in ("component",) if c in classes.columns])
    rows = tagged.join(full, "node").withColumn("t", F.explode(F.expr(f"filter(tiles, t -> {which})"))).drop("tiles").select("*", "t.*").drop("t")
    return rows.withColumn("own", F.when(F.col("members") > SMALL, F.expr(_BAND)).otherwise(F.lit(-1)).cast("long"))


def _first_candidates(tagged: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) to verify: the spanning forest of each tile, or of each of its blocks of HOT classes.

    Blocks are dealt anew for each of DEALS kinds of tiles, so classes meet others in each.
    """
    rows = _of_tiles(tagged, classes, "true")
    block = F.expr(f"pmod(xxhash64(node, pmod(h, {DEALS}L)), cast(ceil(members / {HOT}) as long))")
    rows = rows.withColumn("block", block).withColumns({"one": F.col("block"), "two": F.col("block"), "main": F.lit(False)})
    return _compared(rows, False)


def _more_candidates(classes: DataFrame) -> DataFrame:
    """All passing pairs between components; classes (node, n_shingles, bitmap, sketch, component)."""
    tagged = _tagged(classes, classes.select("node", "component"))
    rows = _of_tiles(tagged, classes, "true").withColumn("main", F.coalesce(F.col("component") == F.col("large"), F.lit(False)))
    rows = rows.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("long")).withColumn("block", F.expr("pmod(xxhash64(node), blocks)"))
    places = F.expr("""CASE WHEN blocks = 1 THEN array(struct(0L AS one, 0L AS two)) WHEN main THEN array(struct(block AS one, -1L AS two))
        ELSE concat(if(large is null, cast(array() as array<struct<one: bigint, two: bigint>>), transform(sequence(0L, blocks - 1), o -> struct(o AS one, -1L AS two))),
          transform(sequence(0L, blocks - 1), o -> struct(least(block, o) AS one, greatest(block, o) AS two))) END""")
    return _compared(rows.withColumn("place", F.explode(places)).select("*", "place.*"), True)


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [x for _, x in shingle_sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([bitmap(x, WIDE) for x in sets], pa.binary())], names=["node", "hashes", "bitmap"])


def linked(one: np.ndarray, two: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, for sorted arrays of distinct values."""
    if len(one) > len(two):
        one, two = two, one
    at = np.searchsorted(two, one)
    common = int((two[np.minimum(at, len(two) - 1)] == one).sum()) if len(two) else 0
    return 100 * common >= 75 * (len(one) + len(two) - common)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        ok = [linked(np.frombuffer(left[k].as_buffer(), U64), np.frombuffer(right[k].as_buffer(), U64)) for k in range(batch.num_rows)]
        keep = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _verified(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    one = arrays.select(F.col("node").alias("a"), F.col("hashes").alias("one"))
    two = arrays.select(F.col("node").alias("b"), F.col("hashes").alias("two"))
    # a node with many copies around it is in very many pairs
    both = split_join(split_join(pairs, one, ["a"], hot_of(pairs, ["a"])), two, ["b"], hot_of(pairs, ["b"]))
    return both.select("a", "b", "one", "two").mapInArrow(_verify, "a long, b long").distinct()


def _classes(sets: DataFrame) -> DataFrame:
    return scratch(
        sets.filter("n_shingles > 0")
        .groupBy("class", "n_shingles")
        .agg(F.min("doc_id").alias("node"), F.first("bitmap").alias("bitmap"), F.first("sketch").alias("sketch"))
        .filter("node is not null"),
        "jaccard-classes",
    )


def _hot(texts: DataFrame) -> np.ndarray:
    """The hot shingles, sorted: MOST of them at most, the most frequent."""
    often = texts.mapInArrow(_looks, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT)
    return np.sort(np.array([r["h"] for r in often.orderBy(F.desc("n"), "h").limit(MOST).collect()], np.int64).view(U64))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id long, text): doc_id, n_shingles, component_id."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = scratch(texts.mapInArrow(functools.partial(_sketches, hot=_hot(texts).tobytes()), _SKETCH_SCHEMA), "jaccard-sets")
    classes = _classes(sets)
    tagged = _tagged(classes, None)
    pairs = _first_candidates(tagged, classes)
    pairs = scratch(pairs, "jaccard-pairs")
    # classes of tiles that weren't compared whole
    crowded = tagged.filter(f"exists(tiles, t -> t.members > {HOT})").select("node")
    hot = not crowded.isEmpty()
    ends = scratch(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowded).distinct(), "jaccard-ends")
    few = ends.count() <= BROADCAST_IDS
    chosen = texts.join(F.broadcast(ends) if few else ends, texts["doc_id"] == ends["node"]).select("node", "text")
    arrays = chosen.mapInArrow(_arrays, "node long, hashes binary, bitmap binary").groupBy("node", F.xxhash64("hashes").alias("x"))
    arrays = scratch(arrays.agg(F.first("hashes").alias("hashes"), F.first("bitmap").alias("bitmap")), "jaccard-arrays")
    links = scratch(_verified(pairs, arrays), "jaccard-links")
    groups = components(links)
    if hot or pairs.count() > links.count():
        # some pairs failed, or some weren't looked at: verify every passing pair between components as well
        own = ends.join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        among = classes.drop("bitmap").join(arrays.select("node", "bitmap", "hashes"), "node").join(own, "node")
        # of rows that share a doc_id but not a text, each class goes with its own text
        among = scratch(among.filter("octet_length(hashes) = 8 * n_shingles").drop("class", "hashes"), "jaccard-among")
        found = scratch(_verified(_more_candidates(among).join(pairs, ["a", "b"], "left_anti"), arrays), "jaccard-more")
        if not found.isEmpty():
            groups = components(links.unionByName(found))
    named = classes.select("class", "n_shingles", "node").join(groups, "node", "left").select("class", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    # a class may hold a third of all rows
    keys = ["class", "n_shingles"]
    asked = sets.select("doc_id", *keys)
    out = split_join(asked, named, keys, hot_of(asked, keys), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
