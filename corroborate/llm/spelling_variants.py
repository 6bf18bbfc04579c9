"""Spelling variants: a frontier of (word, position, node, edits) states walks a trie that is a table of edges.

Two words are near if they differ by one inserted, deleted or replaced code point. Where they first differ is in the second half of a
word or, read backwards, in the second half of the reversed word. So the trie holds all words and all reversed words, below two marks, and
a word leaves its own path only at nodes in its second half. Above the shortest word's second half no node is needed.

The trie is compressed: an edge's label goes on to the next node at which words part or end. It is built from the top, a level a round:
the words of a node's child agree as far as the smallest and the largest of them do. So long words cost few rounds, and
the number of rounds is the number of nodes on a path.

A word's states without an edit are the nodes on its own path, and need no walk. At each of these the edge table is joined once, for the edges
that the word doesn't take: one letter is replaced (the state's position moves on) or inserted (it stays); deletions are insertions
seen from the other word. From there on states have one edit. Level by level they join the edge of their next letter, whose label must
equal the word's letters, until none is left; a state that ends at a word makes the two near. States go early where a
node's words have other lengths, or where no edge begins with the next letter (by a set of 63 bits).

Every join is by node or edge; nodes with very many words are split (``split_join``). A word has at most one near word for each place and
letter, so the groups by word don't grow with the table.

Null and empty texts have no words. Null doc_id: hashed as the empty text. Repeated rows count again. Very long runs
of letters are words like others. Ties of n go to the smallest form. An empty table gives an empty result. Only doc_id and text are read, so other
columns may have any names.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corroborate.llm.common import hot_keys, hot_of, scratch, split_join, table

LETTERS = r"[A-Za-zÀ-ÿ]"
SHORTEST, OFTEN, TIMES = 6, 5, 5
#: One run in so many loses a code point.
DAMAGED = 199
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, often: int = OFTEN, damaged: int | None = DAMAGED) -> DataFrame:
    """(word, n) of the runs of letters in docs (doc_id, text) that have at least ``shortest`` code points and occur ``often``.

    Where ``damaged`` divides the CRC of ``<doc_id>:<run>``, the run loses one code point first; None leaves all as they are.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{shortest},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    word = F.col("run")
    if damaged:
        runs = runs.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run")))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % damaged == 0, F.concat(F.substring("run", 1, at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.groupBy(word.alias("word")).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= often) & (F.length("word") >= shortest))


@F.pandas_udf(T.StringType())
def _common(low: pd.Series, high: pd.Series) -> pd.Series:
    """What two words begin with, both."""
    return pd.Series([os.path.commonprefix(pair) for pair in zip(low, high)], dtype=str)


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges and the paths of the marked words (column w), below the letters that come before any second half.

    Edges: parent, edge (the parent and the label's first letter), node, is_word, the shortest and the longest word below, and the
    first letters of the node's own edges as bits. Paths: w and the nodes in its second half that have edges.
    """
    given = ((words.agg(F.min(F.length("w"))).first()[0] or 1) - 1) // 2 + 1
    rows, edges, paths = words.select("w", F.substring("w", 1, given).alias("edge")), None, None
    rows = scratch(rows, "trie-words")
    while True:
        total = rows.count()
        if edges is not None and not total:
            break
        ends = rows.groupBy("edge").agg(F.min("w").alias("low"), F.max("w").alias("high"), F.count(F.lit(1)).alias("n"), F.min(F.length("w")).alias("least"), F.max(F.length("w")).alias("most"))
        level = scratch(ends.withColumn("node", _common("low", "high")).withColumn("is_word", F.col("low") == F.col("node")).drop("low", "high"), "trie-nodes")
        edges = level if edges is None else edges.unionByName(level)
        inner = level.filter("n > 1").select("edge", "node")
        below = scratch(split_join(rows, inner, ["edge"], hot_keys(level, ["edge"], total)).select("w", "node"), "trie-words")
        own = below.filter("length(node) > (length(w) - 1) div 2")
        paths = own if paths is None else paths.unionByName(own)
        rows = below.filter("w <> node").select("w", F.expr("substring(w, 1, length(node) + 1)").alias("edge"))
    edges = edges.drop("n").filter("edge <> ''").withColumn("parent", F.expr("substring(edge, 1, length(edge) - 1)"))
    letters = edges.groupBy(F.col("parent").alias("node")).agg(F.bit_or(F.expr("shiftleft(1L, ascii(right(edge, 1)) % 63)")).alias("letters"))
    return scratch(edges.join(letters, "node", "left").withColumn("letters", F.coalesce("letters", F.lit(0))), "trie-edges"), scratch(paths, "trie-paths")


def _walked(states: DataFrame) -> DataFrame:
    """States (w, size, at, skip, edge and its columns) after the edge: its label, but for its first letter, equals the word's letters."""
    moved = states.withColumn("rest", F.expr("substring(node, length(edge) + 1)")).filter("substring(w, at + 1, length(rest)) = rest and size between least and most")
    moved = moved.withColumn("at", F.expr("at + length(rest)"))
    ended, open_ = F.expr("at = length(w)"), F.expr("at < length(w) and (letters & shiftleft(1L, ascii(substring(w, at + 1, 1)) % 63)) <> 0")
    return moved.filter((ended & F.col("is_word")) | open_).select("w", "size", "at", "node")


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (w, node) of marked words (column w) whose first difference, a letter replaced or inserted in w, is in w's second half; one way only."""
    edges, paths = trie(words)
    # where a word leaves its path: replaced (only by a greater letter, the rest is the other way round), or inserted
    left = split_join(paths, edges.withColumnRenamed("node", "child").withColumnRenamed("parent", "node"), ["node"], hot_of(paths, ["node"]))
    left = left.withColumn("own", F.expr("substring(w, length(node) + 1, 1)")).filter("right(edge, 1) <> own")
    edits = F.expr("if(own <> '' and right(edge, 1) > own, array(0, 1), array(0))")
    left = left.withColumn("skip", F.explode(edits)).withColumn("at", F.expr("length(node) + skip")).withColumn("size", F.expr("length(w) + 1 - skip"))
    states = scratch(_walked(left.drop("node").withColumnRenamed("child", "node")), "trie-frontier")
    found = None
    while True:
        done = states.filter("at = length(w)").select("w", "node")
        found = done if found is None else found.unionByName(done)
        states = states.filter("at < length(w)").select("w", "size", F.expr("at + 1").alias("at"), F.expr("concat(node, substring(w, at + 1, 1))").alias("edge"))
        if states.isEmpty():
            return found
        states = scratch(_walked(split_join(states, edges.drop("parent"), ["edge"], hot_of(states, ["edge"]))), "trie-frontier")


def near_words(words: DataFrame) -> DataFrame:
    """(word, near) of all near words, both ways, each pair once."""
    # both tries are one: a word stands below the mark >, and reversed below the mark <
    marked = words.select(F.explode(F.array(F.concat(F.lit(">"), "word"), F.concat(F.lit("<"), F.reverse("word")))).alias("w"))
    plain = [F.expr(f"if(startswith({c}, '<'), reverse(substring({c}, 2)), substring({c}, 2))") for c in ("w", "node")]
    pairs = near_pairs(scratch(marked, "trie-marked")).select(plain[0].alias("a"), plain[1].alias("b"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("p"))
    return both.select("p.word", "p.near").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): from each word of forms (word, form) along the forms to the last. n rises along them, so they end."""
    now = scratch(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = scratch(split_join(now, ahead, ["root"], hot_of(now, ["root"]), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        now = after.drop("moved")
        if after.filter("moved").isEmpty():
            return now


def spelling_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """words (word, n) with n_near, the form (the near word of largest n, at least ``times`` the word's), form_n and root."""
    words = scratch(words.select("word", "n"), "spelling-words")
    near = near_words(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))).alias("best"))
    judged = scratch(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.n") >= times * F.col("n"), F.col("best")).alias("best")), "spelling-forms")
    forms = judged.filter("best is not null").select("word", F.col("best.form").alias("form"))
    out = judged.join(roots(forms), "word", "left")
    return out.select("word", F.col("best.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", (-F.col("best.n")).alias("form_n"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(vocabulary(table(spark, sf_dir, "documents")))


#: Near words by what is left of them without one letter; CRC from its definition.
ORACLE_SQL = r"""
WITH bits AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
 runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
 low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM runs WHERE length(run) >= 6),
 hexed AS (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM low),
 bytes AS (SELECT run, list_transform(range(length(x) // 2), lambda i: (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1) AS b FROM hexed),
 crc AS (SELECT run, xor(list_reduce(list_prepend(4294967295, b), lambda c, v: xor(c // 256, t[xor(c % 256, v) + 1])), 4294967295) AS h FROM bytes, bits),
 forms AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM crc),
 words AS (SELECT word, count(*) AS n FROM forms WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
 cuts AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
 near AS (
  SELECT a.word, b.word AS near FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cuts a JOIN words b ON a.cut = b.word
  UNION SELECT b.word, a.word FROM cuts a JOIN words b ON a.cut = b.word),
 ranked AS (SELECT near.word, w.word AS form, w.n AS form_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, w.word) AS r
  FROM near JOIN words w ON w.word = near.near),
 judged AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN ranked ON ranked.word = w.word AND r = 1),
 steps AS (WITH RECURSIVE s AS (SELECT word, word AS last, 0 AS k FROM judged UNION ALL SELECT s.word, j.form, k + 1 FROM s JOIN judged j ON j.word = s.last WHERE j.form IS NOT NULL) SELECT word, arg_max(last, k) AS root FROM s GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN steps USING (word)
"""
