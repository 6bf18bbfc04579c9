"""URL filters: fixed rules, then a tree of path templates for each host.

Shapes. A path is cut at each ``/`` into segments, of any number, and a segment that is variable by its look becomes a
wildcard: an UUID, a date, a number, a hexadecimal id, a slug that ends in a number (the last three keep a file
extension). Pages are summed to (host, shape) before the first shuffle, so the tree grows with the shapes.

The tree. Shapes go down the tree of their host, each with the template it has so far:

1.  Wildcards: a segment becomes ``*`` if its parent has over MANY children and it holds under RARE of the parent's pages.
2.  Merging: two siblings are alike if no segment (or end, ``$``) that follows them differs in its share by more than
    LEVEL * (1 / sqrt(pages of one) + 1 / sqrt(pages of the other)), the bound of Hoeffding for two samples of one
    distribution, and that bound is under 1: with too few pages nothing could differ. Labels are not looked at. A sibling joins the largest that it is alike to (of several the first by name), and a
    branch of several siblings is named ``~`` and that one. After step 1 a parent has at most 1 / RARE + 1 children, or
    MANY, so siblings can be compared in pairs. Only the next segment is compared, so leaves of one parent with enough pages each are always alike.
3.  Both steps run at once for all parents of the next AHEAD segments, as though nothing were renamed on the way to them. A
    shape keeps its segments up to the first that is renamed, and the next round goes on from there; the shapes of one
    template have come by the same renamed segments, so they are together again. Parents of under LEAST_PAGES pages can't
    rename anything, nor can what lies below them. So the rounds count the renamed segments of a path (and its AHEADs), not
    its depth, and a shape leaves when nothing on its way is renamed any more.

A real segment that begins like a label (``~``, ``*``, ``{`` or ``$``) is written with a ``?`` before it, which no path holds, so that no
label is the name of a segment.

A page that a rule fits is labelled with the rule's verdict. A template's purity is (blocked + PRIOR / 2) / (labelled +
PRIOR) over all its pages, and it is rejected from REJECT up; so a template needs labelled pages to be rejected, and
passes its verdict to those that no rule fits. Such a page gets its template's verdict, any other its longest rule's.

Everything is in DataFrame operations. Hot hosts, segments and shapes are split in joins. Null url or no ``://``: host and path
are empty, and so is the template. Null page_id: kept. Repeated rows count as often as they occur and are judged alike.
Very long urls are read whole. An empty table gives an empty result. Columns other than page_id and url aren't
looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm.common import LEAST_HOT, hot_keys, hot_of, scratch, split_join, table

#: (verdict, rule); a rule is host/path, and the longest that fits decides.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MANY, RARE, PRIOR, REJECT = 20, 0.02, 2.0, 0.8
#: sqrt(ln(2 / 0.05) / 2): two samples of one distribution are told apart in one case of twenty.
LEVEL = 1.3581
#: Pages that a parent needs for any renaming: over MANY children, or two branches whose bound is under 1 (equal ones need fewest).
LEAST_PAGES = min(MANY + 1, int(8 * LEVEL**2) + 1)
#: Segments of a path that one round looks at.
AHEAD = 32
#: A real segment that begins like a label.
LABEL = "^[~*{$]"
#: Looks of variable segments: a pattern, and the wildcard with the pattern's last group behind it.
SHAPES = (
    (r"^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}()\z", "{uuid}"),
    (r"^(?:19|20)[0-9]{2}[-_.]?(?:0[1-9]|1[0-2])[-_.]?(?:0[1-9]|[12][0-9]|3[01])()\z", "{date}"),
    (r"^[0-9]+((?:[.][a-z]+)?)\z", "{n}"),
    (r"^(?:[0-9A-Fa-f]*[0-9][0-9A-Fa-f]{7,}|[0-9A-Fa-f]{7,}[0-9][0-9A-Fa-f]*)((?:[.][a-z]+)?)\z", "{hex}"),
    (r"^[A-Za-z][A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)*[-_][0-9]+((?:[.][a-z]+)?)\z", "{slug}"),
)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits host and path (longest as text, then first in the list)."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, start = rule.partition("/")
        out = F.when(((host == name) | host.endswith("." + name)) & path.startswith("/" + start), F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    return F.coalesce(*[F.when(rule == name, F.lit(verdict)) for verdict, name in rules])


def shape_of(segment: Column) -> Column:
    out = F.when(segment.rlike(LABEL), F.concat(F.lit("?"), segment)).otherwise(segment)
    for pattern, name in reversed(SHAPES):
        out = F.when(segment.rlike(pattern), F.concat(F.lit(name), F.regexp_extract(segment, pattern, 1))).otherwise(out)
    return out


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, shape of each row of pages (page_id, url)."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")
    lower = F.translate(F.regexp_extract("rest", "(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = pages.select("page_id", rest.alias("rest")).select("page_id", lower.alias("host"), F.regexp_extract("rest", "(?s)^[^/?#]*(/[^?#]*)", 1).alias("path"))
    segments = F.transform(F.expr("slice(split(path, '/'), 2, length(path) + 1)"), shape_of)
    return out.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path")).alias("rule"), segments.alias("shape"))


def wildcards(divided: DataFrame, large: bool) -> DataFrame:
    """host, t, s, g: the segments of each parent (host, t), generalised (step 1); from divided (host, t, s, x, n)."""
    children = divided.groupBy("host", "t", "s").agg(F.sum("n").alias("pages"))
    parents = children.groupBy("host", "t").agg(F.sum("pages").alias("total"), F.count(F.lit(1)).alias("n"))
    both = split_join(children, parents, ["host", "t"], hot_keys(parents, ["host", "t"], children.count() if large else 0))
    rare = (F.col("n") > MANY) & (F.col("pages") < RARE * F.col("total"))
    return both.select("host", "t", "s", F.when(rare, "*").otherwise(F.col("s")).alias("g"))


def alike(division: DataFrame) -> DataFrame:
    """host, t, g, label: the branches of each parent (host, t), merged (step 2); from division (host, t, g, x, f)."""
    parent = ["host", "t"]
    branches = division.groupBy(*parent, "g").agg(F.sum("f").alias("m"))
    other = branches.select(*parent, F.col("g").alias("h"), F.col("m").alias("k"))
    bound = F.lit(LEVEL) * (1 / F.sqrt("m") + 1 / F.sqrt("k"))
    pairs = branches.join(other, parent).filter((F.col("g") != F.col("h")) & (bound < 1))
    # what follows g more often than h by over the bound; only shares over the bound can, few for each branch
    often = division.join(branches, [*parent, "g"]).filter(F.col("f") > LEVEL * F.sqrt("m"))
    shares = division.select(*parent, F.col("g").alias("h"), "x", F.col("f").alias("e"))
    told = often.join(other, parent).filter("g <> h").join(shares, [*parent, "h", "x"], "left")
    apart = told.filter(F.col("f") / F.col("m") - F.coalesce("e", F.lit(0)) / F.col("k") > bound).select(*parent, "g", "h")
    apart = apart.unionByName(apart.select(*parent, F.col("h").alias("g"), F.col("g").alias("h"))).distinct()
    chosen = pairs.join(apart, [*parent, "g", "h"], "left_anti").select(*parent, "g", "h", "k")
    chosen = chosen.unionByName(branches.select(*parent, "g", F.col("g").alias("h"), F.col("m").alias("k")))
    leaders = chosen.groupBy(*parent, "g").agg(F.min(F.struct((-F.col("k")).alias("k"), "h"))["h"].alias("leader"))
    groups = leaders.groupBy(*parent, "leader").agg(F.collect_set("g").alias("members"))
    name = F.when(F.size("members") > 1, F.concat(F.lit("~"), "leader")).otherwise(F.col("members")[0])
    return groups.select(*parent, name.alias("label"), F.explode("members").alias("g"))


def templates(shapes: DataFrame) -> DataFrame:
    """host, shape, template of each row of shapes (host, shape array, n)."""
    active = shapes.select("host", "shape", "n", F.lit("").alias("t"), F.col("shape").alias("rest"))
    done: list[DataFrame] = []
    parent, child, branch, row = ["host", "t"], ["host", "t", "s"], ["host", "t", "g"], ["host", "shape"]
    while True:
        # each shape at each of the next parents on its way, as if no segment before were renamed
        ahead = active.select(*row, "n", "t", "rest", F.posexplode(F.slice("rest", 1, AHEAD)).alias("i", "s"))
        way = F.when(F.col("i") > 0, F.concat(F.lit("/"), F.array_join(F.expr("slice(rest, 1, i)"), "/"))).otherwise("")
        x = F.coalesce(F.get("rest", F.col("i") + 1), F.lit("$"))
        last = (F.col("i") == AHEAD - 1) & (F.size("rest") > AHEAD)
        steps = ahead.select(*row, "n", F.concat("t", way).alias("t"), "s", x.alias("x"), "i", last.alias("last"))
        divided = scratch(steps.groupBy(*child, "x").agg(F.sum("n").alias("n")), "url-divided")
        rows = steps.count()
        # no table of this round has more rows than that, so below the bound none can have a hot key
        large = rows > LEAST_HOT

        def hot(table: DataFrame, keys: list[str]) -> DataFrame:
            return hot_of(table.select(*keys), keys) if large else hot_keys(table.select(*keys, F.lit(1).alias("n")), keys, 0)

        totals = divided.groupBy(*parent).agg(F.sum("n").alias("total")).filter(F.col("total") >= LEAST_PAGES)
        totals = scratch(totals.select(*parent), "url-parents")
        divided = scratch(split_join(divided, totals, parent, hot(divided, parent)), "url-crowded")
        general = scratch(wildcards(divided, large), "url-general")
        division = split_join(divided, general, child, hot(divided, child)).groupBy(*branch, "x").agg(F.sum("n").alias("f"))
        labels = alike(scratch(division, "url-division"))
        renamed = scratch(split_join(general, labels, branch, hot(general, branch)).filter("s <> label").select(*child, "label"), "url-renamed")
        # where each shape is renamed first; else it goes on beyond AHEAD segments, if there are pages enough
        named = split_join(steps.select(*row, "i", *parent[1:], "s"), renamed, child, hot(steps, child)).select(*row, (F.col("i") + 1).alias("passed"), F.lit(0).alias("raw"), F.concat("t", F.lit("/"), "label").alias("to"))
        beyond = steps.filter("last").select(*row, *parent[1:], "s")
        onward = split_join(beyond, totals, parent, hot(beyond, parent)).select(*row, F.lit(AHEAD).alias("passed"), F.lit(1).alias("raw"), F.concat("t", F.lit("/"), "s").alias("to"))
        first = named.unionByName(onward).groupBy(*row).agg(F.min(F.struct("passed", "raw", "to")).alias("first"))
        moved = scratch(active.join(first, row, "left"), "url-moved")
        rest = F.expr("slice(rest, first.passed + 1, size(rest))")
        settled = moved.filter(F.col("first").isNull())
        done.append(settled.select(*row, F.concat("t", F.when(F.size("rest") > 0, F.concat(F.lit("/"), F.array_join("rest", "/"))).otherwise("")).alias("template")))
        moved = moved.filter(F.col("first").isNotNull()).select(*row, "n", F.col("first.to").alias("t"), rest.alias("rest"))
        done.append(moved.filter(F.size("rest") == 0).select(*row, F.col("t").alias("template")))
        active = moved.filter(F.size("rest") > 0)
        if active.isEmpty():
            break
    out = done[0]
    for one in done[1:]:
        out = out.unionByName(one)
    return out


def filter_urls(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of each row of pages (page_id, url)."""
    rows, key = parsed(pages), ["host", "shape"]
    label = verdict_of(F.col("rule"))
    shapes = scratch(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count("rule").alias("labelled"), F.count_if(label == "block").alias("blocked")), "url-shapes")
    whole = ["host", "template"]
    tree = scratch(shapes.join(templates(shapes), key), "url-templates")
    purity = (F.sum("blocked") + PRIOR / 2) / (F.sum("labelled") + PRIOR)
    pure = tree.groupBy(*whole).agg(purity.alias("purity"))
    judged = scratch(split_join(tree.select(*key, "template"), pure, whole, hot_of(tree.select(*whole), whole)), "url-judged")
    total = shapes.agg(F.sum("n")).first()[0] or 0
    both = split_join(rows, judged, key, hot_keys(shapes, key, total))
    verdict = F.coalesce(label, F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return both.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.concat("host", "template").alias("template"), "purity")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


#: Levels that the SQL is written out for; the given tables' paths have fewer segments.
SQL_LEVELS = 5


def _level_sql(k: int) -> str:
    """One level of the tree for DuckDB: windows over rows instead of joins, and a two-sided comparison of whole distributions."""
    before = f"l{k - 1}"
    return f"""
s{k} AS (SELECT host, segs, n, t, segs[{k}] AS s, coalesce(segs[{k + 1}], '$') AS x FROM {before} WHERE len(segs) >= {k}),
c{k} AS (SELECT host, t, s, sum(n) AS pages, sum(sum(n)) OVER (PARTITION BY host, t) AS total, count(*) OVER (PARTITION BY host, t) AS kids FROM s{k} GROUP BY host, t, s),
g{k} AS (SELECT host, t, s, if(kids > {MANY} AND pages < {RARE} * total, '*', s) AS g FROM c{k}),
d{k} AS (SELECT g.host, g.t, g.g, s.x, sum(s.n) AS f, sum(sum(s.n)) OVER (PARTITION BY g.host, g.t, g.g) AS m FROM s{k} s JOIN g{k} g USING (host, t, s) GROUP BY g.host, g.t, g.g, s.x),
b{k} AS (SELECT DISTINCT host, t, g, m FROM d{k}),
y{k} AS (SELECT DISTINCT host, t, x FROM d{k}),
p{k} AS (SELECT a.host, a.t, a.g, b.g AS h, any_value(b.m) AS k,
  {LEVEL} * (1 / sqrt(any_value(a.m)) + 1 / sqrt(any_value(b.m))) AS bound, bound < 1 AND max(abs(coalesce(u.f, 0) / a.m - coalesce(v.f, 0) / b.m)) <= bound AS same
  FROM b{k} a JOIN b{k} b USING (host, t) JOIN y{k} y USING (host, t)
  LEFT JOIN d{k} u ON u.host = a.host AND u.t = a.t AND u.g = a.g AND u.x = y.x LEFT JOIN d{k} v ON v.host = a.host AND v.t = a.t AND v.g = b.g AND v.x = y.x
  GROUP BY a.host, a.t, a.g, b.g),
o{k} AS (SELECT host, t, g, first(h ORDER BY k DESC, h) AS leader FROM p{k} WHERE same OR g = h GROUP BY host, t, g),
n{k} AS (SELECT host, t, g, if(count(*) OVER (PARTITION BY host, t, leader) > 1, '~' || leader, g) AS label FROM o{k}),
l{k} AS (SELECT host, segs, n, t, true AS ended FROM {before} WHERE len(segs) < {k}
  UNION ALL SELECT s.host, s.segs, s.n, s.t || '/' || n.label, false FROM s{k} s JOIN g{k} g USING (host, t, s) JOIN n{k} n ON n.host = s.host AND n.t = s.t AND n.g = g.g)"""


def _oracle() -> str:
    shape = f"if(regexp_matches(v, '{LABEL}'), '?' || v, v)"
    for pattern, name in reversed(SHAPES):
        shape = f"if(regexp_matches(v, '{pattern}'), '{name}' || regexp_extract(v, '{pattern}', 1), {shape})"
    rules = "(VALUES " + ", ".join("('{}', '{}', '{}', '/{}')".format(v, r, *r.partition("/")[::2]) for v, r in RULES) + ") AS r(verdict, rule, rule_host, rule_path)"
    parts = "string_split(url, '://')"
    return f"""WITH cut AS (SELECT row_number() OVER () AS i, page_id, CASE WHEN len({parts}) > 1 THEN array_to_string({parts}[2:], '://') ELSE '' END AS rest FROM pages),
named AS (SELECT i, page_id, list_aggregate(list_transform(string_split(regexp_extract(rest, '^[^/?#]*'), ''), lambda c: if(c BETWEEN 'A' AND 'Z' AND length(c) = 1, lower(c), c)), 'string_agg', '') AS host,
  regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1, 's') AS path FROM cut),
fits AS (SELECT i, rule, verdict, row_number() OVER (PARTITION BY i ORDER BY length(rule) DESC) AS place FROM named JOIN {rules} ON ('.' || host) LIKE ('%.' || rule_host) AND starts_with(path, rule_path)),
p AS (SELECT n.*, coalesce(n.host, '') AS h0, f.rule, f.verdict, if(path = '', [], list_transform(string_split(path, '/')[2:], lambda v: {shape})) AS segs FROM named n LEFT JOIN fits f ON n.i = f.i AND f.place = 1),
l0 AS (SELECT h0 AS host, segs, count(*) AS n, '' AS t, false AS ended FROM p GROUP BY h0, segs),
{",".join(_level_sql(k) for k in range(1, SQL_LEVELS + 1))},
pure AS (SELECT l.host, l.t, (count(*) FILTER (p.verdict = 'block') + {PRIOR / 2}) / (count(p.verdict) + {PRIOR}) AS purity FROM p JOIN l{SQL_LEVELS} l ON p.h0 = l.host AND p.segs = l.segs GROUP BY l.host, l.t)
SELECT p.page_id, p.h0 AS host, p.path, p.rule, coalesce(p.verdict, if(u.purity >= {REJECT}, 'block', 'allow')) AS verdict, p.h0 || l.t AS template, u.purity
FROM p JOIN l{SQL_LEVELS} l ON p.h0 = l.host AND p.segs = l.segs JOIN pure u ON u.host = l.host AND u.t = l.t"""


ORACLE_SQL = _oracle()
