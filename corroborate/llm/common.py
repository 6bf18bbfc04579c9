"""Session helpers of this subpackage: reading tables, shared scratch tables, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key with over a 1 / PARTS of all rows, and over LEAST_HOT of them, is split in a join.
PARTS, LEAST_HOT = 1000, 10_000


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores after those that the columns have already (upper and lower case are alike)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a folder of its own; a cluster's executors couldn't see that, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Limits the Arrow batches that go to Python workers: texts are long, and workers hold a batch at a time.

    Spark reads these settings from the session when a job runs, so they stay as set; no result depends on them.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Values that stand in the table of hot keys where no key is hot, by type; 0 for all other types.
_ANY = {"string": "", "binary": b"", "array": []}


def hot_keys(counts: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Keys that hold over 1 / PARTS of ``total`` rows, from counts (keys, n), with the parts to split them into.

    There are at most PARTS such keys, and 2 * PARTS parts in all. The table is never empty: where no key is hot it has one
    row of one part, which changes no result. Spark would leave a join with an empty table out, so that plans differ by size.
    """
    hot = counts.filter((F.col("n") > LEAST_HOT) & (F.col("n") * PARTS > F.lit(total)))
    rows = hot.select(*keys, F.ceil(F.col("n") * PARTS / F.lit(max(1, total))).cast("int").alias("parts")).collect() if total > LEAST_HOT else []
    kinds = [counts.schema[k].dataType for k in keys]
    schema = ", ".join(f"`{k}` {kind.simpleString()}" for k, kind in zip(keys, kinds)) + ", parts int"
    return counts.sparkSession.createDataFrame(rows or [(*(_ANY.get(kind.typeName(), 0) for kind in kinds), 1)], schema)


def hot_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The hot keys of rows, which are counted here."""
    return hot_keys(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, rows.count())


def split_join(many: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """many join one (inner or left) on keys, where the rows of hot keys (see hot_keys) are dealt over parts and their partners repeated for each."""
    parts, part = unused([*many.columns, *one.columns], "parts", "part")
    known = F.broadcast(hot.withColumnRenamed("parts", parts))
    left = many.join(known, keys, "left").withColumn(part, F.coalesce(F.pmod(F.xxhash64(*many.columns), F.col(parts)).cast("int"), F.lit(0))).drop(parts)
    right = one.join(known, keys, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))).drop(parts)
    return left.join(right, [*keys, part], how).drop(part)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """edges join least (a, m, n) on a; nodes with very many neighbours are split."""
    return split_join(edges, least.select("a", "m"), ["a"], hot_keys(least, ["a"], total))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b long): rows (node, component), the smallest reachable node.

    Alternates large-star and small-star steps, each a grouped minimum and a join whose hot nodes are split, so
    that no task ever holds a component; every round is checkpointed. Self loops and repeated edges do no harm.
    Nodes without an edge aren't in the result.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    now = (
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
        .checkpoint()
    )
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _with_least(both.filter("b > a"), least, 2 * state[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        if state[0] > LEAST_HOT:
            large = large.checkpoint()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = (
            _with_least(large, least, state[0])
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter("a <> b")
            .distinct()
            .checkpoint()
        )
        after = _state(small)
        now = small
        if after == state:
            break
        state = after
    nodes = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)
