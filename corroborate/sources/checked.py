"""Tables that are only published when their checks hold: rows are counted while they are written, and readers ask for the verdict."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Halted(Exception):
    """A check failed; ``counts`` has the number of offending rows by check."""

    def __init__(self, path: str, counts: Mapping[str, int]):
        super().__init__(f"{path} isn't published: " + ", ".join(f"{n} rows fail {name}" for name, n in sorted(counts.items()) if n))
        self.counts = dict(counts)


def write_checked(df: DataFrame, path: str, bad: Mapping[str, Column]) -> dict[str, int]:
    """Writes df below path and, if no row is bad by any check, the verdict that publishes it; else Halted.

    The counts are observed in the job that writes, so the rows are computed once. A table without a verdict (a check failed, or
    the job died) can't be read by ``read_checked``. A null verdict on a row isn't bad.
    """
    spark, seen = df.sparkSession, Observation("checks")
    names = list(bad)
    watched = df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *[F.count_if(bad[n]).alias(f"check_{k}") for k, n in enumerate(names)])
    watched.write.mode("errorifexists").parquet(f"{path}/rows")
    counts = {n: seen.get[f"check_{k}"] for k, n in enumerate(names)}
    if any(counts.values()):
        raise Halted(path, counts)
    spark.createDataFrame([(seen.get["n_rows"], names)], "n_rows long, checks array<string>").coalesce(1).write.parquet(f"{path}/verdict")
    return counts


def read_checked(spark: SparkSession, path: str) -> DataFrame:
    """A published table; an error (no such path) where there is no verdict."""
    spark.read.parquet(f"{path}/verdict").first()
    return spark.read.parquet(f"{path}/rows")


def publish_audit(audit: DataFrame, path: str) -> dict[str, int]:
    """The rows of ``artifacts.audit_hashes``; halts where a hash differs from the published one, or a published artifact is missing."""
    return write_checked(audit, path, {"published_hash": F.col("status") == "mismatch", "artifact_present": F.col("status") == "missing"})


def publish_rows(rows: DataFrame, path: str, most: int) -> dict[str, int]:
    """Numbered rows (row_index from 0, by artifact); halts where an artifact has more than ``most``. Exactly as many pass."""
    return write_checked(rows, path, {"row_cap": F.col("row_index") >= most})


def publish_rates(rates: DataFrame, path: str, counts: list[str], shares: list[str]) -> dict[str, int]:
    """A table of metrics; halts where a count is negative, or a share is neither null nor in 0 .. 1."""
    negative = {f"{c}_not_negative": F.col(c) < 0 for c in counts}
    return write_checked(rates, path, negative | {f"{c}_in_range": F.col(c).isNotNull() & ~F.coalesce(F.col(c).between(0, 1), F.lit(True)) for c in shares})
