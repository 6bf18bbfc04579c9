"""Running aggregates over long ordered groups, cut into ranges so that no task sorts a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 200


def with_range(df: DataFrame, column: str, ranges: int = RANGES, out: str = "_range") -> DataFrame:
    """Adds the number of the range that a numeric, date or time column falls into; nulls are in range 0, as they sort first.

    The bounds are approximate quantiles, one array of ``ranges`` - 1 values as a scalar subquery. Equal values share a
    range, so ranges follow each other in the column's order; one value with very many rows stays whole.
    """
    at = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    bounds = df.agg(F.percentile_approx(column, at, F.lit(10_000)).alias("b")).scalar()
    held = df.withColumn("_bounds", bounds)  # a subquery can't stand inside a higher-order function
    return held.withColumn(out, F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col(column))), F.lit(0))).drop("_bounds")


def before_range(df: DataFrame, by: list[str], value: Column, fold, out: str, number: str = "_range") -> DataFrame:
    """Adds ``out``: ``fold`` (F.sum or F.max) of ``value`` over the ranges before a row's own, by group; null if there are none.

    The window runs over one row for each group and range.
    """
    parts = df.groupBy(*by, number).agg(fold(value).alias("_part"))
    earlier = Window.partitionBy(*by).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.select(*[F.col(b).alias(f"_by_{b}") for b in by], F.col(number).alias("_number"), fold("_part").over(earlier).alias(out))
    same = F.col(number) == F.col("_number")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    return df.join(sums, same).drop("_number", *[f"_by_{b}" for b in by])
