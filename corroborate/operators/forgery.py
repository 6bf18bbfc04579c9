"""Forgery model: binomial and Poisson-binomial tails as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Chance that a family is compromised.
FAMILY_PRIORS = (("AppCompat", 0.10), ("Background-service", 0.15), ("Explorer/NTUSER", 0.15), ("SysMain", 0.20), ("Kernel-ETW", 0.30))


def binomial_tail(n: Column, k: Column, p: Column) -> Column:
    """P(X >= k) for X ~ Binomial(n, p), 0 < p < 1; each term's logarithm follows from the one before."""
    n, k = n.cast("int"), k.cast("int")
    least = F.greatest(k, F.lit(0))
    first = _log_choose(n, least) + least * F.log(p) + (n - least) * F.log(1 - p)
    start = F.struct(F.lit(0.0).alias("total"), first.alias("term"))
    step = lambda s, i: F.struct((s["total"] + F.exp(s["term"])).alias("total"), (s["term"] + F.coalesce(F.log((n - i).cast("double")), F.lit(0.0)) - F.log(i + 1.0) + F.log(p) - F.log(1 - p)).alias("term"))
    total = F.aggregate(F.sequence(least, n), start, step)["total"]
    return F.when(k <= 0, 1.0).when(k > n, 0.0).otherwise(F.least(F.lit(1.0), total))


def _log_choose(n: Column, k: Column) -> Column:
    log_factorial = lambda v: F.aggregate(F.sequence(F.lit(1), F.greatest(v, F.lit(1))), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def poisson_binomial(priors: Column) -> Column:
    """Array: chance of 0, 1, 2, ... hits, for independent hits with the given chances."""
    start = F.array(F.lit(1.0))

    def step(a: Column, p: Column) -> Column:
        missed = F.transform(F.concat(a, F.array(F.lit(0.0))), lambda v: v * (1 - p))
        hit = F.transform(F.concat(F.array(F.lit(0.0)), a), lambda v: v * p)
        return F.zip_with(missed, hit, lambda x, y: x + y)

    return F.aggregate(priors, start, step)


def all_compromised(findings: DataFrame) -> DataFrame:
    """Adds forgery_p: the chance that all of a claim's families (array) are compromised; null without families."""
    prior = F.create_map(*[v for name, p in FAMILY_PRIORS for v in (F.lit(name), F.lit(p))])
    return findings.withColumn("forgery_p", F.when(F.size("families") > 0, F.element_at(poisson_binomial(F.transform("families", lambda f: prior[f])), -1)))


def at_least(findings: DataFrame, k: int) -> DataFrame:
    """Adds tail_p: the chance that ``k`` or more of a claim's families (array) are compromised; null without families."""
    prior = F.create_map(*[v for name, p in FAMILY_PRIORS for v in (F.lit(name), F.lit(p))])
    hits = poisson_binomial(F.transform("families", lambda f: prior[f]))
    tail = F.aggregate(F.slice(hits, k + 1, F.size("families") + 1), F.lit(0.0), lambda s, v: s + v)
    return findings.withColumn("tail_p", F.when(F.size("families") > 0, tail))


def straddle(n_bytes: Column, pattern: int, limit: int) -> Column:
    """Chance that a pattern of so many bytes lies across the limit of a longer text; 0 for texts within it."""
    return F.when(n_bytes > limit, F.lit((pattern - 1) / (limit - pattern + 1))).otherwise(0.0)
