"""Scores of recorded answers, rates by arm, intervals and selective metrics. Undefined rates stay null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.operators.lineage import checkpointed
from corroborate.operators.running import before_range, with_range

# Normal quantiles of the supported levels.
Z = {90: 1.6448536269514722, 95: 1.959963984540054, 99: 2.5758293035489004}
STATUSES = ("DRAFT_TAMPER_SUSPECTED", "DRAFT", "CORROBORATED", "FINAL")


def rate(hit: Column, among: Column) -> Column:
    """Mean of a condition over the rows of another; null if there are none."""
    return F.avg(F.when(among, hit.cast("double")))


def score_answer(answer: Column, expected: Column) -> Column:
    """``~`` begins a pattern to be found; anything else is a text to be contained, whatever the case."""
    return F.when(expected.startswith("~"), F.regexp(answer, F.substr(expected, F.lit(2)))).otherwise(F.contains(F.lower(answer), F.lower(expected)))


def question_correct(kind: Column, status: Column, arm: Column, answer: Column, scored: Column, gateless: tuple[str, ...] = ("bare",)) -> Column:
    """Adversarial questions want a draft from an arm with a gate; a marker answer is wrong in the gated arm."""
    draft = F.coalesce(status.isin("DRAFT", "DRAFT_TAMPER_SUSPECTED"), F.lit(False))
    adversarial = F.when(arm.isin(*gateless), F.lit(False)).otherwise(draft)
    return F.when(kind == "adversarial", adversarial).when((arm == "gated") & answer.startswith("<"), F.lit(False)).otherwise(scored)


def arm_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Accuracy and its population deviation, wrong and right shares at CORROBORATED, abstention, mean cost columns."""
    status, right = F.col("claim_status"), F.col("correct")
    confirmed = status == "CORROBORATED"
    abstained = status.isNull() | status.isin("DRAFT", "DRAFT_TAMPER_SUSPECTED")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(right.cast("double")).alias("accuracy"), F.stddev_pop(right.cast("double")).alias("accuracy_std"),
        rate(~right, confirmed).alias("false_confidence"), rate(right, confirmed).alias("precision_corroborated"),
        F.when(F.count(status) > 0, F.avg(abstained.cast("double"))).alias("abstention"),
        F.avg("wallclock_ms").alias("mean_ms"), F.avg("tokens_in").alias("mean_tokens_in"), F.avg("tokens_out").alias("mean_tokens_out"),
    )


def wilson(counts: DataFrame, k: str, n: str, level: int = 95) -> DataFrame:
    """Adds ci_low and ci_high."""
    z = Z[level]
    size, p = F.col(n).cast("double"), F.col(k) / F.col(n)
    scale = 1 + z * z / size
    middle, margin = (p + z * z / (2 * size)) / scale, z / scale * F.sqrt(p * (1 - p) / size + z * z / (4 * size * size))
    low, high = F.greatest(F.lit(0.0), middle - margin), F.least(F.lit(1.0), middle + margin)
    return counts.withColumn("ci_low", F.when(F.col(n) <= 0, 0.0).otherwise(low)).withColumn("ci_high", F.when(F.col(n) <= 0, 1.0).otherwise(high))


def arm_family_counts(rows: DataFrame) -> DataFrame:
    """k and n by arm, and by arm and family, in one pass; family is null in an arm's own row."""
    return rows.groupingSets([["arm"], ["arm", "family"]], "arm", "family").agg(F.sum(F.col("correct").cast("long")).alias("k"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def tagged_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("arm", "family").agg(F.countDistinct("q_id").alias("tagged"), F.sum(F.col("correct").cast("long")).alias("n_correct"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def variance_flag(metrics: DataFrame, limit: float = 0.15) -> DataFrame:
    return metrics.withColumn("high_variance", F.when(F.col("accuracy") == 0, False).otherwise(F.col("accuracy_std") / F.col("accuracy") > limit))


def cost(rows: DataFrame, prices: dict[str, float]) -> Column:
    """Sum of usage times price per million; a missing price or count is 0."""
    total = F.lit(0.0)
    for name, price in prices.items():
        if name in rows.columns:
            total = total + F.coalesce(F.col(name), F.lit(0)) * price
    return total / 1e6


def budget_cutoff(rows: DataFrame, order: list[str], cost_column: str, cap: float, by: list[str]) -> DataFrame:
    """Rows before the first one with spent + own cost >= cap, in order, per group.

    The first column of ``order`` (a number, date or time) cuts the groups into ranges, each a window of its own.
    """
    cut = before_range(with_range(rows, order[0]), by, F.col(cost_column), F.sum, "_spent_before")
    own = Window.partitionBy(*by, "_range").orderBy(*order)
    before, so_far = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, 0)
    spent = cut.withColumn("spent", F.coalesce("_spent_before", F.lit(0)) + F.coalesce(F.sum(cost_column).over(before), F.lit(0)))
    stops = spent.withColumn("_stop", (F.col("spent") + F.col(cost_column) >= cap).cast("int"))
    stops = before_range(stops.withColumn("_stopped", F.max("_stop").over(so_far)), by, F.col("_stop"), F.max, "_stopped_before")
    return stops.filter((F.coalesce("_stopped", F.lit(0)) == 0) & (F.coalesce("_stopped_before", F.lit(0)) == 0)).drop("_stop", "_stopped", "_stopped_before", "_spent_before", "_range")


def budget_outcome(rows: DataFrame, kept: DataFrame, by: list[str]) -> DataFrame:
    """Per group: rows, rows that ``budget_cutoff`` kept, partial and its reason (null if all were kept)."""
    both = rows.select(*by, F.lit(0).alias("_kept")).unionByName(kept.select(*by, F.lit(1).alias("_kept")))
    out = both.groupBy(*by).agg(F.count_if(F.col("_kept") == 0).alias("n_rows"), F.count_if(F.col("_kept") == 1).alias("n_kept"))
    partial = F.col("n_kept") < F.col("n_rows")
    return out.withColumn("partial", partial).withColumn("reason", F.when(partial, "budget"))


def arm_difference(intervals: DataFrame) -> DataFrame:
    """Pairs of arms (arm, accuracy, ci_low, ci_high): difference and strict overlap. One row for each arm goes in."""
    a, b = intervals.alias("a"), intervals.alias("b")
    return a.join(b, F.col("a.arm") < F.col("b.arm")).select(
        F.col("a.arm").alias("arm_a"), F.col("b.arm").alias("arm_b"), (F.col("a.accuracy") - F.col("b.accuracy")).alias("difference"),
        ((F.col("a.ci_low") < F.col("b.ci_high")) & (F.col("b.ci_low") < F.col("a.ci_high"))).alias("overlap"),
    )


def two_arm_gap(intervals: DataFrame) -> DataFrame:
    """``arm_difference`` where there are exactly two arms, with what their intervals say of it; no row otherwise.

    Intervals that don't overlap suffice for a significant difference; that they overlap says nothing.
    """
    arms = intervals.agg(F.countDistinct("arm")).scalar()
    return arm_difference(intervals).filter(arms == 2).withColumn("reading", F.when(F.col("overlap"), "inconclusive").otherwise("significant"))


def paired(rows: DataFrame, one: str, two: str) -> DataFrame:
    """Questions right in any run of one arm and none of the other, both ways, and the exact two-sided p."""
    from corroborate.operators.forgery import binomial_tail

    wide = rows.groupBy("q_id").pivot("arm", [one, two]).agg(F.max(F.col("correct").cast("int")))
    counts = wide.agg(F.count_if((F.col(one) == 1) & (F.col(two) == 0)).alias("n10"), F.count_if((F.col(one) == 0) & (F.col(two) == 1)).alias("n01"))
    total, most = F.col("n10") + F.col("n01"), F.greatest("n10", "n01")
    return counts.withColumn("p_value", F.when(total == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * binomial_tail(total, most, F.lit(0.5)))))


def status_distribution(rows: DataFrame) -> DataFrame:
    known = rows.filter(F.col("claim_status").isNotNull()).groupBy("claim_status").agg(F.count(F.lit(1)).alias("n"))
    total = known.agg(F.sum("n").alias("total"))
    order = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("claim_status"))
    return known.join(F.broadcast(total)).select("claim_status", "n", (F.col("n") / F.col("total")).alias("share"), order.cast("long").alias("place"))


def family_heatmap(rows: DataFrame, arms: list[str]) -> DataFrame:
    return rows.groupBy("family").pivot("arm", arms).agg(F.avg(F.col("correct").cast("double")))


# The order in which reports list families.
FAMILY_ORDER = ("AppCompat", "Explorer", "BAM", "Sysmon", "SysMain")


def family_place(family: Column, order: tuple[str, ...] = FAMILY_ORDER) -> Column:
    """The sort key of a report's families, to be followed by the name: listed ones in their order from 1, all others after them."""
    place = F.array_position(F.array(*map(F.lit, order)), family)
    return F.when(place > 0, place).otherwise(len(order) + 1).cast("long")


def question_table(rows: DataFrame, arms: list[str], order: str, status_arm: str) -> DataFrame:
    """One row for each question, by one aggregation: first_seen (the least of ``order``), family, right and all answers of each arm, and
    the counts of the status_arm's statuses by name, like ``CORROBORATED:2,DRAFT:1`` (empty if it has none)."""
    of = lambda arm: F.col("arm") == arm
    cells = [c for arm in arms for c in (F.count_if(of(arm) & F.col("correct")).alias(f"{arm}_correct"), F.count_if(of(arm)).alias(f"{arm}_runs"))]
    counts = {s: F.count_if(of(status_arm) & (F.col("claim_status") == s)) for s in sorted(STATUSES)}
    statuses = F.concat_ws(",", *[F.when(n > 0, F.concat(F.lit(f"{s}:"), n.cast("string"))) for s, n in counts.items()])
    return rows.groupBy("q_id").agg(F.min(order).alias("first_seen"), F.min("family").alias("family"), *cells, statuses.alias("statuses"))


def question_grid(rows: DataFrame) -> DataFrame:
    return rows.groupBy("q_id", "arm").agg(F.sum(F.col("correct").cast("long")).alias("n_correct"), F.count(F.lit(1)).alias("n_runs"), F.count_if(F.col("claim_status") == "CORROBORATED").alias("n_corroborated"))


def pareto(points: DataFrame, low: str, high: str) -> DataFrame:
    """Points that no other point beats: none as low with more, none lower with as much. Points without both values are left out.

    Grouped by ``low`` first (best ``high`` of each); ranges of ``low`` are sorted each for itself, with the best of the ranges before.
    """
    best = points.filter(F.col(low).isNotNull() & F.col(high).isNotNull()).groupBy(low).agg(F.max(high).alias("_best"))
    cut = before_range(with_range(best, low).withColumn("_all", F.lit(0)), ["_all"], F.col("_best"), F.max, "_earlier")
    before = Window.partitionBy("_range").orderBy(low).rowsBetween(Window.unboundedPreceding, -1)
    edge = cut.withColumn("_before", F.greatest("_earlier", F.max("_best").over(before))).filter(F.col("_before").isNull() | (F.col("_best") > F.col("_before")))
    return points.join(edge.select(low, "_best"), low).filter(F.col(high) == F.col("_best")).drop("_best")


def run_stability(rows: DataFrame) -> DataFrame:
    return rows.groupBy("arm", "q_id").agg(F.avg(F.col("correct").cast("double")).alias("share")).withColumn("mixed", (F.col("share") > 0) & (F.col("share") < 1))


def selective_score(rows: DataFrame) -> DataFrame:
    """DRAFT scores 0, a right CORROBORATED or FINAL row +1, a wrong one -2; mean by arm."""
    firm = F.col("claim_status").isin("CORROBORATED", "FINAL")
    return rows.groupBy("arm").agg(F.sum(F.when(firm & F.col("correct"), 1).when(firm, -2).otherwise(0)).alias("score"), F.avg(F.when(firm & F.col("correct"), 1.0).when(firm, -2.0).otherwise(0.0)).alias("mean_score"))


def risk_coverage(rows: DataFrame) -> DataFrame:
    """Points by arm, firmest status first: coverage, risk among the covered, and wrong rows as a share of all."""
    place = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("claim_status"))
    tiers = rows.filter(F.col("claim_status").isin(*STATUSES)).groupBy("arm", "claim_status").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("correct")).alias("wrong"))
    everything, firmer = Window.partitionBy("arm"), Window.partitionBy("arm").orderBy(place.desc())
    sums = tiers.select("arm", "claim_status", place.alias("place"), F.sum("n").over(firmer).alias("covered"), F.sum("wrong").over(firmer).alias("missed"), F.sum("n").over(everything).alias("total"))
    return sums.select("arm", "claim_status", "place", (F.col("covered") / F.col("total")).alias("coverage"), (F.col("missed") / F.col("covered")).alias("risk"), (F.col("missed") / F.col("total")).alias("joint_risk"))


def risk_coverage_area(points: DataFrame) -> DataFrame:
    """By arm, trapezoids under risk and under joint risk between the points; a single point has no area."""
    before = Window.partitionBy("arm").orderBy(F.desc("place"))
    step = F.col("coverage") - F.lag("coverage").over(before)
    area = lambda c: F.coalesce(step * (F.col(c) + F.lag(c).over(before)) / 2, F.lit(0.0))
    return points.select("arm", area("risk").alias("a"), area("joint_risk").alias("b")).groupBy("arm").agg(F.sum("a").alias("aurc"), F.sum("b").alias("augrc"), F.count(F.lit(1)).alias("n_points"))


def run_comparison(rows: DataFrame) -> DataFrame:
    """Accuracy of each run and arm, and its change from the arm's run before."""
    per_run = rows.groupBy("arm", "run_idx").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"))
    return per_run.withColumn("change", F.col("accuracy") - F.lag("accuracy").over(Window.partitionBy("arm").orderBy("run_idx")))


#: Values of a group that one task may hold, and the bounds that cut a larger group in each round.
KEPT_VALUES, CUTS = 10_000, 200


def exact_median(df: DataFrame, value: str, *by: str, kept: int = KEPT_VALUES, cuts: int = CUTS) -> DataFrame:
    """(by, median) of the values that aren't null, as F.median gives it, without a task that holds a group's values.

    Groups of at most ``kept`` values are left to F.median. In larger ones the two middle places are sought: approximate quantiles cut the values
    into ranges, values equal to a bound are ranges of their own, ranges are counted (partial sums), and only the one that holds the place is
    kept; ranges of one value are answers. The rest falls by about ``cuts`` a round, so there are few rounds, and each moves counts only.
    """
    rows = df.select(*[F.col(b).alias(f"g{k}") for k, b in enumerate(by)], F.col(value).cast("double").alias("v")).filter("v is not null")
    keys = [f"g{k}" for k in range(len(by))]
    grouped = F.struct(*keys) if keys else F.struct(F.lit(0).alias("g"))
    rows = rows.select(grouped.alias("g"), "v")
    counts = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    small = rows.join(counts.filter(F.col("n") <= kept).select("g"), "g", "left_semi").groupBy("g").agg(F.median("v").alias("median"))
    # a place of a large group: the k-th value (from 0) among those in (low, high), bounds shut out
    places = F.explode(F.array_distinct(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2"))))
    wide = lambda c: F.lit(c).cast("double")
    sought = counts.filter(F.col("n") > kept).select("g", places.alias("place")).select("g", "place", F.col("place").alias("k"), wide(None).alias("low"), wide(None).alias("high"))
    found = None
    at = F.array(*[F.lit(i / cuts) for i in range(1, cuts)])
    sought = checkpointed(sought)
    while not sought.isEmpty():
        inside = (F.col("low").isNull() | (F.col("v") > F.col("low"))) & (F.col("high").isNull() | (F.col("v") < F.col("high")))
        held = rows.join(sought, "g").filter(inside)
        bounds = held.groupBy("g", "place").agg(F.array_sort(F.array_distinct(F.percentile_approx("v", at, F.lit(10 * cuts)))).alias("b"))
        below = F.size(F.filter("b", lambda x: x < F.col("v")))
        cell = below * 2 + F.array_contains("b", F.col("v")).cast("int")
        sizes = held.join(bounds, ["g", "place"]).withColumn("cell", cell).groupBy("g", "place", "k", "low", "high", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("g", "place").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hit = checkpointed(sizes.withColumn("before", before).filter("before <= k and k < before + n").join(bounds, ["g", "place"]))
        done = hit.filter("least = most or (isnan(least) and isnan(most))").select("g", "place", F.col("least").alias("v"))
        found = done if found is None else found.unionByName(done)
        # an odd cell is one value; an even one lies between two bounds
        left, right = F.expr("coalesce(get(b, cell div 2 - 1), low)"), F.expr("coalesce(get(b, cell div 2), high)")
        sought = hit.filter("least < most").select("g", "place", F.expr("k - before").alias("k"), left.alias("low"), right.alias("high"))
    large = found.groupBy("g").agg(F.avg("v").alias("median")) if found is not None else small.filter("false")
    return small.unionByName(large).select(*[F.col(f"g.{k}").alias(b) for k, b in zip(keys, by)], "median")


def ms_per_mb(runs: DataFrame, ms: str, mb: str, *by: str) -> DataFrame:
    """The median time of each group by its largest size."""
    size = runs.groupBy(*by).agg(F.max(mb).alias("_mb"))
    same = [F.col(f"a.{b}").eqNullSafe(F.col(f"b.{b}")) for b in by]
    both = size.alias("a").join(exact_median(runs, ms, *by).alias("b"), same, "left")
    return both.select(*[F.col(f"a.{b}") for b in by], (F.col("b.median") / F.col("a._mb")).alias("ms_per_mb"))
