"""Claims judged clause by clause: where a run starts to be refused, what was bet before and what could not be tested.

Null keys make groups like any other; nulls, NaN and infinities are no values
unless a docstring says otherwise. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut
from .quantiles import finite

#: Tasks that the runs of one scope are dealt to where the bars are too many to broadcast
SPREAD = 32


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def failing_pair(residuals: Column, limit: float) -> Column:
    """The first place (from 0) of an array above ``limit``, else the first that is null or NaN; null if all are within it.

    An infinite residual is above every limit. An empty array fails nowhere, a
    null array is null.
    """
    def first(found: Column) -> Column:
        place = lambda test: F.nullif(F.array_position(F.transform(found, test), True), F.lit(0))
        over = place(lambda r: F.coalesce((r > limit) & ~F.isnan(r), F.lit(False)))
        return (F.coalesce(over, place(lambda r: r.isNull() | F.isnan(r))) - 1).cast("int")

    return _named(residuals, first)


def crossing(residuals: Callable[[Column], Column], limit: float, step: float = 0.005, top: float = 0.5, resolution: float = 0.0005) -> Column:
    """struct(s, pair, non_monotone): the level from which a run is refused, by a scan of even steps and halvings of its first refusing step.

    residuals: a level (Column) to the run's residuals (array). A run refused
    at 0 crosses at 0. s is the middle of the last bracket and pair what fails
    at its upper end; both are null for a run that no step refuses.
    non_monotone says that a later step places the run again. All within the
    row, so nothing is shuffled; the work is top / step evaluations.
    """
    count, halvings = round(top / step), max(0, math.ceil(round(math.log2(step / resolution), 9)))
    # NaN is greater than any number here, so it refuses like a missing value
    refused_at = lambda s: F.exists(residuals(s), lambda r: r.isNull() | (r > limit))
    shape = "struct<s:double,pair:int,non_monotone:boolean>"
    result = lambda s, pair, again: F.struct(s.alias("s"), pair.alias("pair"), again.alias("non_monotone")).cast(shape)
    never = result(F.lit(None), F.lit(None), F.lit(False))

    def halve(bracket: Column, _: Column) -> Column:
        middle = (bracket["lo"] + bracket["hi"]) / 2
        return F.when(refused_at(middle), F.struct(bracket["lo"].alias("lo"), middle.alias("hi"))).otherwise(F.struct(middle.alias("lo"), bracket["hi"].alias("hi")))

    def narrowed(first: Column, again: Column) -> Column:
        bracket = F.struct(((first - 1) * F.lit(step)).alias("lo"), (first * F.lit(step)).alias("hi"))
        if halvings:
            bracket = F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), bracket, halve)
        return _named(bracket, lambda b: result((b["lo"] + b["hi"]) / 2, failing_pair(residuals(b["hi"]), limit), again))

    def scanned(scan: Column) -> Column:
        place = F.array_position(scan, True).cast("int")
        return _named(place, lambda first: F.when(first > 0, narrowed(first, F.array_contains(F.slice(scan, first + 1, count), False))).otherwise(never))

    scan = F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: refused_at(i * F.lit(step)))
    at_zero = failing_pair(residuals(F.lit(0.0)), limit)
    return F.when(at_zero.isNotNull(), result(F.lit(0.0), at_zero, F.lit(False))).when(residuals(F.lit(0.0)).isNotNull(), _named(scan, scanned))


def scanned_crossing(rows: DataFrame, by: Sequence[str], level: str, pair: str, residual: str, limit: float) -> DataFrame:
    """``by``, lower, upper, s, pair, non_monotone: the crossing of runs whose residuals were measured, a row a (level, pair).

    upper is the least level with a residual above ``limit`` or without a value
    (null or NaN), lower the greatest below it; s is their middle, upper itself
    without a lower, null if no level is refused. pair is the least that is
    above the limit at upper, else the least without a value. Rows whose level
    isn't finite are left out; a pair with several residuals at a level is above
    the limit if one of them is. The levels of a run, not its rows, meet in one
    window, whose partitioning the last aggregate reuses.
    """
    missing = F.col(residual).isNull() | F.isnan(residual)
    kept = rows.where(finite(F.col(level))).select(*by, F.col(level).cast("double").alias("_level"), F.col(pair).alias("_pair"), missing.alias("_no"), (~missing & (F.col(residual) > limit)).alias("_over"))
    levels = kept.groupBy(*by, "_level").agg(F.min(F.when(F.col("_over"), F.col("_pair"))).alias("_first"), F.min(F.when(F.col("_no"), F.col("_pair"))).alias("_unknown"), F.max(F.col("_over") | F.col("_no")).alias("_refused"))
    over_run = Window.partitionBy(*by)
    levels = levels.withColumn("_upper", F.min(F.when(F.col("_refused"), F.col("_level"))).over(over_run))
    below, above = F.col("_level") < F.col("_upper"), F.col("_level") > F.col("_upper")
    runs = levels.groupBy(*by).agg(
        F.max(F.when(below, F.col("_level"))).alias("lower"), F.first("_upper").alias("upper"),
        F.max(F.when(F.col("_level") == F.col("_upper"), F.coalesce("_first", "_unknown"))).alias("pair"), F.coalesce(F.max(above & ~F.col("_refused")), F.lit(False)).alias("non_monotone"),
    )
    return runs.select(*by, "lower", "upper", F.coalesce((F.col("lower") + F.col("upper")) / 2, "upper").alias("s"), "pair", "non_monotone")


def clause_runs(checks: DataFrame, clause: str, run: str, untestable: str, failure: str) -> DataFrame:
    """``clause``, ``run``, checks, untestable, failures, first_why, first_failure: a row for each run with a check.

    untestable and failure are texts, null where they don't apply. A check that
    can't test its clause counts apart, whatever its failure says. Of several
    texts the least is named.
    """
    stuck = F.col(untestable).isNotNull()
    failed = ~stuck & F.col(failure).isNotNull()
    return checks.groupBy(clause, run).agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(stuck).alias("untestable"), F.count_if(failed).alias("failures"),
        F.min(untestable).alias("first_why"), F.min(F.when(failed, F.col(failure))).alias("first_failure"),
    )


def clause_totals(runs: DataFrame, clauses: DataFrame, clause: str) -> DataFrame:
    """``clauses``' columns, checks, testable, untestable, failures, failing_runs, untestable_runs and verdict.

    runs: as ``clause_runs`` gives them. clauses: what was claimed, each once.
    verdict is ``failed``, ``held``, or ``untested`` where no check could test
    the clause: never held by default. Clauses without checks are untested;
    checks of clauses that nobody claimed count for nothing.
    """
    some = lambda c: F.count_if(F.col(c) > 0)
    sums = runs.groupBy(F.col(clause).alias("_clause")).agg(*(F.sum(c).alias(c) for c in ("checks", "untestable", "failures")), some("failures").alias("failing_runs"), some("untestable").alias("untestable_runs"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    testable = count("checks") - count("untestable")
    verdict = F.when(count("failures") > 0, "failed").when(testable > 0, "held").otherwise("untested")
    rows = clauses.join(sums, F.col(clause).eqNullSafe(F.col("_clause")), "left")
    return rows.select(*clauses.columns, count("checks").alias("checks"), testable.alias("testable"), *(count(c).alias(c) for c in ("untestable", "failures", "failing_runs", "untestable_runs")), verdict.alias("verdict"))


def judge_bets(measures: DataFrame, bets: DataFrame, bet: str, value: str, read: str, threshold: str) -> DataFrame:
    """``bets``' columns, cells (read), unmeasured (read, but no finite value), measured (sum, null if none) and falsified.

    A bet is falsified where the sum of its read cells exceeds its threshold.
    If it doesn't, and a read cell has no value or no cell was read, falsified
    is null: neither lost nor won. A cell whose ``read`` is null wasn't read.
    Bets, each once, are kept without measures; measures of other bets count
    for nothing. A threshold that isn't finite decides nothing.
    """
    seen = measures.where(F.coalesce(F.col(read), F.lit(False)))
    sums = seen.groupBy(F.col(bet).alias("_bet")).agg(F.count(F.lit(1)).alias("cells"), F.count_if(~finite(F.col(value))).alias("unmeasured"), F.sum(F.when(finite(F.col(value)), F.col(value).cast("double"))).alias("measured"))
    rows = bets.join(sums, F.col(bet).eqNullSafe(F.col("_bet")), "left")
    over = F.when(finite(F.col(threshold)), F.col("measured") > F.col(threshold))
    falsified = F.when(over, True).when((F.col("cells") > 0) & (F.col("unmeasured") == 0), over)
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.select(*bets.columns, count("cells"), count("unmeasured"), "measured", falsified.alias("falsified"))


def quarter_masses(blocks: DataFrame, by: Sequence[str], white: str, black: str, half: str, middle: str, floor: float = 0.1) -> DataFrame:
    """``by``, blocks, q1 to q4: the light (white less black) of each quarter of an axis, told by two coarse planes.

    half is lit in the upper half of the axis, middle in its two middle
    quarters; their shares of a block's light are clamped to 0 to 1. Counted
    are blocks with all four values and at least ``floor`` of the group's most
    light; a group without any light has zeros. Two passes over the blocks, each
    with a partial aggregate; the second joins one number a group. ``by`` has at
    least one column.
    """
    values = [F.col(c).cast("double") for c in (white, black, half, middle)]
    usable = F.lit(True)
    for v in values:
        usable = usable & finite(v)
    w, k, g, m = values
    rows = blocks.select(*by, usable.alias("_ok"), F.when(usable, w - k).alias("_a"), F.when(usable, g - k).alias("_g"), F.when(usable, m - k).alias("_m"))
    names = [f"_k{i}" for i in range(len(by))]
    peaks = rows.groupBy(*(F.col(c).alias(n) for c, n in zip(by, names, strict=True))).agg(F.max("_a").alias("_peak"))
    on = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names, strict=True)]
    light = F.when((F.col("_peak") > 0) & (F.col("_a") >= floor * F.col("_peak")), F.col("_a"))
    share = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c) / light))
    both, either = F.least(share("_g"), share("_m")), F.greatest(share("_g"), share("_m"))
    parts = [1 - either, share("_m") - both, both, share("_g") - both]
    joined = rows.join(peaks, on)
    sums = [F.coalesce(F.sum(light * p), F.lit(0.0)).alias(f"q{i + 1}") for i, p in enumerate(parts)]
    return joined.groupBy(*by).agg(F.count(light).alias("blocks"), *sums)


def coverage_rms(shots: DataFrame, by: Sequence[str], du: str, dv: str, in_front: str) -> DataFrame:
    """``by``, points, front, rms: root mean square error of the points in front, divided by their share of all points.

    The share is taken as 1e-6 at least; without a point in front rms is
    infinite. A point in front whose errors aren't finite counts as not in
    front, a null ``in_front`` as false. One partial aggregate.
    """
    u, v = F.col(du).cast("double"), F.col(dv).cast("double")
    seen = F.coalesce(F.col(in_front), F.lit(False)) & finite(u) & finite(v)
    rows = shots.groupBy(*by).agg(F.count(F.lit(1)).alias("points"), F.count_if(seen).alias("front"), F.avg(F.when(seen, u * u + v * v)).alias("_m"))
    rms = F.when(F.col("front") > 0, F.sqrt("_m") / F.greatest(F.col("front") / F.col("points"), F.lit(1e-6))).otherwise(float("inf"))
    return rows.select(*by, "points", "front", rms.alias("rms"))


def arm_shares(runs: DataFrame, scope: str, arm: str, value: str, control: str) -> DataFrame:
    """``scope``, ``arm``, n, usable, share and bar: runs no worse than the worst run of the scope's own control arm.

    Each scope sets its bar itself, as values of different scopes aren't
    comparable. A run without a finite value counts in n and is never usable;
    bar and share are null in a scope whose control has no finite value. One
    partial aggregate for the bars and one for the counts. Bars, a row a scope,
    are written once, so that Spark knows their size: few are broadcast, and no
    run is shuffled. Of many, each is there ``SPREAD`` times, so that the runs of
    a scope meet it in as many tasks.
    """
    x = F.when(finite(F.col(value)), F.col(value).cast("double"))
    rows = runs.select(F.col(scope).alias("_s"), F.col(arm).alias("_arm"), x.alias("_x"))
    bars = cut(rows.where(F.col("_arm") == control).groupBy(F.col("_s").alias("_b")).agg(F.max("_x").alias("bar")))
    bars = bars.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    at = F.pmod(F.xxhash64("_arm", "_x"), F.lit(SPREAD)).cast("int")
    found = rows.withColumn("_part", at).join(bars, F.col("_s").eqNullSafe(F.col("_b")) & (F.col("_part") == F.col("_at")), "left").groupBy("_s", "_arm").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_x") <= F.col("bar")).alias("usable"), F.first("bar").alias("bar"))
    return found.select(F.col("_s").alias(scope), F.col("_arm").alias(arm), "n", "usable", F.when(F.col("bar").isNotNull(), F.col("usable") / F.col("n")).alias("share"), "bar")


def arm_recovery(runs: DataFrame, scope: str, seed: str, arm: str, value: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``scope``, before, after, n, ratio, improved, consistent of each pair of arms, over the seeds that both have.

    ratio is the geometric mean of before over after, free of units; improved
    counts the seeds where after is below before, and consistent says that
    they are more than half. Values that aren't finite and above 0 are none; of
    several values of an arm and seed the least counts. A scope without such a
    seed has no row for that pair. One aggregate by (scope, seed), which puts
    the arms side by side, and one by scope and pair: no self-join.
    """
    x = F.when(finite(F.col(value)) & (F.col(value) > 0), F.col(value).cast("double"))
    arms = sorted({a for pair in pairs for a in pair})
    rows = runs.where(F.col(arm).isin(*arms)).groupBy(F.col(scope).alias("_s"), F.col(seed).alias("_seed")).agg(*(F.min(F.when(F.col(arm) == a, x)).alias(f"_x{i}") for i, a in enumerate(arms)))
    each = F.array(*(F.struct(F.lit(a).alias("before"), F.lit(b).alias("after"), F.col(f"_x{arms.index(a)}").alias("_a"), F.col(f"_x{arms.index(b)}").alias("_b")) for a, b in pairs))
    both = rows.select("_s", F.inline(each)).where("_a IS NOT NULL AND _b IS NOT NULL")
    found = both.groupBy("_s", "before", "after").agg(F.count(F.lit(1)).alias("n"), F.exp(F.avg(F.ln(F.col("_a") / F.col("_b")))).alias("ratio"), F.count_if(F.col("_b") < F.col("_a")).alias("improved"))
    return found.select(F.col("_s").alias(scope), "before", "after", "n", "ratio", "improved", (2 * F.col("improved") > F.col("n")).alias("consistent"))
