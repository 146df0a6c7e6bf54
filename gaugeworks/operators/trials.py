"""Designs of experiments, and verdicts on their runs, positions and captures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut
from .pairing import paired_arms, sign_test
from .quantiles import finite, linear_quantiles
from .statistics import global_rank

# Least excess (as a share of the control) that can be recovered; the limit of a residual and the band below
# it that is marginal; the matches a run should have; when a change of density counts as none
LEAST_EXCESS, RESIDUAL_LIMIT, MARGINAL_FROM, FEW_MATCHES, SMALL_CHANGE = 0.1, 0.15, 0.1, 200, 0.05


def design_columns(index: Column, factors: dict[str, Sequence], replicates: int) -> dict[str, Column]:
    """point, one column a factor and replicate of row ``index`` (from 0) of a design, the last factor fastest; all null beyond it."""
    total = replicates
    for levels in factors.values():
        total *= len(levels)
    inside = F.when((index >= 0) & (index < total), index)
    point = F.floor(inside / replicates)
    stride, columns = total // replicates if total else 0, {"point": point}
    for name, levels in factors.items():
        stride = stride // len(levels) if levels else 1
        columns[name] = F.get(F.array(*map(F.lit, levels)), (F.floor(point / max(stride, 1)) % max(len(levels), 1)).cast("int"))
    return columns | {"replicate": (inside % replicates).cast("int")}


def factor_design(spark: SparkSession, factors: dict[str, Sequence], replicates: int) -> DataFrame:
    """point, one column a factor, replicate: every combination of the levels, the last factor fastest.

    Rows are numbers read in mixed radix, so a design of any size is made in
    parallel without a join. A factor without levels gives an empty design.
    """
    total = replicates
    for levels in factors.values():
        total *= len(levels)
    return spark.range(total).select(*(c.alias(name) for name, c in design_columns(F.col("id"), factors, replicates).items()))


def deal_design(units: DataFrame, number: str, factors: dict[str, Sequence], replicates: int) -> DataFrame:
    """The units with ``block``, point, one column a factor and replicate: each block of the design's size gets the whole design once.

    number: the unit's number, from 0. Without one, or below 0, all are null;
    units that share a number share a point. No shuffle. Columns of those
    names are replaced. A factor without levels gives nulls.
    """
    total = replicates
    for levels in factors.values():
        total *= len(levels)
    at = F.when(F.col(number) >= 0, F.col(number).cast("long"))
    place = at % total if total else F.lit(None).cast("long")
    block = F.floor(at / total) if total else F.lit(None).cast("long")
    return units.withColumns({"block": block} | design_columns(place, factors, replicates))


def recovered(facet: Column, smooth: Column, control: Column) -> Column:
    """The percentage of the excess of ``facet`` over ``control`` that ``smooth`` removes; null where the excess is too small to divide by."""
    excess = facet - control
    return F.when(finite(excess) & (excess > F.abs(control) * LEAST_EXCESS), (facet - smooth) / F.when(excess != 0, excess) * 100)


def mechanism_rows(runs: DataFrame, key: Sequence[str], arm: str, values: Sequence[str], facet: str, smooth: str, control: str) -> DataFrame:
    """A row for each value: pairs, the three medians, recovered percentage, wins of smooth, and p of a sign test.

    All figures are over the keys for which all three arms have a finite value;
    ties don't enter the test. Without pairs medians are null and p is 1.
    """
    triples = None
    for value in values:
        wide = paired_arms(runs, key, arm, value, [facet, smooth, control])
        part = wide.select(F.lit(value).alias("value"), F.col(f"`{facet}`").alias("facet"), F.col(f"`{smooth}`").alias("smooth"), F.col(f"`{control}`").alias("control"))
        triples = part if triples is None else triples.union(part)
    triples = cut(triples)
    sums = triples.groupBy("value").agg(F.count("*").alias("pairs"), F.count_if(F.col("smooth") < F.col("facet")).alias("wins"), F.count_if(F.col("smooth") != F.col("facet")).alias("decided"))
    sides = triples.select("value", F.inline(F.array(*(F.struct(F.lit(n).alias("side"), F.col(n).alias("_v")) for n in ("facet", "smooth", "control")))))
    medians = linear_quantiles(sides, ["value", "side"], "_v", {"_m": 0.5})
    wide = medians.groupBy("value").agg(*(F.max(F.when(F.col("side") == n, F.col("_m"))).alias(f"{n}_median") for n in ("facet", "smooth", "control")))
    every = runs.sparkSession.range(len(values)).select(F.get(F.array(*map(F.lit, values)), F.col("id").cast("int")).alias("value"))
    found = every.join(sums, "value", "left").join(wide, "value", "left").fillna(0, ["pairs", "wins", "decided"])
    return found.select("value", "pairs", "facet_median", "smooth_median", "control_median", recovered(F.col("facet_median"), F.col("smooth_median"), F.col("control_median")).alias("recovered"), "wins", sign_test(F.col("wins"), F.col("decided")).alias("p"))


def yardstick(df: DataFrame, by: str, value: str, share: float = 0.1) -> DataFrame:
    """``by``, n, low, high, and ``largest``: how many of the group's values are among the ceil(share N) greatest of all.

    Values that aren't finite don't count; of equal values those of the lesser
    group come first.
    """
    x = F.col(value).cast("double")
    turned = df.where(finite(x)).select(by, x.alias("_v"), (-x).alias("_down"))
    ranked = global_rank(turned, "_down", [by], "_at", "_all")
    top = F.col("_at") < F.ceil(F.col("_all") * F.lit(share))
    return ranked.groupBy(by).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.count_if(top).alias("largest"))


def marginal(placed: Column, residual: Column) -> Column:
    """A run that was placed with a residual just below the limit; false without a residual."""
    return F.coalesce(placed & (residual > MARGINAL_FROM), F.lit(False))


def minor(matches: Column) -> Column:
    """A run with fewer matches than are worth solving from; null if never decoded."""
    return matches < FEW_MATCHES


def failing_pair(residuals: Column) -> Column:
    """The index of the first residual over the limit, else of the first that is null; -1 if the run is placed."""
    at = F.sequence(F.lit(0), F.size(residuals) - 1)
    first = lambda rule: F.array_min(F.filter(at, lambda i: rule(F.get(residuals, i))))
    found = F.coalesce(first(lambda r: r > RESIDUAL_LIMIT), first(lambda r: r.isNull()), F.lit(-1))
    return F.when(F.size(residuals) > 0, found).otherwise(-1)


def in_band(residual: Column, floor: Column, margin: float) -> Column:
    """Whether a noiseless residual lies within ``margin`` of the limit, or of the limit less the noise floor; true if unanswered."""
    noise = F.greatest(F.lit(0.0), F.coalesce(floor, F.lit(0.0)))
    return F.coalesce((residual >= RESIDUAL_LIMIT - noise - margin) & (residual <= RESIDUAL_LIMIT + margin), F.lit(True))


def convergence(fine: Column, coarse: Column, tolerance: float) -> tuple[Column, Column, Column]:
    """(absolute, relative, converged) change from a coarse to a fine density; relative is NaN where the fine value is 0."""
    absolute = F.abs(fine - coarse)
    relative = F.when(fine == 0, float("nan")).otherwise(absolute / F.when(fine != 0, F.abs(fine)))
    return absolute, relative, (absolute <= tolerance) | (~F.isnan(relative) & (relative <= SMALL_CHANGE))


def largest_contributor(df: DataFrame, by: Sequence[str], name: str, value: str, base: Column | float) -> DataFrame:
    """``by``, contributor and drop: the substitution that lowers the value most below ``base``; null and 0 where none lowers it.

    ``none`` and ``all`` are bookends, not substitutions. Of equal drops the
    first name counts; a null value lowers nothing.
    """
    drop = F.lit(base) - F.col(value).cast("double") if not isinstance(base, Column) else base - F.col(value).cast("double")
    counts = ~F.coalesce(F.col(name).isin("none", "all"), F.lit(True)) & finite(drop) & (drop > 0)
    firsts = df.groupBy(*by, F.when(counts, drop).alias("_d")).agg(F.min(F.when(counts, F.col(name))).alias("_n"))
    return firsts.groupBy(*by).agg(F.max_by("_n", "_d").alias("contributor"), F.coalesce(F.max("_d"), F.lit(0.0)).alias("drop"))


def classify_positions(runs: DataFrame, by: Sequence[str], touched: Column, attributable: Column, placed: Column, flagged: Column, left_out: Column | None = None) -> DataFrame:
    """``by`` and category of each position from its runs; null verdicts are false.

    No run touched: UNCHANGED if a run was flagged, else UNTOUCHED. Else, of
    the runs that are touched, attributable and not left out: none,
    INVISIBLE-ONLY; all placed, PLACED; none placed, REFUSED-ALL; else MIXED.
    """
    sure = lambda c: F.coalesce(c, F.lit(False))
    counted = sure(touched) & sure(attributable) & ~sure(F.lit(False) if left_out is None else left_out)
    g = runs.groupBy(*by).agg(F.bool_or(sure(touched)).alias("_t"), F.bool_or(sure(flagged)).alias("_f"), F.count_if(counted).alias("_n"), F.count_if(counted & ~sure(placed)).alias("_r"))
    n, refused = F.col("_n"), F.col("_r")
    kind = F.when(~F.col("_t"), F.when(F.col("_f"), "UNCHANGED").otherwise("UNTOUCHED")).when(n == 0, "INVISIBLE-ONLY").when(refused == 0, "PLACED").when(refused == n, "REFUSED-ALL").otherwise("MIXED")
    return g.select(*by, kind.alias("category"))


def harm(twin: Column, treated: Column, twin_censored: Column, treated_censored: Column, moved: Column, noise: Column, gate: float) -> Column:
    """GATE-BREAKING where only the treated side is over the gate and neither is censored; BIASED where it moved by more than noise; else HARMLESS."""
    return F.when(~twin_censored & ~treated_censored & (twin <= gate) & (treated > gate), "GATE-BREAKING").when(moved > noise, "BIASED").otherwise("HARMLESS")


def classify_captures(positions: DataFrame, by: Sequence[str], harms: DataFrame, policy: str) -> DataFrame:
    """``by``, class, loud_and_silent and harm of each capture from the categories of its positions.

    harms: ``by`` and harm, for the captures that were solved. A refused or
    mixed position is LOUD; else a placed one is SILENT, by its harm. policy P
    re-shoots a refused position whole; under A the placed runs of a mixed one
    reach the result too. harm is given where something reached it.
    """
    if policy not in ("P", "A"):
        raise ValueError(f"unknown policy {policy}")
    kinds = ("REFUSED-ALL", "MIXED", "PLACED", "INVISIBLE-ONLY", "UNCHANGED")
    g = positions.groupBy(*by).agg(*(F.bool_or(F.coalesce(F.col("category") == k, F.lit(False))).alias(f"_{i}") for i, k in enumerate(kinds)))
    mine = harms.select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(by)), F.col("harm").alias("_harm"))
    j = g.join(mine, [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)], "left")
    loud, silent = F.col("_0") | F.col("_1"), F.col("_2") | (F.col("_1") if policy == "A" else F.lit(False))
    judged = F.when(silent, F.col("_harm"))
    kind = F.when(loud, "LOUD").when(F.col("_2"), F.concat(F.lit("SILENT-"), F.coalesce(judged, F.lit("UNSOLVED")))).when(F.col("_3"), "INVISIBLE-ONLY").when(F.col("_4"), "UNCHANGED").otherwise("UNTOUCHED")
    return j.select(*by, kind.alias("class"), (loud & silent).alias("loud_and_silent"), judged.alias("harm"))
