"""Robust and order statistics by group.

Nulls, NaN and infinities are removed first; n counts what is left. Null keys
make a group like any other, and an empty table gives no rows unless a docstring
says otherwise. Quantiles come from ``quantiles``, so no group is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut
from .names import prefix
from .quantiles import finite, linear_quantiles, nearest_rank, order_statistics

__all__ = ["finite", "nearest_rank"]


def dispersion(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, median, p05, p95, min, max, population sd and interquartile range (linear quantiles).

    A group without finite values has n 0 and nulls.
    """
    x = F.col("_x")
    also = [F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), F.stddev_pop(x).alias("sd")]
    out = linear_quantiles(df, by, value, {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}, also)
    return out.withColumn("iqr", F.col("p75") - F.col("p25")).drop("p25", "p75")


def sample_dispersion(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, the count of removed rows n_non_finite, mean, sample sd (null below two values), quartiles q1, q2, q3."""
    x = F.col("_x")
    also = [(F.count("*") - F.count(x)).alias("n_non_finite"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd")]
    return linear_quantiles(df, by, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75}, also)


def summarise(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, root mean square, linear p50 and p95, min, max."""
    x = F.col("_x")
    also = [F.avg(x).alias("mean"), F.sqrt(F.avg(x * x)).alias("rms"), F.min(x).alias("min"), F.max(x).alias("max")]
    return linear_quantiles(df, by, value, {"p50": 0.5, "p95": 0.95}, also)


def median(df: DataFrame, by: Sequence[str], value: str, alias: str = "median", also: Sequence[Column] = ()) -> DataFrame:
    """n, ``also`` and the median; null for a group without finite values."""
    return linear_quantiles(df, by, value, {"_median": 0.5}, also).withColumnRenamed("_median", alias)


def robust_scale(df: DataFrame, by: Sequence[str], value: str, least: int = 1, floor: float = 0.0) -> DataFrame:
    """n and ``scale``: the median over that of a unit Rayleigh distribution, at least ``floor``; null below ``least`` values."""
    m = median(df, by, value, "_m")
    return m.select(*by, "n", F.when(F.col("n") >= least, F.greatest(F.lit(floor), F.col("_m") / RAYLEIGH_MEDIAN)).alias("scale"))


#: Fixed value: the median length of a 2-vector with unit normal parts, rounded as published
RAYLEIGH_MEDIAN = 1.1774


def reject_outliers(df: DataFrame, by: Sequence[str], value: str, k: float = 3.0, floor: float = 0.0, most_share: float = 0.2) -> DataFrame:
    """One rejection pass over lengths: keep those at most the threshold. Returns ``by``, threshold, kept, rejected.

    The threshold is max(floor, k * scale), scale the median of the group over
    ``RAYLEIGH_MEDIAN``. Where that would reject more than ``most_share`` of
    the group, it is the order statistic that keeps floor(n (1 - most_share))
    values, at least one. NaN and infinities count, rank above all others and
    are always rejected; nulls are no values. Two scans find the thresholds, a
    third counts.
    """
    lengths = df.select(*by, F.col(value).cast("double").alias("_length"))
    n = F.col("_total")
    wanted = {
        "_mid": (n - 1) / 2,
        # More than a share is over the threshold if this one is.
        "_edge": (n - F.floor(n * F.lit(most_share)) - 1).cast("double"),
        "_cap": (F.greatest(F.lit(1), F.floor(n * F.lit(1 - most_share))) - 1).cast("double"),
    }
    found = order_statistics(lengths, by, "_length", wanted, [F.count("_raw").alias("_total")])
    first = F.greatest(F.lit(floor), F.lit(k) * (F.col("_mid_lo") + F.col("_mid_hi")) / 2 / RAYLEIGH_MEDIAN)
    over = F.coalesce(F.col("_edge_lo") > first, F.lit(True)) & F.lit(most_share < 1)
    chosen = found.where("_total > 0").select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(by)), F.when(over, F.col("_cap_lo")).otherwise(first).alias("threshold"))
    on = [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)]
    judged = lengths.where("_length IS NOT NULL")
    judged = judged.join(chosen, on) if by else judged.crossJoin(chosen)  # without keys one row
    keep = F.coalesce((F.col("_length") <= F.col("threshold")) & ~F.isnan("_length"), F.lit(False))
    return judged.groupBy(*by, "threshold").agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("rejected"))


def global_rank(df: DataFrame, value: str, ties: Sequence[str], rank: str = "_rank", n: str = "_n", parts: int | None = None) -> DataFrame:
    """The rows with a finite value, with their ``rank`` (from 0) by value, then ``ties``, and their number ``n``.

    Rows are dealt to ``parts`` ranges of (value, ties), without it as many as the session shuffles to, so even one value that
    all rows have is spread by its ties; ranks count within a range, after
    those of the ranges before. Rows equal in value and ties have ranks in any
    order. Nulls, NaN and infinities are left out: they have no rank.
    """
    p = prefix(df)
    x = F.col(value).cast("double")
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cut(df.where(finite(x)).repartitionByRange(parts, value, *ties).withColumn(f"{p}part", F.spark_partition_id()))
    sizes = spread.groupBy(f"{p}part").agg(F.count("*").alias(f"{p}c"))
    upto = Window.orderBy(f"{p}part").rowsBetween(Window.unboundedPreceding, -1)  # ``parts`` rows
    offsets = sizes.select(F.col(f"{p}part").alias(f"{p}key"), F.coalesce(F.sum(f"{p}c").over(upto), F.lit(0)).alias(f"{p}before"), F.sum(f"{p}c").over(Window.partitionBy(F.lit(0))).alias(n))
    inside = F.row_number().over(Window.partitionBy(f"{p}part").orderBy(value, *ties)) - 1
    placed = spread.join(F.broadcast(offsets), F.col(f"{p}part") == F.col(f"{p}key"))  # at most ``parts`` rows
    return placed.withColumn(rank, F.col(f"{p}before") + inside).select(*df.columns, rank, n)


def equal_count_bins(df: DataFrame, value: str, ties: Sequence[str], bins: int, alias: str = "bin") -> DataFrame:
    """The rows with a finite value, with ``alias``: bin b holds the ranks floor(b n / bins) to floor((b + 1) n / bins) - 1."""
    p = prefix(df)
    ranked = global_rank(df, value, ties, f"{p}rank", f"{p}n")
    return ranked.withColumn(alias, (F.ceil((F.col(f"{p}rank") + 1) * bins / F.col(f"{p}n")) - 1).cast("int")).drop(f"{p}rank", f"{p}n")


def otsu(df: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """bin and threshold of the cut with the greatest between-class variance of a histogram; the first of equal cuts.

    Bins are centred on lo + bin (hi - lo) / (bins - 1), and the threshold is
    the centre of the cut's last bin. Constant values give bin 0 and that
    value; no finite value gives bin 0 and 0. Always one row.
    """
    raw = F.col(value).cast("double")
    x = df.select(raw.alias("x")).where(finite(F.col("x")))
    limits = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).select("lo", ((bins - 1) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).alias("scale"))
    counts = x.crossJoin(F.broadcast(limits)).groupBy(F.coalesce(F.floor((F.col("x") - F.col("lo")) * F.col("scale") + 0.5), F.lit(0)).alias("bin")).agg(F.count("*").alias("c"))  # limits: one row
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most ``bins`` rows
    every = Window.partitionBy(F.lit(0))
    mass = F.col("c") * F.col("bin")
    w = counts.select("bin", F.sum("c").over(upto).alias("w0"), F.sum(mass).over(upto).alias("s0"), F.sum("c").over(every).alias("n"), F.sum(mass).over(every).alias("s"))
    w = w.where("w0 < n").withColumn("m", F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("n") - F.col("w0")))
    w = w.withColumn("between", F.col("w0").cast("double") * (F.col("n") - F.col("w0")) * F.col("m") * F.col("m"))
    best = w.agg(F.coalesce(F.max_by("bin", F.struct(F.round("between", 3), -F.col("bin"))), F.lit(0)).alias("bin"))
    return best.crossJoin(F.broadcast(limits)).select(F.col("bin").cast("int").alias("bin"), (F.coalesce("lo", F.lit(0.0)) + F.coalesce(F.col("bin") / F.col("scale"), F.lit(0.0))).alias("threshold"))


def lit_fractions(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """mean, and ``lit``: the share of a group's values above the middle between the least and greatest of all values.

    Where all values are equal nothing is above it: lit is 0.
    """
    keyed = df.select(*by, F.col(value).cast("double").alias("_v")).where(finite(F.col("_v")))
    middle = keyed.agg(((F.min("_v") + F.max("_v")) / 2).alias("_middle"))
    both = keyed.crossJoin(F.broadcast(middle))  # one row
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), (F.count_if(F.col("_v") > F.col("_middle")) / F.count("*")).alias("lit"))


def pair_coherence(df: DataFrame, by: Sequence[str], cell: Column, value: str) -> DataFrame:
    """cells, n, and the population variance ``between_cells`` of the means of a group's cells."""
    kept = df.select(*by, cell.alias("_cell"), F.col(value).cast("double").alias("_v")).where(finite(F.col("_v")))
    cells = kept.groupBy(*by, "_cell").agg(F.count("*").alias("_c"), F.sum("_v").alias("_s"))
    return cells.groupBy(*by).agg(F.count("*").alias("cells"), F.sum("_c").alias("n"), F.var_pop(F.col("_s") / F.col("_c")).alias("between_cells"))


def quadrature(df: DataFrame, by: Sequence[str], part: str, whole: str) -> DataFrame:
    """The root of the summed squares of the parts of a group, the greatest whole, and ``excess``: how far the whole exceeds it (0 if it doesn't)."""
    root = F.sqrt(F.sum(F.col(part) * F.col(part)))
    g = df.groupBy(*by).agg(root.alias("quadrature"), F.max(whole).alias("whole"))
    return g.withColumn("excess", F.sqrt(F.greatest(F.lit(0.0), F.col("whole") * F.col("whole") - F.col("quadrature") * F.col("quadrature"))))


def covariance_axes(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Population covariance of two columns and its principal axes in closed form, over the rows in which both are finite; null without any."""
    m = df.where(finite(F.col(x).cast("double")) & finite(F.col(y).cast("double"))).groupBy(*by).agg(F.var_pop(x).alias("sxx"), F.var_pop(y).alias("syy"), F.covar_pop(x, y).alias("sxy"))
    half, root = (F.col("sxx") + F.col("syy")) / 2, F.sqrt(F.pow((F.col("sxx") - F.col("syy")) / 2, 2) + F.col("sxy") * F.col("sxy"))
    return m.withColumn("major", half + root).withColumn("minor", F.greatest(half - root, F.lit(0.0))).withColumn("angle", F.atan2(2 * F.col("sxy"), F.col("sxx") - F.col("syy")) / 2)


def between_bins(df: DataFrame, by: Sequence[str], bin_col: str, value: str) -> DataFrame:
    """The share of a finite value's variance that lies between bins; 0 where there is no variance."""
    bins = df.where(finite(F.col(value).cast("double"))).groupBy(*by, bin_col).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    g = bins.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    base = F.col("s") * F.col("s") / F.col("n")
    return g.select(*by, "n", F.when(F.col("ss") > base, (F.col("b") - base) / F.when(F.col("ss") > base, F.col("ss") - base)).otherwise(0.0).alias("share"))


def log_slope(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares slope of ln y on ln x over the pairs that are both positive and finite; null for fewer than two different x."""
    both = finite(F.col(x).cast("double")) & finite(F.col(y).cast("double")) & (F.col(x) > 0) & (F.col(y) > 0)
    return df.where(both).groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(F.ln(y), F.ln(x)).alias("slope"))


def normal_equations(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """The upper triangle of X'X and X'y with an intercept, as (i, j, value) rows: one pass, partial sums.

    A row in which a column or the target isn't finite counts in no sum. Without rows the sums are null.
    """
    terms = [F.lit(1.0), *(F.col(c).cast("double") for c in columns), F.col(target).cast("double")]
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    good = F.lit(True)
    for x in terms[1:]:
        good = good & finite(x)
    one = df.where(good).agg(*(F.sum(terms[i] * terms[j]).alias(f"v{i}_{j}") for i, j in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"v{i}_{j}").alias("value")) for i, j in pairs))).alias("t")).select("t.*")


def step_estimate(df: DataFrame, by: Sequence[str], at: str, value: str, guard: float, window: float) -> DataFrame:
    """How far a value jumps where ``at`` is 0.

    step: the gap of two straight fits, one a side, outside the guard and
    inside the window; band: the largest residual inside the guard from one fit
    of both sides; fraction: the greater, over the mean of both levels. Null
    where a side has no fit. Null keys are a group; a group without a row inside the guard has band 0.
    """
    near = df.where(finite(F.col(value)) & (F.abs(at) <= window))
    s, v, out = F.col(at), F.col(value), F.abs(at) >= guard
    side = lambda rule: F.regr_intercept(F.when(rule, v), F.when(rule, s))
    fits = near.groupBy(*by).agg(side(out & (s < 0)).alias("left"), side(out & (s >= 0)).alias("right"), side(out).alias("_b"), F.regr_slope(F.when(out, v), F.when(out, s)).alias("_m"))
    keys = [f"_k{i}" for i in range(len(by))]
    keyed = lambda d, *columns: d.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), *columns)
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys, strict=True)] or F.lit(True)  # null keys are groups
    inner = near.where(~out).join(keyed(fits, "_b", "_m"), same).groupBy(*by).agg(F.max(F.abs(v - F.col("_b") - F.col("_m") * s)).alias("band"))
    both = fits.join(keyed(inner, "band"), same, "left").withColumn("step", F.abs(F.col("left") - F.col("right"))).withColumn("band", F.coalesce("band", F.lit(0.0)))
    level = F.abs(F.col("left") + F.col("right")) / 2
    return both.select(*by, "left", "right", "step", "band", F.when(level > 0, F.greatest("step", "band") / level).alias("fraction"))
