"""One constant at a time: the levels of a sweep, how far each response swings, what compounds; and photographs made linear.

Null keys make groups like any other; nulls, NaN and infinities are no values
unless a docstring says otherwise. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import finite

#: A range that spans this factor is swept in even steps of the logarithm
LOG_SPAN = 4
#: Steps below this share of the swing are no reversal
STILL = 1e-3


def sweep_levels(least: Column, greatest: Column, nominal: Column, count: int = 9) -> Column:
    """``count`` levels from ``least`` to ``greatest``, both exactly, with the nominal among them; null if one is null.

    Steps are even, or even in the logarithm where least is above 0 and
    greatest at least four times it. A level within 1e-9 of the range of the
    nominal becomes it; otherwise it is one level more, in order, also where it
    lies outside the range.
    """
    a, b, n = (c.cast("double") for c in (least, greatest, nominal))
    logs = (a > 0) & (b >= a * LOG_SPAN)
    low, high = F.ln(F.when(a > 0, a)), F.ln(F.when(b > 0, b))

    def level(i: Column) -> Column:
        t = i / F.lit(float(count - 1))
        return F.when(i == 0, a).when(i == count - 1, b).when(logs, F.exp(low + t * (high - low))).otherwise(a + t * (b - a))

    near = lambda v: F.abs(v - n) <= (b - a) * 1e-9
    levels = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), level)
    snapped = F.transform(levels, lambda v: F.when(near(v), n).otherwise(v))
    whole = F.when(F.exists(levels, near), snapped).otherwise(F.array_sort(F.array_append(levels, n)))
    return F.when(a.isNotNull() & b.isNotNull() & n.isNotNull(), whole)


def sensitivities(points: DataFrame, parameters: DataFrame, responses: DataFrame) -> DataFrame:
    """(parameter, response, least, greatest, swing, swing_over_gate, at_first, at_last, at_nominal, monotone, crossing, scored).

    points: (parameter, response, level, value). parameters: (parameter,
    nominal, ...), responses: (response, gate, scored), each once. swing is
    over the finite values, null without one; swing_over_gate is null without a
    gate; crossing is the least level above the gate (an infinite value is
    above it). at_first and at_last are the values at the ends of the sweep, null
    where they are missing there. monotone: no steps both up and down, where steps of under a
    thousandth of the swing, and those beside a missing value, tell nothing. At
    a level that repeats the greatest finite value counts. Points without a
    listed parameter or response are left out, as are levels that aren't finite.

    One partial aggregate by level, then windows and an aggregate by (parameter,
    response) that share its one shuffle; what is listed is joined after.
    """
    key = ["parameter", "response"]
    value = F.when(~F.isnan("value"), F.col("value").cast("double"))
    levels = points.where(finite(F.col("level"))).groupBy(*key, F.col("level").cast("double").alias("_l")).agg(F.coalesce(F.max(F.when(finite(value), value)), F.max(value)).alias("_v"))
    listed = levels.join(parameters.select(F.col("parameter").alias("_p"), F.col("nominal").cast("double").alias("_nominal")), F.col("parameter").eqNullSafe(F.col("_p")))
    listed = listed.join(responses.select(F.col("response").alias("_r"), F.col("gate").cast("double").alias("_gate"), F.col("scored").alias("_scored")), F.col("response").eqNullSafe(F.col("_r")))
    sane = F.when(finite(F.col("_v")), F.col("_v"))
    group = Window.partitionBy(*key)
    listed = listed.withColumns({"_step": sane - F.lag(sane).over(group.orderBy("_l")), "_swing": F.max(sane).over(group) - F.min(sane).over(group)})
    moved = F.abs("_step") >= F.col("_swing") * STILL
    found = listed.groupBy(*key).agg(
        F.min(sane).alias("least"), F.max(sane).alias("greatest"), F.first("_swing").alias("swing"), F.first("_gate").alias("_gate"), F.min_by(sane, "_l").alias("at_first"), F.max_by(sane, "_l").alias("at_last"),
        F.max(F.when(F.col("_l") == F.col("_nominal"), sane)).alias("at_nominal"), F.max(F.when(moved & (F.col("_step") > 0), 1)).alias("_up"), F.max(F.when(moved & (F.col("_step") < 0), 1)).alias("_down"),
        F.min(F.when(F.col("_v") > F.col("_gate"), F.col("_l"))).alias("crossing"), F.first("_scored").alias("scored"),
    )
    monotone = ~(F.col("_up").isNotNull() & F.col("_down").isNotNull())
    over = F.try_divide("swing", "_gate")
    return found.select(*key, "least", "greatest", "swing", over.alias("swing_over_gate"), "at_first", "at_last", "at_nominal", monotone.alias("monotone"), "crossing", "scored")


def rank_parameters(found: DataFrame, parameters: DataFrame, within: str) -> DataFrame:
    """``parameters``' columns, score, score_response, flips and rank (from 1 in each ``within``).

    parameters: (parameter, least, greatest, ``within``, ...), each once. score
    is the greatest swing_over_gate of the scored responses, 0 without any, and
    score_response the one that has it, the least of equal ones; per_range is
    score over the width of the range, null for one without width. flips: some
    response crosses its gate. Equal scores are ranked by parameter. The ranks
    sort one row a parameter in each ``within``.
    """
    worth = F.when(F.coalesce(F.col("scored"), F.lit(False)) & finite(F.col("swing_over_gate")) & (F.col("swing_over_gate") > 0), F.col("swing_over_gate"))
    # Of equal scores the least response: the greatest (score) first, then the least name among those
    best = F.array_sort(F.collect_set(F.when(worth.isNotNull(), F.struct((-worth).alias("s"), F.col("response").alias("r")))))
    sums = found.groupBy(F.col("parameter").alias("_p")).agg(F.get(best, F.lit(0)).alias("_best"), F.max(F.col("crossing").isNotNull()).alias("_flips"))
    rows = parameters.join(sums, F.col("parameter").eqNullSafe(F.col("_p")), "left")
    score = F.coalesce(-F.col("_best.s"), F.lit(0.0))
    rows = rows.select(*parameters.columns, score.alias("score"), F.col("_best.r").alias("score_response"), F.try_divide(score, (F.col("greatest") - F.col("least")).cast("double")).alias("per_range"), F.coalesce("_flips", F.lit(False)).alias("flips"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(within).orderBy(F.desc("score"), F.asc_nulls_last("parameter"))))


def interactions(corners: DataFrame, by: Sequence[str], first: str, second: str, value: str) -> DataFrame:
    """``by``, main_a, main_b, interaction, compounding of two constants at both ends of their ranges.

    first and second are booleans: whether the constant is at its upper end.
    Mains are half the sum of the two differences, interaction half the second
    difference, compounding its size over the larger main (null where both are
    0). A corner that repeats takes its greatest value; groups that lack one of
    the four have no row, nor do those with a value that isn't finite. One
    partial aggregate.
    """
    at = lambda a, b: F.max(F.when((F.col(first) == a) & (F.col(second) == b), F.col(value).cast("double")))
    rows = corners.groupBy(*by).agg(at(False, False).alias("_0"), at(True, False).alias("_1"), at(False, True).alias("_2"), at(True, True).alias("_3"))
    none, a, b, both = (F.col(f"_{i}") for i in range(4))
    for c in (none, a, b, both):
        rows = rows.where(finite(c))
    parts = rows.select(*by, ((a + both - none - b) / 2).alias("main_a"), ((b + both - none - a) / 2).alias("main_b"), ((both - a - b + none) / 2).alias("interaction"))
    return parts.withColumn("compounding", F.try_divide(F.abs("interaction"), F.greatest(F.abs("main_a"), F.abs("main_b"))))


def linear(value: Column, transfer: str | float) -> Column:
    """A code in 0 to 1 as light: ``srgb``, ``linear`` or the exponent of a power. Powers read negative codes as 0."""
    if transfer == "linear":
        return value
    if transfer == "srgb":
        return F.when(value <= 0.04045, value / 12.92).otherwise(F.pow((value + 0.055) / 1.055, F.lit(2.4)))
    return F.pow(F.greatest(value, F.lit(0.0)), F.lit(float(transfer)))


def exposure_reports(pixels: DataFrame, by: Sequence[str], channels: Sequence[str], maximum: float, transfer: str | float) -> DataFrame:
    """``by``, pixels, clipped_high, clipped_low (shares of pixels), mean, lo, hi (of light) of each photograph.

    channels: one or three columns of codes from 0 to ``maximum``; alpha is no
    light and isn't given. A pixel is clipped if one of its channels is at that
    end. A pixel with a code that isn't finite is left out whole. One partial
    aggregate.
    """
    if not maximum > 0 or len(channels) not in (1, 3):
        raise ValueError("codes need a maximum above 0, and pixels one or three channels")
    codes = [F.col(c).cast("double") for c in channels]
    whole = F.lit(True)
    for c in codes:
        whole = whole & finite(c)
    rows = pixels.where(whole).select(*by, F.array(*codes).alias("_c"), F.array(*(linear(c / maximum, transfer) for c in codes)).alias("_v"))
    end = lambda test: F.count_if(F.exists("_c", test)) / F.count(F.lit(1))
    total = F.sum(F.aggregate("_v", F.lit(0.0), lambda s, v: s + v))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pixels"), end(lambda c: c >= maximum).alias("clipped_high"), end(lambda c: c <= 0).alias("clipped_low"),
        (total / (F.count(F.lit(1)) * len(channels))).alias("mean"), F.min(F.array_min("_v")).alias("lo"), F.max(F.array_max("_v")).alias("hi"),
    )


def reference_ranges(reports: DataFrame, by: Sequence[str], role: str) -> DataFrame:
    """``by``, light_range (white less black), usable and problem, from reports whose ``role`` is ``white`` or ``black``.

    problem is null, ``missing`` (a frame isn't there) or ``not-brighter``: all
    later frames are read as shares of that difference. Of several white or
    black frames the brightest counts. One partial aggregate.
    """
    light = lambda what: F.max(F.when((F.col(role) == what) & finite(F.col("mean")), F.col("mean")))
    rows = reports.groupBy(*by).agg((light("white") - light("black")).alias("light_range"))
    problem = F.when(F.col("light_range").isNull(), "missing").when(~(F.col("light_range") > 0), "not-brighter")
    return rows.select(*by, "light_range", problem.isNull().alias("usable"), problem.alias("problem"))
