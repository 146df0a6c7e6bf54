"""Exact order statistics by group, without gathering a large group in one task.

Where no group has more than ``GATHER`` values (a count that is taken first),
each is sorted within one row. Beyond that:

One scan takes a sketch of each group, which brackets every wanted rank between
two values; a second counts what lies below the brackets and keeps only the
distinct values inside them, a small part of the group. Sorting those gives the
exact values. The sketches' table is written before it is joined, so Spark knows
its size and broadcasts it only if that is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

#: Points of a sketch, and its accuracy: the error in rank (n / ACCURACY) is far less than the step between points.
POINTS, ACCURACY = 1024, 10_000
#: Values of a group that are sorted within one row: 8 MB. Both ways are exact.
GATHER = 1 << 20


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def order_statistics(df: DataFrame, by: Sequence[str], value: str, wanted: dict[str, Column], also: Sequence[Column] = ()) -> DataFrame:
    """``by``, n, the aggregates ``also``, and for each name the two order statistics ``name_lo`` and ``name_hi``.

    wanted: a fractional rank, from 0, as a Column of ``n`` (the number of
    finite values); lo and hi are the values at its floor and ceiling. ``also``
    sees the finite values as ``_x`` (null for the others) and all as ``_raw``. Nulls, NaN and
    infinities have no rank; a group of nothing else has n 0 and null
    statistics. Null keys make a group like any other. An empty table gives no
    rows, or with an empty ``by`` one row with n 0. Ties need no rule, as equal
    values are one value. Other columns are left out, so names can't clash. Building it counts the groups, and
    takes the sketches of large ones.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    raw = F.col(value).cast("double")
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.when(finite(raw), raw).alias("_x"), raw.alias("_raw"))
    x = F.col("_x")
    largest = rows.groupBy(*keys).agg(F.count(x).alias("n")).agg(F.max("n")).first()[0]
    if (largest or 0) <= GATHER:
        gathered = rows.groupBy(*keys).agg(F.count(x).alias("n"), *also, F.sort_array(F.collect_list("_x")).alias("_sorted"))
        made = [c for c in gathered.columns if c not in (*keys, "_sorted")]
        ends = [F.get("_sorted", end(rank).cast("int")).alias(f"{name}_{side}") for name, rank in wanted.items() for side, end in (("lo", F.floor), ("hi", F.ceil))]
        return gathered.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), *made, *ends)
    grid = F.split(F.lit(" ".join(str(i / POINTS) for i in range(POINTS + 1))), " ").cast("array<double>")  # one literal, not a thousand
    points = F.percentile_approx(x, grid, ACCURACY)
    sketch = rows.groupBy(*keys).agg(F.count(x).alias("n"), F.min(x).alias("_least"), F.max(x).alias("_most"), points.alias("_points"), *also)
    # Point k is about the value of which k / POINTS of the values are at most it. The bracket of a rank goes from the last
    # point with too few values below the rank to the first with enough, and one point further each way for the sketch's error.
    brackets = []
    some = F.nullif(F.col("n"), F.lit(0).cast("long"))
    for name, rank in wanted.items():
        first = F.floor(F.floor(rank) / some * POINTS).cast("int") - 1
        last = F.ceil((F.ceil(rank) + 1) / some * POINTS).cast("int") + 1
        low = F.when(first <= 0, F.col("_least")).otherwise(F.get("_points", first))
        high = F.when(last >= POINTS, F.col("_most")).otherwise(F.get("_points", last))
        brackets += [rank.alias(f"_{name}_rank"), low.alias(f"_{name}_from"), high.alias(f"_{name}_to")]
    named = [c for c in sketch.columns if c not in ("_least", "_most", "_points")]
    targets = cut(sketch.select(*named, *brackets))

    ends = [f"_{name}_{end}" for name in wanted for end in ("rank", "from", "to")]
    named = [c for c in named if c not in keys]
    right = targets.withColumnsRenamed({k: f"_r{k}" for k in keys})
    beside = lambda left, *columns: left.join(right.select(*(f"_r{k}" for k in keys), *columns), [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys]) if keys else left.crossJoin(F.broadcast(right.select(*columns)))  # noqa: E731 - without keys one row
    joined = beside(rows.where(x.isNotNull()), *ends)
    inside = F.lit(False)
    for name in wanted:
        inside = inside | ((x >= F.col(f"_{name}_from")) & (x <= F.col(f"_{name}_to")))
    below = [F.count_if(x < F.col(f"_{name}_from")).alias(f"_{name}_below") for name in wanted]
    counts = joined.groupBy(*keys, F.when(inside, x).alias("_v")).agg(F.count("*").alias("_c"), *below)
    # A row of nothing for each group, so that groups without values stay.
    zero = F.lit(0).cast("long")
    counts = counts.union(targets.select(*keys, F.lit(None).cast("double"), zero, *(zero for _ in wanted)))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upwards = group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("_v")
    mine = {name: (v >= F.col(f"_{name}_from")) & (v <= F.col(f"_{name}_to")) for name in wanted}
    upto = [F.sum(F.when(mine[name], F.col("_c")).otherwise(0)).over(upwards).alias(f"_{name}_inside") for name in wanted]
    before = [F.sum(f"_{name}_below").over(group).alias(f"_{name}_before") for name in wanted]
    placed = beside(counts, *named, *ends).select("*", *upto, *before)
    found = []
    for name in wanted:
        for side, end in (("lo", F.floor), ("hi", F.ceil)):
            reached = mine[name] & (F.col(f"_{name}_before") + F.col(f"_{name}_inside") > end(f"_{name}_rank"))
            found.append(F.min(F.when(reached, v)).alias(f"{name}_{side}"))
    out = placed.groupBy(*keys).agg(*(F.first(c).alias(c) for c in named), *found)
    return out.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), *(c for c in out.columns if c not in keys))


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, ranks: dict[str, float], also: Sequence[Column] = ()) -> DataFrame:
    """``by``, n, ``also`` and for each name the order statistic at floor(q (n - 1)); see ``order_statistics``."""
    wanted = {k: F.floor(F.lit(float(q)) * (F.col("n") - 1)) for k, q in ranks.items()}
    found = order_statistics(df, by, value, wanted, also)
    return found.drop(*(f"{k}_hi" for k in ranks)).withColumnsRenamed({f"{k}_lo": k for k in ranks})


def linear_quantiles(df: DataFrame, by: Sequence[str], value: str, ranks: dict[str, float], also: Sequence[Column] = ()) -> DataFrame:
    """``by``, n, ``also`` and for each name the quantile at q (n - 1), linear between neighbours; see ``order_statistics``."""
    place = {k: F.lit(float(q)) * (F.col("n") - 1) for k, q in ranks.items()}
    found = order_statistics(df, by, value, place, also)
    part = {k: place[k] - F.floor(place[k]) for k in ranks}
    lines = {k: F.col(f"{k}_lo") + (F.col(f"{k}_hi") - F.col(f"{k}_lo")) * part[k] for k in ranks}
    return found.withColumns(lines).drop(*(f"{k}_{side}" for k in ranks for side in ("lo", "hi")))
