"""Robust fits, keyed samples, lobes of periodic curves and streaks over rounds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import hash_word, uniform
from .names import prefix
from .quantiles import finite

#: Fixed value: the usual Huber limit, with which a fit of normal errors keeps 95 % of its efficiency
HUBER = 1.345
#: Slices of a group in the first round of a keyed sample
SLICES = 64


def robust_fit(df: DataFrame, columns: Sequence[str], target: str, sigma: Column | float = 1.0, delta: float = HUBER, rounds: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """(term, value, gradient, rounds): a linear fit with an intercept (term 0) under a Huber loss, by reweighted least squares.

    A residual over ``sigma`` beyond ``delta`` counts with weight delta over its size. Each round is one aggregate of
    partial sums over all rows, and only those sums come to the driver; the fit starts from ordinary least squares and ends when no part
    of the gradient, a row's share of it, exceeds ``tolerance``, or after ``rounds``. Rows in which a value isn't finite, or sigma isn't above 0, don't count.
    Without rows, or where columns depend on each other, values are the least-norm solution (0 without rows). Building it runs the rounds.
    """
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in columns)]
    y, s = F.col(target).cast("double"), sigma.cast("double") if isinstance(sigma, Column) else F.lit(float(sigma))
    good = finite(y) & finite(s) & (s > 0)
    for c in x[1:]:
        good = good & finite(c)
    k = len(x)
    rows = df.where(good).select(*(c.alias(f"x{i}") for i, c in enumerate(x)), y.alias("y"), s.alias("s"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    beta, first, used, gradient = np.zeros(k), True, 0, 0.0
    for used in range(1, rounds + 2):
        fit = sum((F.col(f"x{i}") * float(b) for i, b in enumerate(beta)), F.lit(0.0))
        r = (F.col("y") - fit) / F.col("s")
        w = F.lit(1.0) if first else F.when(F.abs(r) > delta, delta / F.abs(r)).otherwise(1.0)
        at = rows.withColumn("w", w / (F.col("s") * F.col("s"))).withColumn("r", F.col("y") - fit)
        sums = at.agg(F.count("*").alias("n"), *(F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"a{i}_{j}") for i, j in pairs), *(F.sum(F.col("w") * F.col(f"x{i}") * F.col("r")).alias(f"g{i}") for i in range(k))).first()
        if not sums["n"]:
            break
        a = np.zeros((k, k))
        for i, j in pairs:
            a[i, j] = a[j, i] = sums[f"a{i}_{j}"]
        g = np.array([sums[f"g{i}"] for i in range(k)])
        gradient = float(np.abs(g).max() / sums["n"])
        if not first and gradient <= tolerance or used > rounds:
            break
        beta, first = beta + np.linalg.lstsq(a, g, rcond=None)[0], False
    return df.sparkSession.createDataFrame([(i, float(b), gradient, used - 1) for i, b in enumerate(beta)], "term int, value double, gradient double, rounds int")


def text_seed(seed: int, label: Column) -> Column:
    """A 32-bit seed that a number and a text fix: a fold of hashes over the text's characters, which any engine can repeat. Null for null."""
    start = F.lit(seed & 0xFFFFFFFF).cast("long")
    folded = F.aggregate(F.split(label, ""), start, lambda s, c: hash_word(s.bitwiseXOR(F.ascii(c).cast("long")) + 0x9E3779B9))
    return F.when(F.length(label) > 0, folded).when(label.isNotNull(), start)


def draw_distinct(df: DataFrame, by: Sequence[str], key: Sequence[str], count: int, seed: Column | int = 0) -> DataFrame:
    """``count`` rows a group, drawn without replacement, with ``draw``, their order from 0; groups of fewer rows come whole.

    A row's place depends on ``seed`` and its key, whole numbers, alone, so the sample is the same however rows are
    partitioned; equal keys are one row (which of them is open). Each group is first cut in ``SLICES`` by the same draw, so one of a third of all rows is spread,
    and only the best ``count`` of a slice go on. Null keys draw as 0.
    """
    p = prefix(df)
    seeded = seed if isinstance(seed, Column) else F.lit(seed)
    parts = [F.coalesce(F.col(k).cast("long"), F.lit(0)) for k in key]
    rows = df.withColumns({f"{p}u": uniform(seeded, *parts), f"{p}s": F.pmod(F.xxhash64(*key), F.lit(SLICES))})
    alone = Window.partitionBy(*by, f"{p}s").orderBy(f"{p}u", *key)
    once = rows.withColumns({f"{p}r": F.dense_rank().over(alone), f"{p}c": F.row_number().over(Window.partitionBy(*by, f"{p}s", *key).orderBy(F.lit(0)))})
    some = once.where((F.col(f"{p}r") <= count) & (F.col(f"{p}c") == 1))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(f"{p}u", *key))
    return some.withColumn("draw", place - 1).where(F.col("draw") < count).select(*df.columns, "draw")


def lobes(df: DataFrame, by: Sequence[str], order: str, value: str, tolerance: float) -> DataFrame:
    """``by``, n, minima (places in order, from 0): the minima of a closed curve, each at least ``tolerance`` below the maxima beside it.

    The curve is turned so that it starts at its least value, the first of equals, and folded once around: a turn
    counts when the curve has left its last extreme by more than the tolerance. Flat curves and curves of fewer than four values
    have none. Values that aren't finite aren't part of the curve; order must be unique. A curve is gathered in one row,
    as its samples are; curves of a group are never compared.
    """
    p = prefix(df)
    v = F.col(value).cast("double")
    curves = df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.when(finite(v), F.struct(F.col(order).alias("o"), v.alias("v"))))), lambda s: s["v"]).alias(f"{p}v"))
    n = F.size(f"{p}v")
    least = F.array_position(f"{p}v", F.array_min(f"{p}v")).cast("int") - 1
    turned = F.concat(F.slice(f"{p}v", least + 1, n), F.slice(f"{p}v", F.lit(1), least + 1))  # closed: the start comes again
    curves = curves.withColumns({f"{p}n": n, f"{p}s": F.when(n >= 4, least)}).withColumn(f"{p}t", F.when(F.col(f"{p}n") >= 4, turned).otherwise(F.array().cast("array<double>")))
    start = F.struct(F.lit(1).alias("d"), F.get(f"{p}t", F.lit(0)).alias("e"), F.lit(0).alias("i"), F.lit(0).alias("k"), F.array().cast("array<int>").alias("m"))

    def step(s: Column, x: Column) -> Column:
        up = s["d"] == 1
        further = F.when(up, x > s["e"]).otherwise(x < s["e"])
        turn = ~further & (F.abs(x - s["e"]) > tolerance)
        return F.struct(
            F.when(turn, -s["d"]).otherwise(s["d"]).alias("d"), F.when(further | turn, x).otherwise(s["e"]).alias("e"), F.when(further | turn, s["k"]).otherwise(s["i"]).alias("i"),
            (s["k"] + 1).alias("k"), F.when(turn & ~up, F.array_append(s["m"], s["i"])).otherwise(s["m"]).alias("m"),
        )

    last = curves.withColumn(f"{p}f", F.aggregate(f"{p}t", start, step))
    every = F.when(F.col(f"{p}f.d") == -1, F.array_append(f"{p}f.m", F.col(f"{p}f.i"))).otherwise(F.col(f"{p}f.m"))
    places = F.array_sort(F.array_distinct(F.transform(every, lambda i: F.pmod(i + F.col(f"{p}s"), F.col(f"{p}n")))))
    return last.select(*by, F.col(f"{p}n").alias("n"), places.alias("minima"))


def streaks(rounds: DataFrame, by: Sequence[str], order: str, improving: Column, qualified: Column) -> DataFrame:
    """The rounds with ``streak``: qualified rounds without improvement since the last that improved, this one included.

    An improving round has 0; one that isn't qualified carries the streak on, as it says nothing either way. Nulls are false. Order must be unique within a series.
    """
    p = prefix(rounds)
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    yes = F.coalesce(improving, F.lit(False))
    named = rounds.withColumns({f"{p}e": F.sum(yes.cast("int")).over(upto), f"{p}q": (F.coalesce(qualified, F.lit(False)) & ~yes).cast("int")})
    since = Window.partitionBy(*by, f"{p}e").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return named.withColumn("streak", F.sum(f"{p}q").over(since)).select(*rounds.columns, "streak")
