"""The noise of phase measurements, how well complementary frames cancel out, and welded meshes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut
from .names import prefix
from .quantiles import finite, order_statistics
from .statistics import global_rank

# The least samples of a noise bin, and the share of the peak that makes a block evidence
LEAST_SAMPLES, EVIDENCE_SHARE = 64, 0.1


def chi_median(dof: int) -> float:
    """The median length of a vector of ``dof`` unit normal parts, by bisection of its distribution."""

    def below(x: float) -> float:  # the regularised lower gamma function of dof / 2 at x, by its series
        a = dof / 2
        term = total = 1 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= x / k
            total += term
        return total * math.exp(a * math.log(x) - x - math.lgamma(a))

    low, high = 1e-12, 4.0 * dof + 4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid / 2) < 0.5 else (low, mid)
    return math.sqrt((low + high) / 2)


def phase_residual(samples: Sequence[Column]) -> tuple[Column, Column]:
    """(level, residual) of evenly spaced samples of one period: their mean, and the length of what a sine of that period leaves."""
    n = len(samples)
    angles = [2 * math.pi * i / n for i in range(n)]
    total = lambda weights: sum((s * w for s, w in zip(samples, weights, strict=True)), F.lit(0.0))
    level = total([1 / n] * n)
    c, s = total([2 / n * math.cos(a) for a in angles]), total([2 / n * math.sin(a) for a in angles])
    left = [v - level - c * math.cos(a) - s * math.sin(a) for v, a in zip(samples, angles, strict=True)]
    return level, F.sqrt(sum((d * d for d in left), F.lit(0.0)))


def phase_noise(df: DataFrame, level: str, residual: str, ties: Sequence[str], steps: int, bins: int, floor: float = 0.0) -> DataFrame:
    """bin, n, level and sigma: the noise of phases of ``steps`` samples as a function of their level.

    Bins hold equally many rows by level, at most ``bins``, and at least
    ``LEAST_SAMPLES`` rows each; with fewer rows in all, or without freedom
    (steps of 3 or fewer), there are none. level is the upper middle level of
    the bin; sigma is its upper middle residual over the median that unit noise
    would leave, at least ``floor``. Rows where either is not finite don't count.
    Ranks within bins come from the ranks of the whole; rows are stored once and put in order once.
    """
    x, r = F.col(level).cast("double"), F.col(residual).cast("double")
    # Stored before they are judged: a condition on computed columns would be pushed below and compute them anew for each of its parts.
    rows = cut(df.select(x.alias("_x"), r.alias("_r"), *(F.col(c).alias(f"_t{i}") for i, c in enumerate(ties))).where(F.lit(steps > 3)))
    rows = rows.where(finite(F.col("_x")) & finite(F.col("_r")))
    keys = [f"_t{i}" for i in range(len(ties))]
    ranked = global_rank(rows, "_x", ["_r", *keys], "_at", "_n").where(F.col("_n") >= LEAST_SAMPLES)
    usable = F.greatest(F.lit(1), F.least(F.lit(bins), F.floor(F.col("_n") / LEAST_SAMPLES)))
    bin_of = (F.ceil((F.col("_at") + 1) * usable / F.col("_n")) - 1).cast("int")
    binned = ranked.select("_x", "_r", "_at", bin_of.alias("bin"), F.floor(bin_of * F.col("_n") / usable).alias("_from"), F.floor((bin_of + 1) * F.col("_n") / usable).alias("_to"))
    # The upper middle of a bin: of its levels by their rank, of its residuals as an order statistic.
    level = F.max(F.when(F.col("_at") == F.col("_from") + F.floor((F.col("_to") - F.col("_from")) / 2), F.col("_x"))).alias("level")
    levels = binned.groupBy(F.col("bin").alias("_b")).agg(level)
    middle = order_statistics(binned, ["bin"], "_r", {"_sigma": F.floor(F.col("n") / 2)})
    found = middle.join(levels, F.col("bin") == F.col("_b"))
    return found.select("bin", "n", "level", F.greatest(F.col("_sigma_lo") / (chi_median(steps - 3) if steps > 3 else 1.0), F.lit(floor)).alias("sigma"))


def noise_at(df: DataFrame, model: DataFrame, at: str, alias: str = "noise") -> DataFrame:
    """df with the noise of each row's level, linear between the model's levels and constant beyond; null without a model or a level.

    model: level and sigma, a row a bin as ``phase_noise`` gives. It is joined
    as one row of two short arrays.
    """
    p = prefix(df)
    packed = model.agg(F.array_sort(F.collect_list(F.struct("level", "sigma"))).alias(f"{p}m"))  # at most a row a bin
    m, x = F.col(f"{p}m"), F.col(at).cast("double")
    first, last = F.get(m, F.lit(0)), F.try_element_at(m, F.lit(-1))
    k = F.size(F.filter(m, lambda b: b["level"] < x))
    low, high = F.get(m, k - 1), F.get(m, k)
    span = high["level"] - low["level"]
    inside = low["sigma"] + (x - low["level"]) / F.nullif(span, F.lit(0.0)) * (high["sigma"] - low["sigma"])
    value = F.when(x <= first["level"], first["sigma"]).when(x >= last["level"], last["sigma"]).otherwise(inside)
    return df.crossJoin(F.broadcast(packed)).withColumn(alias, value).drop(f"{p}m")  # one row


def complement_residual(df: DataFrame, by: Sequence[str], a: str, b: str, white: str, black: str) -> DataFrame:
    """``by``, blocks and residual: how far two frames are from adding up to white and black, over the modulation of the blocks that count.

    df: a row for each block; one with a value that isn't finite is not
    measured. Blocks of less than ``EVIDENCE_SHARE`` of the greatest
    modulation are left out. A group without modulation has 0 blocks and a
    null residual.
    """
    names = {"_a": a, "_b": b, "_w": white, "_k": black}
    rows = df.select(*by, *(F.col(c).cast("double").alias(n) for n, c in names.items()))
    measured = F.lit(True)
    for n in names:
        measured = measured & finite(F.col(n))
    rows = rows.withColumn("_m", F.when(measured, F.col("_w") - F.col("_k")))
    peaks = rows.groupBy(*by).agg(F.max("_m").alias("_peak"))
    keyed = peaks.select(*(F.col(c).alias(f"_p{i}") for i, c in enumerate(by)), "_peak")
    both = rows.join(keyed, [F.col(c).eqNullSafe(F.col(f"_p{i}")) for i, c in enumerate(by)]) if by else rows.crossJoin(F.broadcast(keyed))  # without keys one row
    counts = F.coalesce((F.col("_peak") > 0) & (F.col("_m") >= EVIDENCE_SHARE * F.col("_peak")), F.lit(False))
    gap = F.abs(F.col("_a") + F.col("_b") - (F.col("_w") + F.col("_k")))
    sums = both.groupBy(*by).agg(F.count_if(counts).alias("blocks"), F.sum(F.when(counts, gap)).alias("_g"), F.sum(F.when(counts, F.col("_m"))).alias("_s"))
    return sums.select(*by, "blocks", F.try_divide("_g", "_s").alias("residual"))


def weld(vertices: DataFrame, mesh: str, index: str, grid: float) -> DataFrame:
    """(mesh, index, node): vertices that round to the same place of a grid become one node, the least index of them."""
    cell = [F.floor(F.col(a).cast("double") / grid + 0.5).alias(f"_{a}") for a in "xyz"]
    nodes = vertices.select(F.col(mesh).alias("mesh"), F.col(index).alias("index"), *cell)
    return nodes.withColumn("node", F.min("index").over(Window.partitionBy("mesh", "_x", "_y", "_z"))).select("mesh", "index", "node")


def welded_sides(welded: DataFrame, triangles: DataFrame, mesh: str) -> DataFrame:
    """(mesh, src, dst, triangles): each pair of nodes of ``weld`` that sides of triangles (mesh, a, b, c) join, src < dst, with how many do."""
    sides = F.explode(F.array(*(F.struct(F.col(p).alias("p"), F.col(q).alias("q")) for p, q in ("ab", "bc", "ca"))))
    ends = triangles.select(F.col(mesh).alias("mesh"), sides.alias("_s")).select("mesh", "_s.p", "_s.q")
    one = welded.select("mesh", F.col("index").alias("p"), F.col("node").alias("_one"))
    two = welded.select("mesh", F.col("index").alias("q"), F.col("node").alias("_two"))
    pairs = ends.join(one, ["mesh", "p"]).join(two, ["mesh", "q"]).where("_one <> _two")
    return pairs.groupBy("mesh", F.least("_one", "_two").alias("src"), F.greatest("_one", "_two").alias("dst")).agg(F.count("*").alias("triangles"))


def side_lengths(sides: DataFrame, places: DataFrame) -> DataFrame:
    """(mesh, src, dst, length): both directions of each of ``welded_sides``, between the places (mesh, node, x, y, z) of its nodes."""
    place = lambda end: places.select("mesh", F.col("node").alias(end), *(F.col(a).alias(f"_{end}{a}") for a in "xyz"))
    long = sides.select("mesh", "src", "dst").join(place("src"), ["mesh", "src"]).join(place("dst"), ["mesh", "dst"])
    gaps = [F.col(f"_src{a}") - F.col(f"_dst{a}") for a in "xyz"]
    length = F.sqrt(sum((gap * gap for gap in gaps), F.lit(0.0)))
    ways = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return long.select("mesh", ways.alias("_w"), length.alias("length")).select("mesh", "_w.src", "_w.dst", "length")


def mesh_edges(vertices: DataFrame, triangles: DataFrame, mesh: str, index: str, grid: float) -> DataFrame:
    """(mesh, src, dst, length): both directions of each edge between welded nodes, once, as ``graph.shortest_paths`` takes them.

    triangles: (mesh, a, b, c). An edge within one node is none. Lengths are
    between the nodes' own vertices, those of the least index.
    """
    places = vertices.select(F.col(mesh).alias("mesh"), F.col(index).alias("node"), "x", "y", "z")
    return side_lengths(welded_sides(weld(vertices, mesh, index, grid), triangles, mesh), places)
