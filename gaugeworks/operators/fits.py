"""Fits from sums that Spark adds up: trends, rotations, cones, bounds, epochs; and regions of pixels.

Groups are never gathered: each fit needs some sums a group, and what is joined
back is one row a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components
from .quantiles import finite


def _beside(left: DataFrame, right: DataFrame, by: Sequence[str], *columns: str) -> DataFrame:
    """left with ``columns`` of right's row of the same group (null keys make a group); without keys right has one row."""
    if not by:
        return left.crossJoin(F.broadcast(right.select(*columns)))
    keyed = right.select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(by)), *columns)
    return left.join(keyed, [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)])


def trend_fit(df: DataFrame, by: Sequence[str], at: str, value: str, degree: int, scale: float) -> DataFrame:
    """``by``, n, c0 to c<degree> of the least-squares polynomial in at / scale, and residual_rms.

    Rows where either is not finite don't count. Groups of fewer than degree +
    2 rows, and those whose places are too few for the degree, have null
    coefficients. The normal equations are solved by elimination in Columns.
    """
    x = F.col(at).cast("double") / scale
    rows = df.select(*by, x.alias("_at"), F.col(value).cast("double").alias("_v")).where(finite(F.col("_at")) & finite(F.col("_v")))
    moments = [F.sum(F.pow("_at", F.lit(k))).alias(f"_m{k}") for k in range(2 * degree + 1)]
    loads = [F.sum(F.pow("_at", F.lit(k)) * F.col("_v")).alias(f"_r{k}") for k in range(degree + 1)]
    fits = rows.groupBy(*by).agg(F.count("*").alias("n"), *moments, *loads)
    # Column by column: each step adds the reduced rows as columns, so expressions stay small.
    size = degree + 1
    cell = {(i, j): f"_m{i + j}" for i in range(size) for j in range(size)} | {(i, size): f"_r{i}" for i in range(size)}
    for k in range(size):
        pivot = F.when(F.abs(cell[k, k]) > 1e-12 * F.col("n"), F.col(cell[k, k]))
        made = {}
        for i in range(k + 1, size):
            for j in range(k + 1, size + 1):
                made[f"_e{k}_{i}_{j}"] = F.col(cell[i, j]) - F.col(cell[i, k]) / pivot * F.col(cell[k, j])
                cell[i, j] = f"_e{k}_{i}_{j}"
        fits = fits.withColumns(made) if made else fits
    for k in reversed(range(size)):
        pivot = F.when(F.abs(cell[k, k]) > 1e-12 * F.col("n"), F.col(cell[k, k]))
        known = sum((F.col(cell[k, j]) * F.col(f"c{j}") for j in range(k + 1, size)), F.lit(0.0))
        fits = fits.withColumn(f"c{k}", F.when(F.col("n") > size, (F.col(cell[k, size]) - known) / pivot))
    names = [f"c{k}" for k in range(size)]
    fits = fits.select(*by, "n", *names)
    joined = _beside(rows, fits, by, "n", *names)
    gap = F.col("_v") - sum((F.col(c) * F.pow("_at", F.lit(k)) for k, c in enumerate(names)), F.lit(0.0))
    return joined.groupBy(*by, "n", *names).agg(F.sqrt(F.avg(gap * gap)).alias("residual_rms"))


def _rotations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        h = rows[[f"_h{i}{j}" for i in range(3) for j in range(3)]].to_numpy(float).reshape(-1, 3, 3)
        u, s, vt = np.linalg.svd(h)
        turn = np.linalg.det(u) * np.linalg.det(vt)
        u[:, :, 2] *= np.where(turn < 0, -1.0, 1.0)[:, None]
        fit = np.einsum("nji,nkj->nik", vt, u)
        # A single direction, or none, leaves the turn about it open.
        open_ = (rows["n"].to_numpy() < 2) | (s[:, 1] <= 1e-6 * np.maximum(s[:, 0], 1e-300))
        fit[open_] = np.eye(3)
        out = rows.drop(columns=[c for c in rows if c.startswith("_h")])
        yield out.assign(**{f"r{i}{j}": fit[:, i, j] for i in range(3) for j in range(3)})


def rotation_fit(df: DataFrame, by: Sequence[str], source: Sequence[str], target: Sequence[str]) -> DataFrame:
    """``by``, n, and r00 to r22: the rotation about the origin that best turns the vectors ``source`` into ``target``.

    Nine sums of products a group, then one 3 x 3 decomposition a row. No
    centre is subtracted. Vectors of one direction complete by the cross
    product where two are known; with fewer than two pairs or directions it is
    the identity. Rows with a part that is not finite don't count; a table
    without such rows gives no rows.
    """
    p, q = [F.col(c).cast("double") for c in source], [F.col(c).cast("double") for c in target]
    sound = F.lit(True)
    for c in (*p, *q):
        sound = sound & finite(c)
    sums = df.where(sound).groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(p[i] * q[j]).alias(f"_h{i}{j}") for i in range(3) for j in range(3))).where("n > 0")
    kept = sums.select(*by, "n").schema
    for i in range(3):
        for j in range(3):
            kept = kept.add(f"r{i}{j}", "double")
    return sums.mapInPandas(_rotations, kept)


def ray_cone(df: DataFrame, by: Sequence[str], ray: Sequence[str]) -> DataFrame:
    """``by``, n, the mean direction axis_x, axis_y, axis_z of unit vectors, and half_angle (radians) of the farthest; nulls where they cancel out."""
    parts = [F.col(c).cast("double") for c in ray]
    rows = df.select(*by, *(c.alias(f"_{a}") for a, c in zip("xyz", parts, strict=True))).where(finite(parts[0]) & finite(parts[1]) & finite(parts[2]))
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(f"_{a}").alias(f"_s{a}") for a in "xyz"))
    size = F.sqrt(sum((F.col(f"_s{a}") * F.col(f"_s{a}") for a in "xyz"), F.lit(0.0)))
    axes = sums.select(*by, "n", *((F.col(f"_s{a}") / F.nullif(size, F.lit(0.0))).alias(f"axis_{a}") for a in "xyz"))
    joined = _beside(rows, axes, by, "n", "axis_x", "axis_y", "axis_z")
    along = sum((F.col(f"_{a}") * F.col(f"axis_{a}") for a in "xyz"), F.lit(0.0))
    return joined.groupBy(*by, "n", "axis_x", "axis_y", "axis_z").agg(F.max(F.acos(F.when(along.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), along))))).alias("half_angle"))


def epoch_table(df: DataFrame, camera: str, projector: str, u: str, v: str) -> DataFrame:
    """camera, projector, n, epoch_u, epoch_v: mean times of a pair less its camera's mean time, and ``spread`` of the camera's epochs.

    A null time counts as 0; rows without a camera or a projector don't count.
    """
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    known = df.where(F.col(camera).isNotNull() & F.col(projector).isNotNull())
    pairs = known.groupBy(F.col(camera).alias("camera"), F.col(projector).alias("projector")).agg(F.count("*").alias("n"), F.sum(zero(u)).alias("_u"), F.sum(zero(v)).alias("_v"))
    mine = Window.partitionBy("camera")  # a row a projector
    mean = F.sum(F.col("_u") + F.col("_v")).over(mine) / (2 * F.sum("n").over(mine))
    found = pairs.select("camera", "projector", "n", (F.col("_u") / F.col("n") - mean).alias("epoch_u"), (F.col("_v") / F.col("n") - mean).alias("epoch_v"))
    return found.withColumn("spread", F.max(F.greatest("epoch_u", "epoch_v")).over(mine) - F.min(F.least("epoch_u", "epoch_v")).over(mine))


def mesh_bounds(vertices: DataFrame, corners: DataFrame, mesh: str, index: str) -> DataFrame:
    """mesh, min_x to max_z, centre_x to centre_z, radius from the centre and origin_radius.

    vertices: (mesh, index, x, y, z); corners: (mesh, index), the vertices
    that triangles use. Of a mesh with corners only those vertices count; of
    one without any, all. A mesh without vertices gives no row.
    """
    used = corners.select(F.col(mesh).alias("_um"), F.col(index).alias("_ui")).distinct()
    meshes = corners.select(F.col(mesh).alias("_hm")).distinct()
    bare = vertices.join(meshes, F.col(mesh) == F.col("_hm"), "left_anti")
    points = vertices.join(used, (F.col(mesh) == F.col("_um")) & (F.col(index) == F.col("_ui")), "left_semi").union(bare)
    box = points.groupBy(mesh).agg(*(f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in "xyz"))
    box = box.withColumns({f"centre_{a}": 0.5 * (F.col(f"min_{a}") + F.col(f"max_{a}")) for a in "xyz"})
    joined = _beside(points, box, [mesh], *box.columns[1:])
    off = lambda centre: F.sqrt(F.max(sum(((F.col(a) - centre(a)) * (F.col(a) - centre(a)) for a in "xyz"), F.lit(0.0))))
    return joined.groupBy(mesh, *box.columns[1:]).agg(off(lambda a: F.col(f"centre_{a}")).alias("radius"), off(lambda a: F.lit(0.0)).alias("origin_radius"))


def pixel_regions(pixels: DataFrame, image: str, width: int, height: int) -> DataFrame:
    """image, seed (the least y * width + x), area, touches_border, min_x, max_x, min_y, max_y and fill of each 8-connected region.

    pixels: (image, x, y), the lit ones; repeated ones count once, and those
    outside the frame or with a null don't count. Neighbours are found by
    a join on their places, so no image is gathered.
    """
    lit = pixels.select(F.col(image).alias("image"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    lit = lit.where(F.col("image").isNotNull() & F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).distinct()
    at = F.struct("image", (F.col("y").cast("long") * width + F.col("x")).alias("at"))
    nodes = lit.withColumn("id", at)
    # Half of the eight neighbours: an edge is found from one of its ends.
    ahead = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 1), (0, 1), (1, 1)))))
    moves = nodes.withColumn("_d", ahead).select(F.col("id").alias("src"), F.col("image").alias("_i"), (F.col("x") + F.col("_d.dx")).alias("_x"), (F.col("y") + F.col("_d.dy")).alias("_y"))
    there = nodes.select(F.col("id").alias("dst"), "image", "x", "y")
    edges = moves.join(there, (F.col("_i") == F.col("image")) & (F.col("_x") == F.col("x")) & (F.col("_y") == F.col("y"))).select("src", "dst")
    parts = connected_components(nodes.select("id"), edges)
    x, y = F.col("id.at") % width, F.floor(F.col("id.at") / width)
    border = (x == 0) | (y == 0) | (x == width - 1) | (y == height - 1)
    sizes = parts.groupBy("component").agg(F.count("*").alias("area"), F.bool_or(border).alias("touches_border"), F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"))
    box = (F.col("max_x") - F.col("min_x") + 1) * (F.col("max_y") - F.col("min_y") + 1)
    return sizes.select(F.col("component.image").alias("image"), F.col("component.at").alias("seed"), *sizes.columns[1:], (F.col("area") / box).alias("fill"))
