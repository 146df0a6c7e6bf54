"""Iterative graph operators; each round is written and read again, so lineage stays short and lost executors cost one round."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, drop
from .noise import side_lengths, weld, welded_sides


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each node (id) reaches over edges (src, dst), by spreading and pointer jumping."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct())
    labels = cut(nodes.select("id", F.col("id").alias("component")).distinct())
    while True:
        near = both.join(labels, both["src"] == labels["id"]).groupBy("dst").agg(F.min("component").alias("near"))
        one = labels.join(near, labels["id"] == near["dst"], "left").select("id", F.least("component", F.coalesce("near", "component")).alias("mid"), F.col("component").alias("was"))
        jump = one.select(F.col("id").alias("mid"), F.col("mid").alias("far"))
        after = cut(one.join(jump, "mid", "left").select("id", F.least("mid", F.coalesce("far", "mid")).alias("component"), "was"))
        changed = after.where("component <> was").limit(1).count()
        drop(labels)
        labels = after
        if not changed:
            drop(both)
            return labels.drop("was")


def _relaxed(bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What the edges of one block make of the distances in it: (number, found, open) of each node that comes nearer.

    ``open`` are those whose edges are not all here.
    """

    def follow(edges: pa.Table, near: pa.Table) -> pa.Table:
        if not near.num_rows or not edges.num_rows:
            return pa.table({"number": pa.array([], pa.int64()), "found": pa.array([], pa.float64()), "open": pa.array([], pa.bool_())})
        size, base = 1 << bits, near["block"][0].as_py() << bits
        src, dst, length = (edges[c].to_numpy() for c in ("src", "dst", "length"))
        order = np.argsort(src, kind="stable")
        src, dst, length = src[order] - base, dst[order], length[order]
        inside = (dst >> bits) == (base >> bits)
        outer, places = np.unique(dst[~inside], return_inverse=True)
        to = np.empty(len(dst), np.int64)
        to[inside], to[~inside] = dst[inside] - base, size + places
        start = np.searchsorted(src, np.arange(size + 1))
        # A NaN is the greatest distance, as in Spark; nodes not reached have none.
        far, reached, moved = np.full(size + len(outer), np.nan), np.zeros(size + len(outer), bool), np.zeros(size + len(outer), bool)
        at = near["number"].to_numpy() - base
        far[at], reached[at] = near["distance"].to_numpy(), True
        front = at[near["fell"].to_numpy()]
        while len(front):
            count = start[front + 1] - start[front]
            edge = np.repeat(start[front] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            ends, found = to[edge], np.repeat(far[front], count) + length[edge]
            order = np.lexsort((found, ends))
            ends, found = ends[order], found[order]
            least = np.append(True, ends[1:] != ends[:-1])[: len(ends)]
            ends, found = ends[least], found[least]
            nearer = ~reached[ends] | (found < far[ends]) | (np.isnan(far[ends]) & ~np.isnan(found))
            ends, found = ends[nearer], found[nearer]
            far[ends], reached[ends], moved[ends] = found, True, True
            front = ends[ends < size]
        at = np.flatnonzero(moved)
        nodes = np.concatenate([np.arange(size) + base, outer])[at]
        return pa.table({"number": nodes, "found": far[at], "open": (at >= size) | (not near["alone"][0].as_py())})

    return follow


def _numbered(ids: DataFrame, *by: str) -> DataFrame:
    """Rows of ``ids``, written, with a number each in the order of ``by``: near ids are near numbers."""
    return cut(ids.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("number", F.monotonically_increasing_id()))


def _far(lines: DataFrame, roots: DataFrame, block_bits: int, piece_edges: int) -> DataFrame:
    """(number, distance) of what roots (number) reach over lines (src, dst, length) between numbers, written; ``lines`` must be."""
    c = F.col
    block = lambda n: F.shiftright(n, block_bits)
    best = cut(roots.select("number", F.lit(0.0).alias("distance"), F.lit(True).alias("fell")))
    pieces = cut(lines.groupBy(block("src").alias("block")).agg(F.ceil(F.count("*") / piece_edges).alias("pieces")))  # a row a block
    while best.where("fell").limit(1).count():
        active = F.broadcast(best.where("fell").select(block("number").alias("block")).distinct().join(pieces, "block"))
        work = lines.withColumn("block", block("src")).join(active, "block").select(c("block").alias("block"), F.pmod(F.xxhash64("dst"), "pieces").alias("piece"), "src", "dst", "length")
        every = F.explode(F.sequence(F.lit(0).cast("long"), c("pieces") - 1)).alias("piece")
        near = best.withColumn("block", block("number")).join(active, "block").select(c("block").alias("block"), every, "number", "distance", "fell", (c("pieces") == 1).alias("alone"))
        found = work.groupBy("block", "piece").cogroup(near.groupBy("block", "piece")).applyInArrow(_relaxed(block_bits), "number long, found double, open boolean")
        step = found.groupBy("number").agg(F.min(F.struct("found", "open")).alias("s")).select("number", "s.found", "s.open")
        fell = c("found").isNotNull() & (c("distance").isNull() | (c("found") < c("distance")))
        both = best.select("number", "distance").join(step, "number", "full_outer")
        after = cut(both.select("number", F.when(fell, c("found")).otherwise(c("distance")).alias("distance"), (fell & c("open")).alias("fell")))
        drop(best)
        best = after
    drop(pieces)
    return best.select("number", "distance")


def shortest_paths(edges: DataFrame, sources: DataFrame, block_bits: int = 15, piece_edges: int = 1 << 20) -> DataFrame:
    """(id, distance): the least sum of lengths from any source (id) over directed edges (src, dst, length), none of them negative.

    Nodes are numbered in the order of their ids, and 2^block_bits numbers that follow each other are a block. A round
    follows fallen distances inside each block to their end and one edge out of it, so it gets at least one edge
    further, and across a block where near ids are near. Of a block with more than ``piece_edges`` edges, pieces are
    followed apart. Nodes that no source reaches aren't there; neither are edges with a null end or length. Ids may be structs.
    """
    known = cut(edges.where("src IS NOT NULL AND dst IS NOT NULL AND length IS NOT NULL").groupBy("src", "dst").agg(F.min(F.col("length").cast("double")).alias("length")))
    roots = cut(sources.where("id IS NOT NULL").select("id").distinct())
    # What is neither a source nor led to is never reached: edges from there are dropped.
    nodes = _numbered(roots.union(known.select("dst")).distinct(), "id")
    end = lambda e: nodes.select(F.col("id").alias(e), F.col("number").alias(f"_{e}"))
    lines = cut(known.join(end("src"), "src").join(end("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "length"))
    drop(known)
    best = _far(lines, roots.join(nodes, "id"), block_bits, piece_edges)
    far = cut(best.join(nodes, "number").select("id", "distance"))
    for spent in (roots, lines, nodes, best):
        drop(spent)
    return far


def boundary_distances(vertices: DataFrame, triangles: DataFrame, mesh: str, index: str, grid: float, block_bits: int = 15, piece_edges: int = 1 << 20) -> DataFrame:
    """(mesh, node, distance): how far each welded node of a mesh is from its boundary, along edges as by ``shortest_paths``.

    vertices: (mesh, index, x, y, z); triangles: (mesh, a, b, c). The boundary is
    the edges that one triangle alone has. Nodes of a closed mesh, and of parts without boundary, aren't there.
    """
    welded = cut(weld(vertices, mesh, index, grid))
    nodes = _numbered(welded.select("mesh", "node").distinct(), "mesh", "node")
    # Vertices become numbers at once, so edges are never joined to their nodes' names.
    sides = cut(welded_sides(welded.join(nodes, ["mesh", "node"]).select("mesh", "index", F.col("number").alias("node")), triangles, mesh))
    own = vertices.select(F.col(mesh).alias("mesh"), F.col(index).alias("node"), "x", "y", "z")
    places = own.join(nodes, ["mesh", "node"]).select("mesh", F.col("number").alias("node"), "x", "y", "z")
    lines = cut(side_lengths(sides, places).where("length IS NOT NULL").select("src", "dst", "length"))
    roots = sides.where("triangles = 1").select(F.explode(F.array("src", "dst")).alias("number")).distinct()
    best = _far(lines, roots, block_bits, piece_edges)
    far = cut(best.join(nodes, "number").select("mesh", "node", "distance"))
    for spent in (welded, sides, lines, nodes, best):
        drop(spent)
    return far
