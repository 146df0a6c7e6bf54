"""Queries over whole camera positions: a folder of photographs for each supplier, with a fault by its number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.folders import PositionPlan, index_position, position_projectors
from .registry import query, rounded, t

# By supplier % 6: 0 a clean position of four projectors; 1 the third is out of view; 2 a plane of the second stands in its complement's
# place; 3 the second is shot again at the end; 4 one run is missing; 5 dark photographs at both ends.

_PLAN = PositionPlan(("white", "black", *["patterned"] * 8), 4, ((2, 3), (4, 5)), ((6, 7, 8, 9),), 4)


def _light(p: Column, b: Column) -> tuple[Column, Column]:
    """Whether projector p lights block b of a grid of 4 x 4, and the block's place among those it lights."""
    row, column = F.floor(b / 4), b % 4
    lit = F.when(p == 0, b < 8).when(p == 1, b >= 8).when(p == 2, column < 2).when(p == 3, column >= 2).otherwise(False)
    return lit, F.when(p < 2, b % 8).otherwise(row * 2 + column % 2)


def _photographs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    kind = s % 6
    run = lambda p: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(p.alias("p"), i.alias("k")))
    dark = lambda n: F.array_repeat(F.struct(F.lit(-1).alias("p"), F.lit(0).alias("k")), n)
    none = dark(F.lit(0))
    second = F.transform(run(F.lit(1)), lambda x: F.struct(x["p"].alias("p"), F.when((kind == 2) & (x["k"] == 5), 4).otherwise(x["k"]).alias("k")))
    shots = F.concat(
        F.when(kind == 5, dark(F.lit(3))).otherwise(none), run(F.lit(0)), second, F.when(kind == 1, dark(F.lit(10))).otherwise(run(F.lit(2))), F.when(kind == 4, none).otherwise(run(F.lit(3))),
        F.when(kind == 5, dark(F.lit(2))).when(kind == 3, F.concat(dark(F.lit(4)), run(F.lit(1)))).otherwise(none),
    )
    rows = t(spark, sf_dir, "supplier").select(s, (0.3 + s % 50 / 100).alias("range"), F.posexplode(shots).alias("i", "shot"))
    k = F.col("shot.k")

    def value(b: Column) -> Column:
        lit, i = _light(F.col("shot.p"), b)
        steps = 0.5 + 0.5 * F.cos(F.pi() / 4 * i - F.pi() / 2 * (k - 6))
        part = F.when(k == 0, 1.0).when(k == 1, 0.0).when(k == 2, (i < 4).cast("double")).when(k == 3, (i >= 4).cast("double")).when(k == 4, (i % 2).cast("double")).when(k == 5, (1 - i % 2).cast("double")).otherwise(steps)
        return 0.05 + F.when(lit, F.col("range") * part).otherwise(0.0)

    blocks = F.sequence(F.lit(0), F.lit(15))
    return rows.select("s_suppkey", "i", F.lit(4).alias("blocks"), F.transform(blocks, value).alias("values"), F.array_repeat(F.lit(True), 16).alias("measured"))


@query("""
WITH f AS (SELECT s_suppkey, s_suppkey % 6 AS kind, i FROM supplier, range(0, 54) r(i) WHERE i < CASE s_suppkey % 6 WHEN 3 THEN 54 WHEN 4 THEN 30 WHEN 5 THEN 45 ELSE 40 END),
g AS (SELECT *, CASE WHEN kind = 5 THEN i - 3 WHEN kind = 3 AND i >= 44 THEN i - 34 ELSE i END AS x FROM f),
h AS (SELECT *, CASE WHEN kind = 4 THEN 'few' WHEN x < 0 OR x >= 40 OR kind = 1 AND x // 10 = 2 THEN 'outside' WHEN kind = 2 AND x // 10 = 1 THEN 'pair' WHEN kind = 3 AND i // 10 = 1 THEN 'replaced' END AS problem FROM g)
SELECT s_suppkey, CAST(i AS INTEGER) AS i, CAST(CASE WHEN problem IS NULL THEN x // 10 END AS INTEGER) AS projector, CAST(CASE WHEN problem IS NULL THEN x % 10 END AS INTEGER) AS place, problem, CASE WHEN problem = 'pair' THEN 1.0::DOUBLE END AS residual FROM h""")
def position_index(spark, sf_dir):
    return rounded(index_position(_photographs(spark, sf_dir), ["s_suppkey"], "i", _PLAN), 6, "residual")


@query("""
SELECT s_suppkey, CAST(p AS INTEGER) AS projector, CASE WHEN s_suppkey % 6 = 1 AND p = 2 THEN 'unseen' WHEN s_suppkey % 6 = 2 AND p = 1 THEN 'pair' ELSE 'used' END AS status FROM supplier, range(0, 4) r(p) WHERE s_suppkey % 6 <> 4""")
def position_status(spark, sf_dir):
    return position_projectors(_photographs(spark, sf_dir), ["s_suppkey"], "i", _PLAN)
