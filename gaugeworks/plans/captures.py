"""Queries over alignment and settings files, phase noise, complementary frames and welded meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import noise
from ..sources import alignments
from .registry import query, rounded, t

# Alignments: a file for each supplier, with a grid of 4 or 9 vertices; some are broken


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    n = F.when(k % 2 == 0, 4).otherwise(9)
    vertices = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.when((k % 10 == 3) & (i == 2), 1).otherwise(i).cast("string"), F.lit("  "), (i * 0.25).cast("string"), F.lit("\t-"), (i * 0.5).cast("string")))
    head = F.concat(F.lit("# made\r\n"), F.when(k % 10 == 5, "").otherwise("Translate 0.5 1.5\n"), F.when(k % 10 == 7, "scale 1\n").otherwise("scale 1 2e0\n"), F.lit("rotate "), k.cast("string"), F.lit("\nnote this\n\n"))
    return t(spark, sf_dir, "supplier").select(F.col("s_suppkey"), F.concat(head, F.array_join(vertices, "\n")).alias("body"))


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 10 <> 5 THEN 0.5::DOUBLE END AS translate_x, CASE WHEN s_suppkey % 10 <> 7 THEN 2.0::DOUBLE END AS scale_y, s_suppkey::DOUBLE AS rotate, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 3 END AS side, 1 AS unrecognised,
  CASE s_suppkey % 10 WHEN 5 THEN 'translate' WHEN 7 THEN 'malformed' WHEN 3 THEN 'duplicate' END AS problem FROM supplier""")
def alignment_files(spark, sf_dir):
    found = alignments.parse_alignments(_files(spark, sf_dir), "s_suppkey", "body")
    return found.select("s_suppkey", "translate_x", "scale_y", "rotate", "side", F.size("unrecognised").alias("unrecognised"), "problem")


@query("""
SELECT s_suppkey, CAST(i AS INTEGER) AS index, round(i * 0.25 - (2.0 * ((i - 1) % side) / (side - 1) - 1), 6)::DOUBLE AS dx, round(-i * 0.5 + (2.0 * ((i - 1) // side) / (side - 1) - 1), 6)::DOUBLE AS dy
FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 3 END AS side FROM supplier WHERE s_suppkey % 10 NOT IN (3, 5, 7)), range(1, 10) r(i) WHERE i <= side * side""")
def alignment_shifts(spark, sf_dir):
    return rounded(alignments.vertex_shifts(alignments.parse_alignments(_files(spark, sf_dir), "s_suppkey", "body"), "s_suppkey"), 6, "dx", "dy")


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN s_acctbal END AS radius, 34.5::DOUBLE AS radius_default, CASE WHEN s_suppkey % 3 > 0 THEN (s_suppkey % 50)::DOUBLE END AS height, NULL::DOUBLE AS height_default FROM supplier""")
def settings_geometry(spark, sf_dir):
    """Settings as JSON maps; some radii are words, some heights are missing."""
    k = F.col("s_suppkey")
    radius = F.when(k % 4 > 0, F.col("s_acctbal").cast("string")).otherwise('"unset"')
    height = F.when(k % 3 > 0, F.concat(F.lit(', "height": {"envName": "BALL_HEIGHT", "value": '), (k % 50).cast("string"), F.lit("}"))).otherwise("")
    body = F.concat(F.lit('{"Radius ": {"value": '), radius, F.lit(', "envName": "ball_radius", "description": "Default Value: <br> 34.5 in"}'), height, F.lit(', "bare": {"envName": "X"}}'))
    files = t(spark, sf_dir, "supplier").select("s_suppkey", body.alias("body"))
    return alignments.settings_geometry(alignments.parse_settings(files, "s_suppkey", "body"), {"radius": "BALL_RADIUS", "height": "BALL_HEIGHT"}, "s_suppkey")


# Phase noise: the residual of a part's price about four even steps of one period

_NOISE = """
WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_discount * 100 AS b, l_tax * 100 AS c, l_linenumber::DOUBLE AS d FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, round((a + b + c + d) / 4, 6) AS level, round(abs(a - b + c - d) / 2, 6) AS residual FROM v),
o AS (SELECT *, row_number() OVER (ORDER BY level, residual, l_orderkey, l_linenumber) - 1 AS place, count(*) OVER () AS n FROM r), u AS (SELECT *, least(12, n // 64) AS bins FROM o),
b AS (SELECT *, CAST(ceil((place + 1) * bins / n) - 1 AS INTEGER) AS bin FROM u),
k AS (SELECT bin, level, residual, row_number() OVER (PARTITION BY bin ORDER BY place) - 1 AS i, row_number() OVER (PARTITION BY bin ORDER BY residual) - 1 AS j, count(*) OVER (PARTITION BY bin) AS n FROM b),
m AS (SELECT bin, n, max(level) FILTER (i = n // 2) AS level, greatest(max(residual) FILTER (j = n // 2) / 0.674489750196082::DOUBLE, 0.5) AS sigma FROM k GROUP BY ALL)
"""


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    level, residual = noise.phase_residual([F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_linenumber")])
    return rounded(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", level.alias("level"), residual.alias("residual")), 6, "level", "residual")


@query(_NOISE + "SELECT bin, n, round(level, 4) AS level, round(sigma, 4) AS sigma FROM m")
def phase_noise(spark, sf_dir):
    found = noise.phase_noise(_residuals(spark, sf_dir), "level", "residual", ["l_orderkey", "l_linenumber"], 4, 12, 0.5)
    return rounded(found, 4, "level", "sigma")


@query("""
WITH m(level, sigma) AS (VALUES (10.0::DOUBLE, 1.0::DOUBLE), (20.0, 3.0), (40.0, 2.0))
SELECT p_partkey, round(CASE WHEN p_size <= 10 THEN 1.0 WHEN p_size >= 40 THEN 2.0 WHEN p_size < 20 THEN 1 + (p_size - 10) * 0.2::DOUBLE ELSE 3 - (p_size - 20) * 0.05::DOUBLE END, 6) AS noise FROM part""")
def noise_lookup(spark, sf_dir):
    model = spark.createDataFrame([(20.0, 3.0), (40.0, 2.0), (10.0, 1.0)], "level double, sigma double")
    return rounded(noise.noise_at(t(spark, sf_dir, "part").select("p_partkey", "p_size"), model, "p_size").select("p_partkey", "noise"), 6, "noise")


@query("""
WITH b AS (SELECT l_orderkey AS frame, l_quantity AS w, l_tax * 100 AS k, l_quantity * l_discount * 10 AS a, CASE WHEN l_linenumber <> 3 THEN l_quantity * (1 - l_discount * 10) + l_tax * 90 END AS c FROM lineitem),
p AS (SELECT *, CASE WHEN c IS NOT NULL THEN w - k END AS m FROM b), q AS (SELECT *, max(m) OVER (PARTITION BY frame) AS peak FROM p)
SELECT frame, count(*) FILTER (peak > 0 AND m >= 0.1::DOUBLE * peak) AS blocks, round(sum(abs(a + c - w - k)) FILTER (peak > 0 AND m >= 0.1::DOUBLE * peak) / sum(m) FILTER (peak > 0 AND m >= 0.1::DOUBLE * peak) + 1e-7, 5) AS residual FROM q GROUP BY 1""")
def complement_residual(spark, sf_dir):
    c = F.col
    rows = t(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("frame"), c("l_quantity").alias("w"), (c("l_tax") * 100).alias("k"), (c("l_quantity") * c("l_discount") * 10).alias("a"), F.when(c("l_linenumber") != 3, c("l_quantity") * (1 - c("l_discount") * 10) + c("l_tax") * 90).alias("c"))
    found = noise.complement_residual(rows, ["frame"], "a", "c", "w", "k")
    return rounded(found.withColumn("residual", F.col("residual") + 1e-7), 5, "residual")  # inputs are hundredths, so exact halves occur


@query("""
WITH v AS (SELECT c_nationkey AS mesh, c_custkey AS i, CAST(c_custkey % 6 AS DOUBLE) AS x, CAST(c_custkey // 7 % 4 AS DOUBLE) AS y, 0.0::DOUBLE AS z FROM customer),
n AS (SELECT *, min(i) OVER (PARTITION BY mesh, x, y, z) AS node FROM v),
o AS (SELECT mesh, i AS a, lead(i) OVER w AS b, lead(i, 2) OVER w AS c FROM v WINDOW w AS (PARTITION BY mesh ORDER BY i)), tri AS (SELECT * FROM o WHERE c IS NOT NULL AND a % 3 = 0),
e AS (SELECT mesh, a AS p, b AS q FROM tri UNION SELECT mesh, b, c FROM tri UNION SELECT mesh, c, a FROM tri UNION SELECT mesh, b, a FROM tri UNION SELECT mesh, c, b FROM tri UNION SELECT mesh, a, c FROM tri)
SELECT DISTINCT e.mesh, s.node AS src, d.node AS dst, round(sqrt(pow(s.x - d.x, 2) + pow(s.y - d.y, 2)), 6) AS length FROM e JOIN n s ON s.mesh = e.mesh AND s.i = p JOIN n d ON d.mesh = e.mesh AND d.i = q WHERE s.node <> d.node""")
def mesh_edges(spark, sf_dir):
    k = F.col("c_custkey")
    vertices = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("mesh"), k.alias("i"), (k % 6).alias("x"), (F.floor(k / 7) % 4).alias("y"), F.lit(0.0).alias("z"))
    w = Window.partitionBy("mesh").orderBy("i")
    triangles = vertices.select("mesh", F.col("i").alias("a"), F.lead("i").over(w).alias("b"), F.lead("i", 2).over(w).alias("c")).where("c IS NOT NULL AND a % 3 = 0")
    return rounded(noise.mesh_edges(vertices, triangles, "mesh", "i", 1e-6), 6, "length")
