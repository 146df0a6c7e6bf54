"""Queries over sweeps, their sensitivities, ranks and interactions, and over photographs made linear."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sweeps
from .registry import query, rounded, t


@query("""
WITH p AS (SELECT p_partkey, p_size / 10.0::DOUBLE AS a, CASE WHEN p_partkey % 3 = 0 THEN p_size / 10.0::DOUBLE + 8 ELSE p_size / 10.0::DOUBLE * 3 END AS b, CASE p_partkey % 4 WHEN 0 THEN p_size / 10.0::DOUBLE WHEN 1 THEN p_size / 10.0::DOUBLE + 1 WHEN 2 THEN 99.0::DOUBLE END AS n FROM part),
l AS (SELECT p_partkey, a, b, n, CASE WHEN i = 0 THEN a WHEN i = 8 THEN b WHEN b >= 4 * a THEN exp(ln(a) + i / 8.0::DOUBLE * (ln(b) - ln(a))) ELSE a + i / 8.0::DOUBLE * (b - a) END AS v FROM p, range(9) r(i)),
s AS (SELECT p_partkey, CASE WHEN abs(v - n) <= (b - a) * 1e-9::DOUBLE THEN n ELSE v END AS v, abs(v - n) <= (b - a) * 1e-9::DOUBLE AS near FROM l),
u AS (SELECT p_partkey, v FROM s UNION ALL SELECT p_partkey, n FROM p WHERE p_partkey NOT IN (SELECT p_partkey FROM s WHERE near))
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY v) AS INTEGER) AS place, round(v, 6) AS level FROM u WHERE p_partkey % 4 < 3""")
def sweep_levels(spark, sf_dir):
    k, a = F.col("p_partkey"), F.col("p_size") / 10.0
    greatest = F.when(k % 3 == 0, a + 8).otherwise(a * 3)
    nominal = F.when(k % 4 == 0, a).when(k % 4 == 1, a + 1).when(k % 4 == 2, 99.0)  # a quarter has none
    levels = t(spark, sf_dir, "part").select("p_partkey", F.posexplode(sweeps.sweep_levels(a, greatest, nominal)).alias("place", "level"))
    return rounded(levels.select("p_partkey", (F.col("place") + 1).alias("place"), "level"), 6, "level")


# A supplier is a constant, the quantity its level, the return flag a response

_SWEEPS = """
WITH g(response, gate, scored) AS (VALUES ('A', 60007.0::DOUBLE, true), ('N', NULL, false), ('R', 90007.0, true)),
q AS (SELECT s_suppkey AS parameter, s_suppkey % 50 + 1.0::DOUBLE AS nominal, 1.0::DOUBLE AS least, s_suppkey % 40 + 1.0::DOUBLE AS greatest, CASE WHEN s_suppkey % 3 = 0 THEN 'stated' ELSE 'inferred' END AS source FROM supplier WHERE s_suppkey % 10 > 0),
l AS (SELECT l_suppkey AS parameter, l_returnflag AS response, l_quantity::DOUBLE AS level, max(CASE WHEN l_quantity < 49 THEN l_extendedprice::DOUBLE END) AS v FROM lineitem GROUP BY ALL),
w AS (SELECT l.*, gate, scored, nominal, v - lag(v) OVER (PARTITION BY parameter, response ORDER BY level) AS step, max(v) OVER (PARTITION BY parameter, response) - min(v) OVER (PARTITION BY parameter, response) AS swing FROM l JOIN g USING (response) JOIN q USING (parameter)),
f AS (SELECT parameter, response, min(v) AS least, max(v) AS greatest, any_value(swing) AS swing, any_value(swing) / any_value(gate) AS over, first(v ORDER BY level) AS at_first, first(v ORDER BY level DESC) AS at_last, max(v) FILTER (level = nominal) AS at_nominal,
  NOT (coalesce(bool_or(step > 0 AND abs(step) >= swing * 1e-3::DOUBLE), false) AND coalesce(bool_or(step < 0 AND abs(step) >= swing * 1e-3::DOUBLE), false)) AS monotone, min(level) FILTER (v > gate) AS crossing, any_value(scored) AS scored FROM w GROUP BY parameter, response)
"""


def _parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return t(spark, sf_dir, "supplier").where(k % 10 > 0).select(k.alias("parameter"), (k % 50 + 1.0).alias("nominal"), F.lit(1.0).alias("least"), (k % 40 + 1.0).alias("greatest"), F.when(k % 3 == 0, "stated").otherwise("inferred").alias("source"))


def _sensitivities(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("parameter"), F.col("l_returnflag").alias("response"), F.col("l_quantity").alias("level"), F.when(F.col("l_quantity") < 49, F.col("l_extendedprice")).alias("value"))
    responses = spark.createDataFrame([("A", 60007.0, True), ("N", None, False), ("R", 90007.0, True)], "response string, gate double, scored boolean")
    return sweeps.sensitivities(points, _parameters(spark, sf_dir), responses)


@query(_SWEEPS + "SELECT parameter, response, least, greatest, round(swing, 4) AS swing, round(over, 6) AS swing_over_gate, at_first, at_last, at_nominal, monotone, crossing, scored FROM f")
def sweep_sensitivities(spark, sf_dir):
    return rounded(rounded(_sensitivities(spark, sf_dir), 4, "swing"), 6, "swing_over_gate")


@query(_SWEEPS + """,
b AS (SELECT parameter, max(CASE WHEN scored AND over > 0 THEN over END) AS score, bool_or(crossing IS NOT NULL) AS flips FROM f GROUP BY parameter),
r AS (SELECT q.*, coalesce(score, 0) AS score, (SELECT min(response) FROM f WHERE f.parameter = q.parameter AND f.scored AND f.over = b.score) AS score_response, coalesce(flips, false) AS flips FROM q LEFT JOIN b USING (parameter))
SELECT parameter, nominal, least, greatest, source, round(score, 6) AS score, score_response, round(score / nullif(greatest - least, 0), 6) AS per_range, flips, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, parameter) AS INTEGER) AS rank FROM r""")
def sweep_ranking(spark, sf_dir):
    return rounded(sweeps.rank_parameters(_sensitivities(spark, sf_dir), _parameters(spark, sf_dir), "source"), 6, "score", "per_range")


@query("""
WITH c AS (SELECT o_custkey, max(o_totalprice::DOUBLE) FILTER (NOT a AND NOT b) AS v0, max(o_totalprice::DOUBLE) FILTER (a AND NOT b) AS v1, max(o_totalprice::DOUBLE) FILTER (NOT a AND b) AS v2, max(o_totalprice::DOUBLE) FILTER (a AND b) AS v3
  FROM (SELECT *, o_orderstatus = 'F' AS a, o_orderkey % 2 = 1 AS b FROM orders) GROUP BY o_custkey), m AS (SELECT o_custkey, (v1 + v3 - v0 - v2) / 2 AS a, (v2 + v3 - v0 - v1) / 2 AS b, (v3 - v1 - v2 + v0) / 2 AS i FROM c WHERE v0 + v1 + v2 + v3 IS NOT NULL)
SELECT o_custkey, round(a, 3) + 0.0 AS main_a, round(b, 3) + 0.0 AS main_b, round(i, 3) + 0.0 AS interaction, round(abs(i) / nullif(greatest(abs(a), abs(b)), 0), 6) AS compounding FROM m""")
def sweep_interactions(spark, sf_dir):
    corners = t(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").alias("a"), (F.col("o_orderkey") % 2 == 1).alias("b"), "o_totalprice")
    return rounded(rounded(sweeps.interactions(corners, ["o_custkey"], "a", "b", "o_totalprice"), 3, "main_a", "main_b", "interaction"), 6, "compounding")


_PHOTOS = """
WITH p AS (SELECT l_suppkey AS photo, l_returnflag AS flag, l_quantity::DOUBLE AS x, CASE WHEN l_linenumber < 7 THEN l_linenumber * 5.0::DOUBLE END AS y, l_discount * 500::DOUBLE AS z FROM lineitem),
v AS (SELECT photo, flag, x, y, z, {0} AS lx, {1} AS ly, {2} AS lz FROM p WHERE y IS NOT NULL),
r AS (SELECT photo, flag, count(*) AS pixels, count(*) FILTER (greatest(x, y, z) >= 50) / count(*) AS clipped_high, count(*) FILTER (least(x, y, z) <= 0) / count(*) AS clipped_low, sum(lx + ly + lz) / (3 * count(*)) AS mean, min(least(lx, ly, lz)) AS lo, max(greatest(lx, ly, lz)) AS hi FROM v GROUP BY ALL)
""".format(*(f"CASE WHEN {c} / 50 <= 0.04045::DOUBLE THEN {c} / 50 / 12.92::DOUBLE ELSE pow(({c} / 50 + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END" for c in "xyz"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("photo"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("r"), F.when(F.col("l_linenumber") < 7, F.col("l_linenumber") * 5).alias("g"), (F.col("l_discount") * 500).alias("b"))
    return sweeps.exposure_reports(pixels, ["photo", "flag"], ["r", "g", "b"], 50, "srgb")


@query(_PHOTOS + "SELECT photo, flag, pixels, round(clipped_high, 6) AS clipped_high, round(clipped_low, 6) AS clipped_low, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi FROM r")
def exposure_reports(spark, sf_dir):
    return rounded(_reports(spark, sf_dir), 6, "clipped_high", "clipped_low", "mean", "lo", "hi")


@query(_PHOTOS + """, m AS (SELECT photo, max(mean) FILTER (flag = 'R' AND photo % 9 > 0) - max(mean) FILTER (flag = 'A') AS d FROM r GROUP BY photo)
SELECT photo, round(d, 5) + 0.0 AS light_range, coalesce(d > 0, false) AS usable, CASE WHEN d IS NULL THEN 'missing' WHEN d <= 0 THEN 'not-brighter' END AS problem FROM m""")
def reference_ranges(spark, sf_dir):
    role = F.when((F.col("flag") == "R") & (F.col("photo") % 9 > 0), "white").when(F.col("flag") == "A", "black")
    return rounded(sweeps.reference_ranges(_reports(spark, sf_dir).withColumn("role", role), ["photo"], "role"), 5, "light_range")
