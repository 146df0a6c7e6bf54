"""Queries over scenarios, cells and captures in which what is missing counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import scenarios as C
from .registry import query, rounded, t

# Scenarios are customers; each has a metric a nation, with gaps: some nations' customers aren't measurable, some owe values.

_RAN = "s AS (SELECT c_custkey AS scenario, c_custkey % 50 <> 7 AS measurable FROM customer WHERE c_custkey % 101 <> 3)"
_METRICS = """m AS (SELECT c_custkey AS scenario, 'm' || k AS metric, CASE WHEN (c_custkey + k) % 61 = 0 THEN NULL ELSE c_acctbal + 10 * k END AS value, k = 2 AND c_custkey % 83 = 1 AS censored, CASE WHEN c_custkey % 29 = 5 THEN 0 ELSE 9 END AS samples
  FROM customer, range(0, 4) r(k) WHERE (c_custkey + k) % 37 <> 0 OR k = 1)"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("k"))
    c, k = F.col("c_custkey"), F.col("k")
    rows = rows.where(((c + k) % 37 != 0) | (k == 1))
    return rows.select(c.alias("scenario"), F.concat(F.lit("m"), k).alias("metric"), F.when((c + k) % 61 != 0, F.col("c_acctbal") + 10 * k).alias("value"), ((k == 2) & (c % 83 == 1)).alias("censored"), F.when(c % 29 == 5, 0).otherwise(9).alias("samples"))


def _ran(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return t(spark, sf_dir, "customer").where(c % 101 != 3).select(c.alias("scenario"), (c % 50 != 7).alias("measurable"))


@query(f"""
WITH {_RAN}, {_METRICS}, g(gate, metric, lim) AS (VALUES ('g0', 'm0', 9000.0::DOUBLE), ('g1', 'm1', 1e9), ('g2', 'm2', NULL), ('g3', 'm3', 0.0), ('g9', 'none', 1.0)),
j AS (SELECT gate, lim, m.*, value IS NOT NULL AND NOT censored AS real FROM g JOIN m USING (metric) JOIN s USING (scenario) WHERE measurable),
r AS (SELECT gate, count(*) AS seen, count(*) FILTER (samples > 0 AND real) AS scored, count(*) FILTER (samples > 0 AND lim IS NOT NULL AND (NOT real OR value > lim)) AS failed, count(*) FILTER (samples > 0 AND NOT real) AS owing, count(*) FILTER (samples = 0) AS nothing, max(value) FILTER (samples > 0 AND real) AS worst FROM j GROUP BY 1),
n AS (SELECT count(*) FILTER (measurable) AS every, count(*) FILTER (NOT measurable) AS off FROM s),
f AS (SELECT gate, metric, lim AS "limit", coalesce(scored, 0) AS scored, coalesce(failed, 0) AS failed, coalesce(owing, 0) + every - coalesce(seen, 0) AS unmeasured, coalesce(nothing, 0) + off AS not_measurable, worst, (SELECT min(scenario) FROM j WHERE j.gate = g.gate AND real AND samples > 0 AND value = r.worst) AS worst_scenario FROM g LEFT JOIN r USING (gate), n)
SELECT *, CASE WHEN scored = 0 OR unmeasured > 0 THEN 'not-measured' WHEN failed > 0 THEN 'fail' ELSE 'pass' END AS verdict FROM f""")
def gate_summary(spark, sf_dir):
    rules = spark.createDataFrame([("g0", "m0", 9000.0), ("g1", "m1", 1e9), ("g2", "m2", None), ("g3", "m3", 0.0), ("g9", "none", 1.0)], "gate string, metric string, limit double")
    return C.gate_summary(_metrics(spark, sf_dir), rules, _ran(spark, sf_dir))


@query("""
WITH g AS (SELECT n_name AS gate, n_nationkey % 5 = 0 AS provisional FROM nation WHERE n_nationkey % 3 > 0)
SELECT n_nationkey AS key, n_name AS gate, CASE WHEN g.gate IS NULL THEN 'missing' ELSE 'provisional' END AS problem FROM nation LEFT JOIN g ON g.gate = n_name WHERE g.gate IS NULL OR provisional""")
def unscorable_rounds(spark, sf_dir):
    nation, k = t(spark, sf_dir, "nation"), F.col("n_nationkey")
    return C.unscorable(nation.select(k.alias("key"), F.col("n_name").alias("gate")), nation.where(k % 3 > 0).select(F.col("n_name").alias("gate"), (k % 5 == 0).alias("provisional")))


@query(f"""
WITH {_RAN}, {_METRICS}, o AS (SELECT metric, scenario, min(value) AS v FROM m JOIN s USING (scenario) GROUP BY ALL), n AS (SELECT count(*) AS every FROM s)
SELECT metric, count(v) AS n, any_value(every) - count(v) AS missing, round(avg(v), 4) AS mean, min(v) AS min, max(v) AS max, round(stddev_pop(v), 4) AS sd, round(quantile_cont(v, 0.05), 4) AS p05, round(median(v), 4) AS median, round(quantile_cont(v, 0.95), 4) AS p95, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 4) AS iqr FROM o, n GROUP BY 1""")
def scenario_series(spark, sf_dir):
    found = C.scenario_series(_metrics(spark, sf_dir), _ran(spark, sf_dir), "metric", "value")
    return rounded(found, 4, "mean", "sd", "p05", "median", "p95", "iqr")


@query("""
WITH r AS (SELECT l_returnflag, l_linestatus, l_orderkey * 8 + l_linenumber AS seed, l_quantity AS x, CASE WHEN l_partkey % 31 <> 0 THEN l_extendedprice END AS price, CAST(l_tax AS DOUBLE) AS tax, l_partkey % 31 = 0 AS broken, l_suppkey % 17 AS ms FROM lineitem),
u AS (SELECT l_returnflag, l_linestatus, unnest(['price', 'tax']) AS field, unnest([price, tax]) AS v FROM r),
c AS (SELECT l_returnflag, l_linestatus, count(*) AS runs, count(*) FILTER (broken) AS failed, min_by(x, seed) AS x, median(CAST(ms AS DOUBLE)) AS median_seconds FROM r GROUP BY ALL)
SELECT l_returnflag, l_linestatus, field, any_value(runs) AS runs, any_value(failed) AS failed, any_value(x) AS x, any_value(median_seconds) AS median_seconds, count(v) AS n, count(*) - count(v) AS n_non_finite, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd, round(quantile_cont(v, 0.25), 4) AS q1, round(median(v), 4) AS q2, round(quantile_cont(v, 0.75), 4) AS q3
FROM u JOIN c USING (l_returnflag, l_linestatus) GROUP BY ALL""")
def experiment_cells(spark, sf_dir):
    broken = F.col("l_partkey") % 31 == 0
    runs = t(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seed"), F.col("l_quantity").alias("at"), F.when(~broken, F.col("l_extendedprice")).alias("price"), F.col("l_tax").cast("double").alias("tax"), F.when(broken, "lost").alias("error"), (F.col("l_suppkey") % 17).alias("ms"))
    found = C.cells(runs, ["l_returnflag", "l_linestatus"], "seed", "at", ["price", "tax"], "error", "ms")
    return rounded(found, 4, "mean", "sd", "q1", "q2", "q3")


@query("""
WITH m AS (SELECT c_nationkey, c_mktsegment AS level, max(c_acctbal) AS v FROM customer GROUP BY ALL),
w AS (SELECT c_nationkey, max(v) FILTER (level = 'BUILDING') AS b, max(v) FILTER (level = 'MACHINERY') AS p, max(v) FILTER (level = 'HOUSEHOLD') AS q, max(v) FILTER (level = 'AUTOMOBILE') AS a FROM m GROUP BY 1)
SELECT c_nationkey, round(b, 4) AS baseline, round(greatest(0, p - b), 4) AS excess_MACHINERY, round(greatest(0, q - b), 4) AS excess_HOUSEHOLD, round(sqrt(b * b + pow(greatest(0, p - b), 2) + pow(greatest(0, q - b), 2)), 4) AS predicted, round(a, 4) AS measured, round(a / sqrt(b * b + pow(greatest(0, p - b), 2) + pow(greatest(0, q - b), 2)), 6) AS ratio
FROM w WHERE b IS NOT NULL AND p IS NOT NULL AND q IS NOT NULL AND a IS NOT NULL""")
def quadrature_check(spark, sf_dir):
    found = C.quadrature_check(t(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment", "c_acctbal", "BUILDING", ["MACHINERY", "HOUSEHOLD"], "AUTOMOBILE")
    return rounded(rounded(found, 4, "baseline", "excess_MACHINERY", "excess_HOUSEHOLD", "predicted", "measured"), 6, "ratio")


@query("""
WITH s AS (SELECT o_orderpriority AS p, o_custkey AS rig, o_orderkey % 4 = 0 AS twin, o_totalprice AS v, o_orderkey % 9 = 2 AS c FROM orders),
r AS (SELECT p, rig, min(v) FILTER (twin AND NOT c) AS t, count(*) FILTER (NOT twin) AS every, count(*) FILTER (NOT twin AND NOT c) AS n, count(*) FILTER (NOT twin AND NOT c AND v > 200000) AS o FROM s GROUP BY ALL)
SELECT p AS o_orderpriority, CAST(coalesce(sum(o) FILTER (t <= 200000), 0) AS BIGINT) AS flips, CAST(coalesce(sum(n) FILTER (t IS NOT NULL), 0) AS BIGINT) AS "of", min(t) FILTER (every > 0) AS twin_low, max(t) FILTER (every > 0) AS twin_high FROM r GROUP BY 1""")
def gate_flips(spark, sf_dir):
    k = F.col("o_orderkey")
    solves = t(spark, sf_dir, "orders").withColumns({"twin": k % 4 == 0, "censored": k % 9 == 2})
    return C.gate_flips(solves, ["o_orderpriority"], "o_custkey", "twin", "o_totalprice", "censored", 200000.0)


# Pairs of cameras (suppliers) and projectors (parts, by seven) of a capture (a return flag and a month of shipping)

_REASONS = ["dim", "off", "faint"]
_PAIRS = """r AS (SELECT l_returnflag AS flag, month(l_shipdate) AS month, l_suppkey % 6 AS camera, l_partkey % 7 AS projector, l_quantity, l_linenumber AS line FROM lineitem),
p AS (SELECT flag, month, camera, projector, CAST(coalesce(sum(l_quantity) FILTER (line = 1 AND camera <> 5 AND (projector <> month % 7 OR camera = 2) AND (flag <> 'R' OR month > 2)), 0) AS BIGINT) AS accepted, CAST(sum(l_quantity) AS BIGINT) AS considered, count(*) FILTER (line = 2) AS dim, count(*) FILTER (line = 3) AS off, count(*) FILTER (line > 3) // 2 AS faint FROM r GROUP BY ALL),
k AS (SELECT DISTINCT flag, month FROM p), cams AS (SELECT flag, month, camera FROM k, (VALUES (0), (7)) v(camera)), projs AS (SELECT flag, month, projector FROM k, range(0, 8) v(projector)),
ec AS (SELECT flag, month, camera, sum(accepted) AS a FROM (SELECT flag, month, camera, accepted FROM p UNION ALL SELECT *, 0 FROM cams) GROUP BY ALL),
ep AS (SELECT flag, month, projector, count(camera) FILTER (accepted > 0) AS views FROM (SELECT flag, month, projector, camera, accepted FROM p UNION ALL SELECT flag, month, projector, NULL, 0 FROM projs) GROUP BY ALL)"""


def _captures(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.month("l_shipdate").alias("month"), (F.col("l_suppkey") % 6).alias("camera"), (F.col("l_partkey") % 7).alias("projector"), "l_quantity", F.col("l_linenumber").alias("line"))
    line, camera, projector, month = (F.col(c) for c in ("line", "camera", "projector", "month"))
    read = (line == 1) & (camera != 5) & ((projector != month % 7) | (camera == 2)) & ((F.col("flag") != "R") | (month > 2))
    sums = [F.coalesce(F.sum(F.when(read, F.col("l_quantity"))), F.lit(0)).cast("long").alias("accepted"), F.sum("l_quantity").cast("long").alias("considered"), F.count_if(line == 2).alias("dim"), F.count_if(line == 3).alias("off"), F.floor(F.count_if(line > 3) / 2).alias("faint")]
    pairs = rows.groupBy("flag", "month", "camera", "projector").agg(*sums)
    known = rows.select("flag", "month").distinct()
    handed = known.select("flag", "month", F.explode(F.array(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("camera"))
    rig = known.select("flag", "month", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("projector"))
    return {"pairs": pairs, "cameras": handed, "projectors": rig}


@query(f"""
WITH {_PAIRS}, a AS (SELECT flag, month, count(*) AS pairs, CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(considered) AS BIGINT) AS considered, count(*) FILTER (accepted = 0) AS silent_pairs, CAST(sum(dim) AS BIGINT) AS dim, CAST(sum("off") AS BIGINT) AS "off", CAST(sum(faint) AS BIGINT) AS faint FROM p GROUP BY ALL),
c AS (SELECT flag, month, count(*) FILTER (a > 0) AS cameras, count(*) FILTER (a = 0) AS silent_cameras FROM ec GROUP BY ALL), q AS (SELECT flag, month, count(*) AS projectors, count(*) FILTER (views < 2) AS underseen FROM ep GROUP BY ALL),
j AS (SELECT *, greatest(dim, "off", faint) AS most FROM a JOIN c USING (flag, month) JOIN q USING (flag, month)),
v AS (SELECT *, CASE WHEN accepted = 0 THEN 'nothing-decoded' WHEN cameras < 2 THEN 'one-camera' WHEN underseen > 0 THEN 'underseen' END AS refusal FROM j)
SELECT flag, month, pairs, accepted, considered, cameras, silent_cameras, silent_pairs, projectors, underseen, CASE WHEN most = 0 THEN NULL WHEN dim = most THEN 'dim' WHEN "off" = most THEN 'off' ELSE 'faint' END AS dominant, CASE WHEN most > 0 THEN most END AS dominant_count, round(CASE WHEN most > 0 THEN most / (dim + "off" + faint) END, 6) AS dominant_share, refusal, refusal IS NULL AS usable FROM v""")
def capture_worth(spark, sf_dir):
    made = _captures(spark, sf_dir)
    found = C.capture_worth(made["pairs"], ["flag", "month"], "camera", "projector", "accepted", "considered", _REASONS, made["cameras"], made["projectors"])
    return rounded(found, 6, "dominant_share")


@query(f"""
WITH {_PAIRS} SELECT flag, month, 'camera' AS kind, camera, NULL AS projector, CAST(0 AS BIGINT) AS views FROM ec WHERE a = 0 UNION ALL SELECT flag, month, 'pair', camera, projector, 0 FROM p WHERE accepted = 0 UNION ALL SELECT flag, month, 'projector', NULL, projector, views FROM ep WHERE views < 2""")
def capture_silences(spark, sf_dir):
    made = _captures(spark, sf_dir)
    return C.unheard(made["pairs"], ["flag", "month"], "camera", "projector", "accepted", made["cameras"], made["projectors"])


@query("""
WITH d AS (SELECT c_custkey, radians(c_custkey % 180 - 90) AS a, radians(c_custkey % 360) AS b, radians(c_nationkey * 7 % 180 - 90) AS c, radians(c_nationkey * 11) AS e FROM customer)
SELECT c_custkey, round(acos(least(1, greatest(-1, cos(a) * cos(b) * cos(c) * cos(e) + cos(a) * sin(b) * cos(c) * sin(e) + sin(a) * sin(c)))) * 1500, 3) + 0.0 AS mm FROM d""")
def geodesic_gap(spark, sf_dir):
    """How far on a sphere of radius 1.5 m each customer's point is from that of its nation."""
    here = G.direction(F.col("c_custkey") % 180 - 90, F.col("c_custkey") % 360)
    there = G.direction(F.col("c_nationkey") * 7 % 180 - 90, F.col("c_nationkey") * 11)
    return t(spark, sf_dir, "customer").select("c_custkey", (F.round(G.geodesic_mm(here, there, 1.5), 3) + 0.0).alias("mm"))
