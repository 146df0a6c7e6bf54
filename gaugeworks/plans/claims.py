"""Queries over capture plans, settings patches, crossings, clauses, bets and quarters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims
from ..sources import alignments, manifests, patches
from .registry import query, rounded, t

# Capture plans: a file for each supplier, written from a plan; some are edited by hand


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = manifests.plan_text(k % 8 + 1, k % 9 + 4, (k % 8 + 1) * 2, k % 2 == 0, F.lit(1920), F.lit(1080), k % 4 + 1, F.lit(0.5), F.lit("2026"))
    edits = {1: ('"version":1', '"version":2'), 2: (r'"grayBits":\d+', '"grayBits":"4"'), 3: (r'"phaseSteps":\d+,"phasePeriodStrides":\d+', '"phaseSteps":3,"phasePeriodStrides":3'), 4: (r'"framesPerRun":\d+', '"framesPerRun":7'), 5: (r"\}$", ""), 6: (r'"plan":', '"plans":'), 7: (r'"x":1920', '"x":0.5'), 8: (r'"projectors":\d+', '"projectors":4.0')}
    body = F.lit(None).cast("string")
    for at, (old, new) in edits.items():
        body = F.when(k % 20 == at, F.regexp_replace(text, old, new)).otherwise(body)
    body = F.when(k % 20 == 9, F.concat(F.lit("["), text, F.lit("]"))).when(k % 20 == 10, F.lit(None)).otherwise(F.coalesce(body, text))
    return t(spark, sf_dir, "supplier").select("s_suppkey", body.alias("body"))


_PLANS = """
WITH k AS (SELECT s_suppkey, s_suppkey % 20 AS e, s_suppkey % 8 + 1 AS bits, s_suppkey % 9 + 4 AS steps, s_suppkey % 2 = 0 AS wb FROM supplier),
p AS (SELECT *, CASE e WHEN 1 THEN 'version' WHEN 2 THEN 'gray_bits' WHEN 3 THEN 'phase_steps,odd' WHEN 4 THEN 'frames_per_run' WHEN 5 THEN 'not-json' WHEN 6 THEN 'no-plan' WHEN 7 THEN 'projector_res'
  WHEN 9 THEN 'not-object' WHEN 10 THEN 'not-json' ELSE '' END AS problems FROM k)
"""


@query(_PLANS + """
SELECT s_suppkey, CASE WHEN problems = '' THEN bits END AS gray_bits, CASE WHEN problems = '' THEN steps END AS phase_steps, CASE WHEN problems = '' THEN CASE WHEN e = 8 THEN 4 ELSE s_suppkey % 4 + 1 END END AS projectors,
  CASE WHEN problems = '' THEN CASE WHEN wb THEN 2 ELSE 0 END + 4 * bits + 2 * steps END AS frames_per_run, problems FROM p""")
def capture_plans(spark, sf_dir):
    found = manifests.parse_plans(_plans(spark, sf_dir), "s_suppkey", "body")
    return found.select("s_suppkey", "gray_bits", "phase_steps", "projectors", "frames_per_run", F.array_join("problems", ",").alias("problems"))


@query(_PLANS + """,
a(axis, o) AS (VALUES ('u', 0), ('v', 1)), h AS (SELECT *, CASE WHEN wb THEN 2 ELSE 0 END AS base FROM p WHERE problems = '')
SELECT s_suppkey, r AS frame, CASE r WHEN 0 THEN 'white' ELSE 'black' END AS kind, NULL AS axis, 0 AS index, CASE r WHEN 0 THEN 'white' ELSE 'black' END AS seen, NULL::BIGINT AS complement FROM h, range(2) x(r) WHERE wb
UNION ALL SELECT s_suppkey, base + o * 2 * bits + r, CASE r % 2 WHEN 0 THEN 'gray' ELSE 'grayInverse' END, axis, r // 2, 'patterned', base + o * 2 * bits + r + 1 - 2 * (r % 2) FROM h, a, range(16) x(r) WHERE r < 2 * bits
UNION ALL SELECT s_suppkey, base + 4 * bits + o * steps + r, 'phase', axis, r, 'patterned', NULL FROM h, a, range(12) x(r) WHERE r < steps""")
def plan_frames(spark, sf_dir):
    return manifests.plan_frames(manifests.parse_plans(_plans(spark, sf_dir), "s_suppkey", "body"), "s_suppkey")


# Settings: a file for each supplier; its rig stands where the balance says


def _sites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("s_suppkey")
    entry = lambda key, env, value: F.concat(F.lit(f'  "{key}": {{"note": "value: 1", "value": '), value, F.lit(f', "envName": "{env}"}}'))
    parts = F.array(
        entry("Centre", "sphere_height_at_equator_inches", F.when(k % 3 == 0, "40").otherwise("39.37")), entry("First far", "P1_DIST_INCHES", F.when(k % 5 == 0, '"unset"').otherwise("200.0")),
        F.when(k % 4 > 0, entry("First high", "P1_HEIGHT_INCHES", F.lit("51.18"))), entry("Other", "X_INCHES", F.lit("1.5")),
    )
    supplier = t(spark, sf_dir, "supplier")
    documents = supplier.select("s_suppkey", F.concat(F.lit("{\n"), F.array_join(parts, ",\n"), F.lit("\n}\n")).alias("body"))
    rigs = supplier.select("s_suppkey", F.when(k % 7 == 0, "left").otherwise("P1").alias("id"), (k % 10 + 1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.3).alias("z"), F.lit(1.0).alias("centre_height"))
    return documents, rigs


_SITES = """
WITH k AS (SELECT s_suppkey, s_suppkey % 7 = 0 AS odd, floor((s_suppkey % 10 + 1) / 0.0254::DOUBLE * 100 + 0.5) / 100 AS far FROM supplier),
w AS (SELECT s_suppkey, 'SPHERE_HEIGHT_AT_EQUATOR_INCHES' AS env_name, 39.37::DOUBLE AS "to", 'Centre' AS setting, CASE WHEN s_suppkey % 3 = 0 THEN 40.0::DOUBLE ELSE 39.37 END AS "from" FROM k
  UNION ALL SELECT s_suppkey, CASE WHEN odd THEN 'LEFT' ELSE 'P1' END || '_DIST_INCHES', CASE WHEN NOT odd THEN far END, CASE WHEN NOT odd THEN 'First far' END, CASE WHEN NOT odd AND s_suppkey % 5 > 0 THEN 200.0::DOUBLE END FROM k
  UNION ALL SELECT s_suppkey, CASE WHEN odd THEN 'LEFT' ELSE 'P1' END || '_HEIGHT_INCHES', CASE WHEN NOT odd THEN 51.18::DOUBLE END, CASE WHEN NOT odd AND s_suppkey % 4 > 0 THEN 'First high' END, CASE WHEN NOT odd AND s_suppkey % 4 > 0 THEN 51.18::DOUBLE END FROM k),
s AS (SELECT *, CASE WHEN setting IS NULL OR "to" IS NULL THEN 'missing' WHEN "from" = "to" THEN 'same' ELSE 'changed' END AS state FROM w)
"""


def _patch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents, rigs = _sites(spark, sf_dir)
    return documents, patches.settings_patch(alignments.parse_settings(documents, "s_suppkey", "body"), patches.rig_proposals(rigs, "s_suppkey"), "s_suppkey")


@query(_SITES + 'SELECT s_suppkey, env_name, setting, "from", round("to", 2) AS "to", state FROM s')
def settings_patch(spark, sf_dir):
    return _patch(spark, sf_dir)[1].withColumn("to", patches.hundredths(F.col("to")))


@query(_SITES + """,
c AS (SELECT s_suppkey, max(CASE WHEN setting = 'First far' AND state = 'changed' THEN "to" END) AS far FROM s GROUP BY s_suppkey),
e AS (SELECT s_suppkey, s_suppkey % 5 = 0 AND far IS NOT NULL AS lost, '  "First far": {"note": "value: 1", "value": ' || CASE WHEN far IS NOT NULL THEN far::VARCHAR WHEN s_suppkey % 5 = 0 THEN '"unset"' ELSE '200.0' END || ', "envName": "P1_DIST_INCHES"}' AS line FROM c)
SELECT s_suppkey, CASE WHEN NOT lost THEN '{' || chr(10) || '  "Centre": {"note": "value: 1", "value": 39.37, "envName": "sphere_height_at_equator_inches"},' || chr(10) || line || ',' || chr(10) ||
    CASE WHEN s_suppkey % 4 > 0 THEN '  "First high": {"note": "value: 1", "value": 51.18, "envName": "P1_HEIGHT_INCHES"},' || chr(10) ELSE '' END || '  "Other": {"note": "value: 1", "value": 1.5, "envName": "X_INCHES"}' || chr(10) || '}' || chr(10) END AS body,
  CASE WHEN lost THEN 'no-number: First far' END AS problem FROM e""")
def patched_settings(spark, sf_dir):
    documents, patch = _patch(spark, sf_dir)
    return patches.patched_documents(documents, patch, "s_suppkey", "body")


# Crossings: residuals of a part's pairs as smear rises

_HALVES = "".join(f", b{i + 1} AS (SELECT * REPLACE (CASE WHEN bad((lo + hi) / 2) THEN lo ELSE (lo + hi) / 2 END AS lo, CASE WHEN bad((lo + hi) / 2) THEN (lo + hi) / 2 ELSE hi END AS hi) FROM b{i})" for i in range(4))


def _inline(sql: str) -> str:
    """``bad(x)`` and ``over(x)`` written out: whether, and which, pair is refused at x."""
    import re

    first, second = "({0} * p_size / 50.0::DOUBLE > 0.05::DOUBLE)", "(0.06::DOUBLE - abs({0} - 0.2::DOUBLE) * (p_partkey % 5) > 0.05::DOUBLE)"
    inner = r"\(((?:[^()]|\([^()]*\))*)\)"
    sql = re.sub("bad" + inner, lambda m: "(" + first.format(f"({m[1]})") + " OR " + second.format(f"({m[1]})") + " OR p_partkey % 11 = 0)", sql)
    return re.sub("over" + inner, lambda m: "CASE WHEN " + first.format(f"({m[1]})") + " THEN 0 WHEN " + second.format(f"({m[1]})") + " THEN 1 WHEN p_partkey % 11 = 0 THEN 2 END", sql)


def _residuals(s):
    return F.array(s * F.col("p_size") / 50.0, 0.06 - F.abs(s - 0.2) * (F.col("p_partkey") % 5), F.when(F.col("p_partkey") % 11 > 0, 0.0))


@query(_inline("""
WITH g AS (SELECT p_partkey, p_size, i, bad(i * 0.005::DOUBLE) AS refused FROM part, range(0, 101) r(i)),
f AS (SELECT p_partkey, any_value(p_size) AS p_size, bool_or(refused AND i = 0) AS zero, min(i) FILTER (refused AND i > 0) AS first, max(i) FILTER (NOT refused) AS placed FROM g GROUP BY p_partkey),
b0 AS (SELECT *, (first - 1) * 0.005::DOUBLE AS lo, first * 0.005::DOUBLE AS hi FROM f)""" + _HALVES + """
SELECT p_partkey, round(CASE WHEN zero THEN 0.0::DOUBLE ELSE (lo + hi) / 2 END, 6) AS s, CASE WHEN zero THEN over(0.0) ELSE over(hi) END AS pair, CASE WHEN zero OR first IS NULL THEN false ELSE coalesce(placed > first, false) END AS non_monotone FROM b4"""))
def smear_crossing(spark, sf_dir):
    found = t(spark, sf_dir, "part").select("p_partkey", claims.crossing(_residuals, 0.05).alias("_c")).select("p_partkey", "_c.*")
    return rounded(found, 6, "s")


@query("""
WITH r AS (SELECT l_suppkey AS run, l_quantity::DOUBLE AS level, l_linenumber AS pair, CASE WHEN l_partkey % 499 > 0 THEN l_quantity * l_tax / 50::DOUBLE END AS residual FROM lineitem),
l AS (SELECT run, level, min(CASE WHEN residual > 0.065::DOUBLE THEN pair END) AS a, min(CASE WHEN residual IS NULL THEN pair END) AS u FROM r GROUP BY ALL),
m AS (SELECT *, min(CASE WHEN a IS NOT NULL OR u IS NOT NULL THEN level END) OVER (PARTITION BY run) AS upper FROM l)
SELECT run, max(level) FILTER (level < upper) AS lower, any_value(upper) AS upper, coalesce((max(level) FILTER (level < upper) + any_value(upper)) / 2, any_value(upper)) AS s,
  max(coalesce(a, u)) FILTER (level = upper) AS pair, coalesce(bool_or(level > upper AND a IS NULL AND u IS NULL), false) AS non_monotone FROM m GROUP BY run""")
def scanned_crossing(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run"), F.col("l_quantity").alias("level"), F.col("l_linenumber").alias("pair"), F.when(F.col("l_partkey") % 499 > 0, F.col("l_quantity") * F.col("l_tax") / 50.0).alias("residual"))
    return claims.scanned_crossing(rows, ["run"], "level", "pair", "residual", 0.065)


# Clauses and bets over orders: a customer is a run

_CHECKS = """
WITH c AS (SELECT CASE o_orderpriority WHEN '5-LOW' THEN NULL ELSE o_orderpriority END AS clause, o_custkey AS run, CASE WHEN o_orderstatus = 'P' OR o_orderpriority = '3-MEDIUM' THEN 'status ' || o_orderstatus END AS why,
  CASE WHEN o_totalprice > 300000 AND o_orderpriority <> '2-HIGH' THEN 'price of ' || o_orderkey END AS failure FROM orders),
r AS (SELECT clause, run, count(*) AS checks, count(why) AS untestable, count(failure) FILTER (why IS NULL) AS failures, min(why) AS first_why, min(failure) FILTER (why IS NULL) AS first_failure FROM c GROUP BY ALL)
"""


def _clause_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, level = t(spark, sf_dir, "orders"), F.col("o_orderpriority")
    why = F.when((F.col("o_orderstatus") == "P") | (level == "3-MEDIUM"), F.concat(F.lit("status "), "o_orderstatus"))
    failure = F.when((F.col("o_totalprice") > 300000) & (level != "2-HIGH"), F.concat(F.lit("price of "), F.col("o_orderkey").cast("string")))
    checks = orders.select(F.when(level != "5-LOW", level).alias("clause"), F.col("o_custkey").alias("run"), why.alias("why"), failure.alias("failure"))
    return claims.clause_runs(checks, "clause", "run", "why", "failure")


@query(_CHECKS + "SELECT * FROM r")
def clause_runs(spark, sf_dir):
    return _clause_runs(spark, sf_dir)


@query(_CHECKS + """, n(clause) AS (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), (NULL), ('9-NEVER')),
s AS (SELECT clause, sum(checks)::BIGINT AS checks, sum(untestable)::BIGINT AS untestable, sum(failures)::BIGINT AS failures, count(*) FILTER (failures > 0) AS failing_runs, count(*) FILTER (untestable > 0) AS untestable_runs FROM r GROUP BY clause)
SELECT n.clause, coalesce(checks, 0) AS checks, coalesce(checks - untestable, 0) AS testable, coalesce(untestable, 0) AS untestable, coalesce(failures, 0) AS failures, coalesce(failing_runs, 0) AS failing_runs, coalesce(untestable_runs, 0) AS untestable_runs,
  CASE WHEN failures > 0 THEN 'failed' WHEN checks > untestable THEN 'held' ELSE 'untested' END AS verdict FROM n LEFT JOIN s ON s.clause IS NOT DISTINCT FROM n.clause""")
def clause_totals(spark, sf_dir):
    claimed = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("3-MEDIUM",), (None,), ("9-NEVER",)], "clause string")
    return claims.clause_totals(_clause_runs(spark, sf_dir), claimed, "clause")


@query("""
WITH m AS (SELECT o_orderpriority AS bet, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' OR o_custkey % 9 > 0 THEN 1.0::DOUBLE END AS v FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '3-MEDIUM'),
b(bet, threshold) AS (VALUES ('1-URGENT', 3.0::DOUBLE), ('2-HIGH', 1e12), ('3-MEDIUM', 0.0), ('4-NOT SPECIFIED', 1e12), ('5-LOW', 0.0)),
s AS (SELECT bet, count(*) AS cells, count(*) - count(v) AS unmeasured, sum(v) AS measured FROM m GROUP BY bet)
SELECT b.bet, threshold, coalesce(cells, 0) AS cells, coalesce(unmeasured, 0) AS unmeasured, measured, CASE WHEN measured > threshold THEN true WHEN unmeasured = 0 THEN false END AS falsified FROM b LEFT JOIN s USING (bet)""")
def registered_bets(spark, sf_dir):
    level = F.col("o_orderpriority")
    measures = t(spark, sf_dir, "orders").select(level.alias("bet"), ((F.col("o_orderstatus") == "P") & (level != "3-MEDIUM")).alias("read"), F.when((level != "4-NOT SPECIFIED") | (F.col("o_custkey") % 9 > 0), 1.0).alias("v"))
    bets = spark.createDataFrame([("1-URGENT", 3.0), ("2-HIGH", 1e12), ("3-MEDIUM", 0.0), ("4-NOT SPECIFIED", 1e12), ("5-LOW", 0.0)], "bet string, threshold double")
    return claims.judge_bets(measures, bets, "bet", "v", "read", "threshold")


@query("""
WITH b AS (SELECT l_orderkey AS run, l_quantity::DOUBLE AS w, l_tax * 100::DOUBLE AS k, l_quantity * l_discount * 10::DOUBLE AS g, CASE WHEN l_linenumber <> 3 THEN l_quantity * (1 - l_discount * 10::DOUBLE) + l_tax * 90 END AS m FROM lineitem),
p AS (SELECT run, w - k AS a, g - k AS g, m - k AS m FROM b), q AS (SELECT *, max(a) FILTER (m IS NOT NULL) OVER (PARTITION BY run) AS peak FROM p),
s AS (SELECT run, CASE WHEN m IS NOT NULL AND peak > 0 AND a >= 0.1::DOUBLE * peak THEN a END AS a, g, m FROM q),
f AS (SELECT run, a, least(1.0, greatest(0.0, g / a)) AS g, least(1.0, greatest(0.0, m / a)) AS m FROM s)
SELECT run, count(a) AS blocks, round(coalesce(sum(a * (1 - greatest(g, m))), 0), 4) + 0.0 AS q1, round(coalesce(sum(a * (m - least(g, m))), 0), 4) + 0.0 AS q2, round(coalesce(sum(a * least(g, m)), 0), 4) + 0.0 AS q3, round(coalesce(sum(a * (g - least(g, m))), 0), 4) + 0.0 AS q4 FROM f GROUP BY run""")
def quarter_light(spark, sf_dir):
    c = F.col
    blocks = t(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("run"), c("l_quantity").alias("w"), (c("l_tax") * 100).alias("k"), (c("l_quantity") * c("l_discount") * 10).alias("g"), F.when(c("l_linenumber") != 3, c("l_quantity") * (1 - c("l_discount") * 10) + c("l_tax") * 90).alias("m"))
    return rounded(claims.quarter_masses(blocks, ["run"], "w", "k", "g", "m"), 4, "q1", "q2", "q3", "q4")


@query("""
WITH s AS (SELECT l_suppkey AS projector, l_discount::DOUBLE AS u, l_tax::DOUBLE AS v, l_returnflag <> 'N' AND l_suppkey % 5 > 0 AS f FROM lineitem)
SELECT projector, count(*) AS points, count(*) FILTER (f) AS front, CASE WHEN count(*) FILTER (f) = 0 THEN 'Infinity'::DOUBLE ELSE round(sqrt(avg(u * u + v * v) FILTER (f)) / greatest(count(*) FILTER (f) / count(*), 1e-6::DOUBLE), 6) END AS rms FROM s GROUP BY projector""")
def coverage_rms(spark, sf_dir):
    shots = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("projector"), "l_discount", "l_tax", ((F.col("l_returnflag") != "N") & (F.col("l_suppkey") % 5 > 0)).alias("f"))
    return rounded(claims.coverage_rms(shots, ["projector"], "l_discount", "l_tax", "f"), 6, "rms")


# Arms: a return flag is an arm, a line status a scope, an order a seed

_ARMS = """
WITH r AS (SELECT l_linestatus AS scope, l_orderkey AS seed, CASE l_returnflag WHEN 'A' THEN 'clean' WHEN 'R' THEN 'room' ELSE 'image' END AS arm, CASE WHEN l_linenumber <> 4 THEN l_extendedprice::DOUBLE * CASE WHEN l_returnflag = 'A' THEN 0.5::DOUBLE ELSE 1 END END AS v FROM lineitem)
"""


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    arm = F.when(flag == "A", "clean").when(flag == "R", "room").otherwise("image")
    value = F.when(F.col("l_linenumber") != 4, F.col("l_extendedprice") * F.when(flag == "A", 0.5).otherwise(1.0))
    return t(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("scope"), F.col("l_orderkey").alias("seed"), arm.alias("arm"), value.alias("v"))


@query(_ARMS + """, b AS (SELECT scope, max(v) AS bar FROM r WHERE arm = 'clean' GROUP BY scope)
SELECT scope, arm, count(*) AS n, count(*) FILTER (v <= bar) AS usable, round(CASE WHEN any_value(bar) IS NOT NULL THEN count(*) FILTER (v <= bar) / count(*) END, 6) AS share, any_value(bar) AS bar FROM r LEFT JOIN b USING (scope) GROUP BY scope, arm""")
def arm_shares(spark, sf_dir):
    return rounded(claims.arm_shares(_arms(spark, sf_dir), "scope", "arm", "v", "clean"), 6, "share")


@query(_ARMS + """, w AS (SELECT scope, seed, min(v) FILTER (arm = 'clean') AS c, min(v) FILTER (arm = 'room') AS r, min(v) FILTER (arm = 'image') AS i FROM r GROUP BY ALL),
p AS (SELECT scope, 'room' AS before, 'image' AS after, r AS a, i AS b FROM w UNION ALL SELECT scope, 'room', 'clean', r, c FROM w UNION ALL SELECT scope, 'image', 'clean', i, c FROM w)
SELECT scope, before, after, count(*) AS n, round(exp(avg(ln(a / b))), 6) AS ratio, count(*) FILTER (b < a) AS improved, 2 * count(*) FILTER (b < a) > count(*) AS consistent FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL""")
def arm_recovery(spark, sf_dir):
    return rounded(claims.arm_recovery(_arms(spark, sf_dir), "scope", "seed", "arm", "v", [("room", "image"), ("room", "clean"), ("image", "clean")]), 6, "ratio")
