"""Queries over gates, waivers, rounds, frames of a capture, and errors of poses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates, pairing, sequences
from ..operators import statistics as S
from ..sources.amendments import parse_amendments
from ..sources.shared import cut
from .registry import query, rounded, t

# Gates: one a nation and one that nothing measures; scenarios are customers, archetypes their segments

_GATE_ROWS = """
WITH g AS (SELECT n_nationkey AS k, 'g' || n_nationkey AS gate, 8000.0 + 60 * n_nationkey AS lim, n_nationkey % 11 = 3 AS provisional, n_nationkey % 7 = 5 AS advisory FROM nation UNION ALL SELECT 99, 'g99', 1.0, false, false),
m AS (SELECT c_custkey AS scenario, c_nationkey AS k, CASE WHEN c_nationkey % 5 = 4 AND c_custkey % 40 = 0 THEN NULL ELSE c_acctbal END AS value, c_nationkey % 5 = 2 AND c_custkey % 90 = 7 AS censored, c_mktsegment AS archetype FROM customer),
j AS (SELECT gate, lim, provisional, advisory, scenario, archetype, value, censored, value IS NOT NULL AND NOT censored AS real, coalesce(value <= lim AND NOT censored, false) AS ok FROM g LEFT JOIN m USING (k)),
r AS (SELECT gate, provisional, advisory, count(*) FILTER (scenario IS NOT NULL AND real) AS scored, count(*) FILTER (scenario IS NOT NULL AND NOT ok) AS failed, count(*) FILTER (scenario IS NOT NULL AND NOT real) AS unmeasured, max(value) FILTER (real) AS worst FROM j GROUP BY ALL),
a AS (SELECT 'A-' || lpad(CAST(n_nationkey % 20 AS VARCHAR), 2, '0') AS id, n_name AS title, CASE n_nationkey % 4 WHEN 3 THEN 'APPLIED' ELSE 'OPEN' END AS status FROM nation),
w AS (SELECT n_nationkey AS waiver, 'g' || n_nationkey AS gate, 'A-' || lpad(CAST(n_nationkey % 20 AS VARCHAR), 2, '0') AS amendment, CASE WHEN n_nationkey = 6 THEN 'nobody' ELSE lower(n_name[1:3]) END AS title, CASE WHEN n_nationkey % 6 = 4 THEN '2020-01-01' ELSE '2099-12-31' END AS expires,
  CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN n_nationkey % 3 = 1 THEN 8900.0 ELSE 99999.0 END AS ceiling, CASE WHEN n_nationkey % 8 = 1 THEN ['BUILDING', 'MACHINERY'] END AS scenarios FROM nation WHERE n_nationkey % 9 <> 8 UNION ALL SELECT 100, 'gone', 'A-01', 'x', '2099-12-31', NULL, NULL),
c AS (SELECT w.*, count(a.id) AS candidates, count(*) FILTER (contains(lower(a.title), w.title)) AS matches, max(a.status) FILTER (contains(lower(a.title), w.title)) AS status FROM w LEFT JOIN a ON a.id = w.amendment GROUP BY ALL),
s AS (SELECT j.gate, bool_or(NOT list_contains(scenarios, archetype)) AS stray FROM j JOIN w USING (gate) WHERE scenarios IS NOT NULL AND scenario IS NOT NULL AND NOT ok GROUP BY 1),
v AS (SELECT r.gate, r.scored, CASE WHEN provisional THEN 'provisional' WHEN scored = 0 OR unmeasured > 0 THEN 'unmeasured' WHEN advisory AND failed > 0 THEN 'advisory' WHEN failed = 0 THEN 'passed' WHEN waiver IS NULL THEN 'no-waiver' WHEN candidates = 0 THEN 'no-amendment'
  WHEN matches <> 1 THEN 'ambiguous' WHEN status <> 'OPEN' THEN 'not-open' WHEN expires < '2026-01-01' THEN 'expired' WHEN ceiling IS NOT NULL AND worst IS NULL THEN 'no-value' WHEN worst > ceiling THEN 'above-ceiling' WHEN stray THEN 'stray' ELSE 'waived' END AS why, advisory, failed
  FROM r LEFT JOIN c ON c.gate = r.gate LEFT JOIN s ON s.gate = r.gate)
"""


def _gate_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    nation, customer, k = t(spark, sf_dir, "nation"), t(spark, sf_dir, "customer"), F.col("n_nationkey")
    name, code = F.concat(F.lit("g"), k), F.concat(F.lit("A-"), F.lpad((k % 20).cast("string"), 2, "0"))
    rules = nation.select(name.alias("gate"), k.cast("string").alias("metric"), (8000.0 + 60 * k).alias("limit"), (k % 11 == 3).alias("provisional"), (k % 7 == 5).alias("advisory"))
    rules = rules.union(spark.createDataFrame([("g99", "none", 1.0, False, False)], rules.schema))
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    metrics = customer.select(c.alias("scenario"), n.cast("string").alias("metric"), F.when((n % 5 != 4) | (c % 40 != 0), F.col("c_acctbal")).alias("value"), ((n % 5 == 2) & (c % 90 == 7)).alias("censored"))
    waivers = nation.where("n_nationkey % 9 <> 8").select(
        k.cast("int").alias("waiver"), name.alias("gate"), code.alias("amendment"), F.when(k == 6, "nobody").otherwise(F.lower(F.substring("n_name", 1, 3))).alias("title"), F.when(k % 6 == 4, "2020-01-01").otherwise("2099-12-31").alias("expires"),
        F.when(k % 3 == 1, 8900.0).when(k % 3 == 2, 99999.0).alias("ceiling"), F.when(k % 8 == 1, F.array(F.lit("BUILDING"), F.lit("MACHINERY"))).alias("scenarios"),
    )
    waivers = waivers.union(spark.createDataFrame([(100, "gone", "A-01", "x", "2099-12-31", None, None)], waivers.schema))
    return {
        "gates": gates.gate_rollup(metrics, rules), "failed": gates.failed_scenarios(metrics, rules), "waivers": waivers,
        "amendments": nation.select(code.alias("id"), F.col("n_name").alias("title"), F.when(k % 4 == 3, "APPLIED").otherwise("OPEN").alias("status")),
        "archetypes": customer.select(c.alias("scenario"), F.col("c_mktsegment").alias("archetype")),
    }


def _failed_as_text(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return tables | {x: tables[x].withColumn("scenario", F.col("scenario").cast("string")) for x in ("failed", "archetypes")}


@query(_GATE_ROWS + "SELECT gate, CASE why WHEN 'provisional' THEN 'NOT-JUDGED' WHEN 'unmeasured' THEN CASE WHEN advisory THEN 'ADVISORY' ELSE 'NOT-MEASURED' END WHEN 'advisory' THEN 'ADVISORY' WHEN 'passed' THEN 'PASS' WHEN 'waived' THEN 'WAIVED' ELSE 'FAIL' END AS status, why FROM v")
def gate_verdicts(spark, sf_dir):
    return gates.evaluate_gates(**_failed_as_text(_gate_tables(spark, sf_dir)), today="2026-01-01")


@query(_GATE_ROWS + "SELECT waiver, w.gate, CASE WHEN v.gate IS NULL THEN 'no-gate' WHEN scored = 0 THEN 'measured-nothing' ELSE 'passed' END AS why FROM w LEFT JOIN v USING (gate) WHERE why IS NULL OR why IN ('provisional', 'unmeasured', 'advisory', 'passed')")
def gate_unused_waivers(spark, sf_dir):
    tables = _failed_as_text(_gate_tables(spark, sf_dir))
    verdicts = gates.evaluate_gates(**tables, today="2026-01-01")
    return gates.unused_waivers(tables["waivers"], tables["gates"], verdicts)


@query(_GATE_ROWS + "SELECT waiver, c.gate, amendment, CASE WHEN matches = 1 THEN status ELSE 'UNRESOLVED' END AS amendment_status, matches = 1 AS resolves, coalesce(failed > 0, false) AS gate_failed FROM c LEFT JOIN v USING (gate)")
def gate_waiver_audit(spark, sf_dir):
    tables = _gate_tables(spark, sf_dir)
    return gates.waiver_audit(tables["waivers"], tables["amendments"], tables["gates"])


@query("""
WITH n AS (SELECT n_regionkey AS region, n_nationkey AS k, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation)
SELECT region, 'A-' || k AS id, n_name AS title, CASE WHEN k % 3 = 0 THEN 'UNKNOWN' WHEN k % 3 = 1 THEN 'OPEN' ELSE 'SUPERSEDED' END AS status, CAST(2 + 4 * (i - 1) AS INTEGER) AS line FROM n""")
def amendment_index(spark, sf_dir):
    """Headings and first statuses of a markdown page a region."""
    k = F.col("n_nationkey")
    status = F.when(k % 3 == 1, "**Status:** open.\n**Status:** APPLIED.").when(k % 3 == 2, "**Status:** **Superseded by it.**\n").otherwise("No status here.\nIn text: **Status:** OPEN.")
    entry = F.concat(F.lit("## A-"), k, F.when(k % 2 == 0, " — ").otherwise(" - "), F.col("n_name"), F.lit("  \n\n"), status, F.lit("\n"))
    pages = t(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.concat(F.lit("# Amendments\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), entry.alias("e")))), lambda x: x["e"]), "")).alias("text"))
    return parse_amendments(pages, "region")


# Rounds: months of each priority, with three metrics of which one is sometimes missing

_ROUNDS = """
WITH b AS (SELECT o_orderpriority AS p, strftime(o_orderdate, '%Y-%m') AS month, median(o_totalprice) AS v, avg(o_totalprice) AS w, stddev_pop(o_totalprice) / 20 AS s FROM orders GROUP BY ALL),
m AS (SELECT p, month, 'median' AS metric, v AS value, s AS spread FROM b UNION ALL SELECT p, month, 'mean', w, s FROM b UNION ALL SELECT p, month, 'rare', v + w, CASE WHEN month[7:7] = '5' THEN NULL ELSE s END FROM b WHERE month[6:7] <> '03')
"""


def _rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = t(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM")).withColumnRenamed("o_orderpriority", "p")
    b = cut(S.median(months, ["p", "month"], "o_totalprice", "v", [F.avg("_x").alias("w"), (F.stddev_pop("_x") / 20).alias("s")]))
    rare = F.when(F.substring("month", 7, 1) != "5", F.col("s"))
    one = lambda metric, value, spread: b.select("p", "month", F.lit(metric).alias("metric"), value.alias("value"), spread.alias("spread"))
    return one("median", F.col("v"), F.col("s")).union(one("mean", F.col("w"), F.col("s"))).union(one("rare", F.col("v") + F.col("w"), rare).where("substring(month, 6, 2) <> '03'"))


@query(_ROUNDS + """
, e AS (SELECT d.p, d.month, k.metric, m.value, m.spread FROM (SELECT DISTINCT p, month FROM b) d, (VALUES ('median'), ('mean'), ('rare')) k(metric) LEFT JOIN m ON m.p = d.p AND m.month = d.month AND m.metric = k.metric),
l AS (SELECT *, lag(value) OVER q AS before, lag(spread) OVER q AS was FROM e WINDOW q AS (PARTITION BY p, metric ORDER BY month)),
k AS (SELECT *, CASE WHEN before IS NULL THEN 'flat' WHEN value IS NULL THEN 'lost' WHEN spread IS NULL OR was IS NULL THEN 'unqualified' WHEN value - before < -greatest(spread, was) THEN 'improved' WHEN value - before > greatest(spread, was) THEN 'regressed' ELSE 'flat' END AS movement FROM l)
SELECT p, month, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (movement = 'improved'), '') AS improved, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (movement IN ('regressed', 'lost')), '') AS regressed, bool_and(movement <> 'unqualified') AS qualified,
  bool_or(movement = 'improved') AND NOT bool_or(movement IN ('regressed', 'lost')) AS improving FROM k GROUP BY p, month""")
def round_classes(spark, sf_dir):
    out = sequences.classify_rounds(_rounds(spark, sf_dir), ["p"], "month", "metric", "value", "spread", ["median", "mean", "rare"])
    return out.withColumns({c: F.array_join(c, ",") for c in ("improved", "regressed")})


@query(_ROUNDS + """
, g(metric, gate_max, provisional) AS (VALUES ('median', 200000.0::DOUBLE, false), ('mean', 0.0, false), ('rare', 5.0, true))
SELECT p, month, m.metric, round(value + 1e-7, 3) AS median, round(spread, 2) AS spread, gate_max, CASE WHEN NOT provisional THEN CASE WHEN gate_max = 0 THEN 'Infinity'::DOUBLE ELSE round(value / gate_max, 6) END END AS gate_fraction, NOT provisional AS scorable FROM m LEFT JOIN g USING (metric)""")
def round_ranking(spark, sf_dir):
    limits = spark.createDataFrame([("median", 200000.0, False), ("mean", 0.0, False), ("rare", 5.0, True)], "metric string, gate_max double, provisional boolean")
    out = sequences.rank_rounds(_rounds(spark, sf_dir).withColumnRenamed("value", "median"), limits, ["p", "month"])
    out = out.withColumn("median", F.round(F.col("median") + 1e-7, 3))  # prices are in hundredths, so exact halves occur
    return rounded(out, 2, "spread").withColumn("gate_fraction", F.round("gate_fraction", 6))


# Frames of captures: each customer's orders are photographs of two runs of white, black, patterned; some are lost

_PLAN = ("white", "black", "patterned", "patterned")
_FRAMES = """
WITH f AS (SELECT s_suppkey AS capture, pos, CASE pos % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.05 ELSE 0.45 END + 0.001 * (pos % 3) + CASE WHEN s_suppkey % 10 = 9 AND pos % 4 = 2 THEN 0.2 ELSE 0.0 END AS lit FROM supplier, range(0, 8) p(pos)
  WHERE NOT (s_suppkey % 10 = 1 AND pos = 6) AND NOT (s_suppkey % 10 = 2 AND pos = 4) AND NOT (s_suppkey % 10 = 3 AND pos = 0) AND NOT (s_suppkey % 10 = 4 AND pos IN (4, 5))),
k AS (SELECT *, max(lit) OVER (PARTITION BY capture) AS peak FROM f), c AS (SELECT *, lit / peak AS part, CASE WHEN lit / peak > 0.75 THEN 'white' WHEN lit / peak < 0.25 THEN 'black' ELSE 'patterned' END AS kind FROM k),
x AS (SELECT *, greatest(0, least(min(part) FILTER (kind = 'white') OVER g - max(part) FILTER (kind = 'patterned') OVER g, min(part) FILTER (kind = 'patterned') OVER g - max(part) FILTER (kind = 'black') OVER g)) AS margin FROM c WINDOW g AS (PARTITION BY capture))
"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, pos = F.col("capture") % 10, F.col("pos")
    every = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("capture"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("pos"))
    lit = F.when(pos % 4 == 0, 0.9).when(pos % 4 == 1, 0.05).otherwise(0.45) + 0.001 * (pos % 3) + F.when((k == 9) & (pos % 4 == 2), 0.2).otherwise(0.0)
    lost = ((k == 1) & (pos == 6)) | ((k == 2) & (pos == 4)) | ((k == 3) & (pos == 0)) | ((k == 4) & pos.isin(4, 5))
    return every.where(~lost).withColumn("lit", lit)


@query(_FRAMES + "SELECT capture, pos, kind, round(margin, 6) AS margin FROM x")
def frame_kinds(spark, sf_dir):
    return rounded(sequences.classify_frames(_frames(spark, sf_dir), ["capture"]).drop("lit"), 6, "margin")


@query(_FRAMES + """
, h AS (SELECT *, kind = 'white' AND coalesce(lead(kind) OVER o = 'black', false) AS hit FROM x WINDOW o AS (PARTITION BY capture ORDER BY pos)),
n AS (SELECT *, sum(hit::INT) OVER (PARTITION BY capture ORDER BY pos) - 1 AS run, sum(hit::INT) OVER (PARTITION BY capture) AS runs FROM h),
a AS (SELECT *, row_number() OVER (PARTITION BY capture, run ORDER BY pos) - 1 AS place, count(*) OVER (PARTITION BY capture, run) AS len FROM n),
s AS (SELECT *, coalesce(min((kind = ['white', 'black', 'patterned', 'patterned'][place + 1])::INT) OVER (PARTITION BY capture, run), 0) = 1 AS same,
  CASE WHEN margin < 0.15 THEN 'margin' WHEN runs <> 2 THEN 'runs' WHEN run < 0 THEN 'before' WHEN len <> 4 THEN 'length' END AS bad FROM a),
j AS (SELECT *, coalesce(bad, CASE WHEN NOT same THEN 'kinds' END) AS problem FROM s)
SELECT capture, pos, CASE WHEN problem IS NULL THEN CAST(run * 4 + place AS INTEGER) END AS assigned, problem FROM j""")
def frame_index(spark, sf_dir):
    return sequences.index_by_bookends(_frames(spark, sf_dir), ["capture"], "pos", _PLAN, 2).drop("lit")


@query(_FRAMES + "SELECT capture, pos, CAST(row_number() OVER (PARTITION BY capture ORDER BY pos) - 1 AS INTEGER) AS assigned, count(*) OVER (PARTITION BY capture) = 8 AS ok FROM f")
def frame_order(spark, sf_dir):
    return sequences.index_by_order(_frames(spark, sf_dir), ["capture"], ["pos"], 4, 2).drop("lit")


# Errors and arms


def _poses(spark: SparkSession, sf_dir: str, shift: float) -> DataFrame:
    k = F.col("s_suppkey")
    return t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", (k % 7 + shift).alias("x"), (k % 5 - 2 * shift).alias("y"), (k % 3 + shift / 2).alias("z"), ((k * 37 % 360) - 179.5 + 40 * shift).alias("yaw"), ((k * 11 % 120) - 60 + 10 * shift).alias("pitch"), ((k * 5 % 90) - 45 - 5 * shift).alias("roll"))


def _matrix_sql(yaw: str, pitch: str, roll: str) -> str:
    y, p, r = (f"radians({a})" for a in (yaw, pitch, roll))
    return f"[cos({y}) * cos({p}), -sin({y}) * cos({r}) - cos({y}) * sin({p}) * sin({r}), sin({y}) * sin({r}) - cos({y}) * sin({p}) * cos({r}), sin({y}) * cos({p}), cos({y}) * cos({r}) - sin({y}) * sin({p}) * sin({r}), -cos({y}) * sin({r}) - sin({y}) * sin({p}) * cos({r}), sin({p}), cos({p}) * sin({r}), cos({p}) * cos({r})]"


_POSES = f"""
WITH k AS (SELECT s_suppkey, s_nationkey, (s_suppkey * 37 % 360) - 179.5 AS yaw, (s_suppkey * 11 % 120) - 60 AS pitch, (s_suppkey * 5 % 90) - 45 AS roll FROM supplier),
m AS (SELECT *, {_matrix_sql('yaw + 10', 'pitch + 2.5', 'roll - 1.25')} AS a, {_matrix_sql('yaw', 'pitch', 'roll')} AS b FROM k),
e AS (SELECT s_suppkey, s_nationkey, sqrt(250.0 * 250 + 500.0 * 500 + 125.0 * 125) AS position_mm, degrees(acos(least(1, greatest(-1, (list_dot_product(a::DOUBLE[], b::DOUBLE[]) - 1) / 2)))) AS rotation_deg FROM m)
"""


@query(_POSES + "SELECT s_suppkey, round(position_mm, 6) AS position_mm, round(rotation_deg, 6) AS rotation_deg, 250.0::DOUBLE AS dx_mm, -500.0::DOUBLE AS dy_mm, 125.0::DOUBLE AS dz_mm, 10.0::DOUBLE AS yaw_deg, 2.5::DOUBLE AS pitch_deg, -1.25::DOUBLE AS roll_deg FROM e")
def pose_error_join(spark, sf_dir):
    errors = pairing.pose_errors(_poses(spark, sf_dir, 0.25), _poses(spark, sf_dir, 0.0), ["s_suppkey"])
    return rounded(errors, 6, *errors.columns[1:])


@query(_POSES + "SELECT s_nationkey, count(*) AS n, round(max(position_mm), 4) AS max_position_mm, round(max(rotation_deg), 4) AS max_rotation_deg, round(sqrt(avg(position_mm * position_mm)), 4) AS rms_position_mm, round(sqrt(avg(rotation_deg * rotation_deg)), 4) AS rms_rotation_deg FROM e GROUP BY 1")
def pose_error_summary(spark, sf_dir):
    errors = pairing.pose_errors(_poses(spark, sf_dir, 0.25), _poses(spark, sf_dir, 0.0), ["s_suppkey", "s_nationkey"])
    found = pairing.pose_summary(errors, ["s_nationkey"])
    return rounded(found, 4, *found.columns[2:])


@query("SELECT count(*) AS n, round(max(abs(p_retailprice * 0.01)), 6) AS max_p_retailprice, CAST(2 AS DOUBLE) AS max_p_size FROM part WHERE p_partkey % 3 <> 0")
def intrinsics_error(spark, sf_dir):
    part = t(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    found = part.where("p_partkey % 3 <> 0").withColumns({"p_size": F.col("p_size") + 2, "p_retailprice": F.col("p_retailprice") * 1.01})
    return rounded(pairing.intrinsics_errors(found, part, ["p_partkey"], ["p_retailprice", "p_size"]), 6, "max_p_retailprice")


@query("""
WITH a AS (SELECT o_custkey, min(o_totalprice) FILTER (o_orderstatus = 'O') AS "O", min(o_totalprice) FILTER (o_orderstatus = 'F') AS "F", min(o_totalprice) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1)
SELECT * FROM a WHERE "O" IS NOT NULL AND "F" IS NOT NULL AND "P" IS NOT NULL""")
def three_arm_pairs(spark, sf_dir):
    return pairing.paired_arms(t(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", "o_totalprice", ["O", "F", "P"])


@query("""
WITH o AS (SELECT o_orderpriority AS scope, o_orderstatus AS arm, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders), s AS (SELECT * FROM o UNION ALL SELECT 'all', arm, v FROM o),
m AS (SELECT scope, arm, count(v) AS n, count(*) - count(v) AS dropped, median(v) AS median FROM s GROUP BY ALL)
SELECT scope, arm, n, dropped, round(median, 4) AS median, round(median / max(median) FILTER (arm = 'O') OVER (PARTITION BY scope), 6) AS ratio FROM m""")
def scoped_ratios(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").withColumn("v", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice")))
    return rounded(pairing.summarise_scopes(orders, "o_orderpriority", "o_orderstatus", "v", "O"), 4, "median").withColumn("ratio", F.round("ratio", 6))


@query("SELECT l_returnflag, round(sqrt(sum(l_tax * l_tax)), 6) AS quadrature, round(max(l_quantity), 6) AS whole, round(sqrt(greatest(0, pow(max(l_quantity), 2) - sum(l_tax * l_tax))), 6) AS excess FROM lineitem GROUP BY 1")
def quadrature_excess(spark, sf_dir):
    return rounded(S.quadrature(t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_tax", "l_quantity"), 6, "quadrature", "whole", "excess")
