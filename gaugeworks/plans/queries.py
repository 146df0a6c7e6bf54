"""The reference operators, applied to the generic tables; each query stands beside its SQL."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import gray, photometry
from ..operators import colour, gates, graph, ledger, pairing, quantiles, sequences
from ..operators import statistics as S
from ..sources.ledger import number_at
from ..sources.shared import shared_dir
from ..streaming import ledger as stream_ledgers
from .registry import QUERIES, SQL, query, rounded, t

# Ledgers

_MERGED = "SELECT l_orderkey, max(l_quantity) AS l_quantity, max(l_extendedprice) AS l_extendedprice, max(l_discount) AS l_discount, max(l_tax) AS l_tax FROM lineitem GROUP BY l_orderkey"
_VALUES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(_MERGED)
def ledger_max_merge(spark, sf_dir):
    return ledger.max_merge(t(spark, sf_dir, "lineitem"), ["l_orderkey"], _VALUES)


@query("""
WITH m AS (SELECT user_id, event_type, max(value) AS value FROM events GROUP BY ALL)
SELECT coalesce(event_type, 'total') AS bucket, count(*) AS n, round(sum(value), 4) AS value FROM m GROUP BY ROLLUP (event_type)""")
def ledger_rollup(spark, sf_dir):
    merged = ledger.max_merge(t(spark, sf_dir, "events"), ["user_id", "event_type"], ["value"])
    return rounded(ledger.totals(merged.withColumnRenamed("event_type", "bucket"), "bucket", ["value"]), 4, "value")


@query(f"WITH m AS ({_MERGED}) SELECT count(*) AS n, round(sum(l_quantity * l_extendedprice), 2) AS product FROM m")
def sum_of_products(spark, sf_dir):
    merged = ledger.max_merge(t(spark, sf_dir, "lineitem"), ["l_orderkey"], _VALUES)
    return rounded(ledger.sum_of_products(merged, "l_quantity", "l_extendedprice"), 2, "product")


@query("SELECT event_type, count(DISTINCT CAST(ts AS DATE)) AS days, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM events GROUP BY event_type")
def active_days(spark, sf_dir):
    out = ledger.active_days(t(spark, sf_dir, "events"), ["event_type"], "ts")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_ts", "last_ts")})


@query("""
SELECT CASE WHEN contains(url, 'blog.') THEN 'blog' WHEN contains(url, 'm.') THEN 'mobile' ELSE 'main' END AS bucket, count(*) AS n FROM pages GROUP BY 1""")
def path_bucket(spark, sf_dir):
    bucket = ledger.first_bucket(F.col("url"), [("blog.", "blog"), ("m.", "mobile")], "main")
    return t(spark, sf_dir, "pages").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.absent') AS BIGINT), 0) AS absent FROM events")
def json_extract_default(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", number_at(F.col("props"), "$.k").alias("k"), number_at(F.col("props"), "$.absent").alias("absent"))


_RATES = [("1-URGENT", "1992-01-01", "1995-06-01", 3.0), ("1-URGENT", "1995-06-01", None, 2.5), ("2-HIGH", "1992-01-01", None, 1.5)]


@query("""
WITH r(rate_model, valid_from, valid_until, rate) AS (VALUES ('1-URGENT', DATE '1992-01-01', DATE '1995-06-01', 3.0::DOUBLE), ('1-URGENT', DATE '1995-06-01', NULL, 2.5), ('2-HIGH', DATE '1992-01-01', NULL, 1.5))
SELECT o_orderpriority, count(*) AS n, count(rate) AS priced, round(sum(o_totalprice * coalesce(rate, 0)), 2) AS cost
FROM orders LEFT JOIN r ON o_orderpriority = rate_model AND CAST(o_orderdate AS DATE) >= valid_from AND (valid_until IS NULL OR CAST(o_orderdate AS DATE) < valid_until) GROUP BY 1""")
def validity_rate_join(spark, sf_dir):
    rates = spark.createDataFrame(_RATES, "rate_model string, f string, u string, rate double").select("rate_model", F.to_date("f").alias("valid_from"), F.to_date("u").alias("valid_until"), "rate")
    orders = t(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    priced = ledger.priced(orders, rates, "o_orderpriority", "day")
    return priced.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count("rate").alias("priced"), F.round(F.sum(F.col("o_totalprice") * F.coalesce("rate", F.lit(0.0))), 2).alias("cost"))


@query("""
SELECT item, round(sum(v), 2) AS total, count(*) AS n FROM (UNPIVOT (SELECT l_quantity AS quantity, l_extendedprice AS price, l_tax AS tax FROM lineitem) ON quantity, price, tax INTO NAME item VALUE v) GROUP BY item""")
def unpivot_line_items(spark, sf_dir):
    return rounded(ledger.unpivot_items(t(spark, sf_dir, "lineitem"), {"l_quantity": "quantity", "l_extendedprice": "price", "l_tax": "tax"}), 2, "total")


# Statistics


@query("""
SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS min, max(o_totalprice) AS max, round(stddev_pop(o_totalprice), 4) AS sd,
       round(quantile_cont(o_totalprice, 0.05), 4) AS p05, round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.95), 4) AS p95,
       round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 4) AS iqr FROM orders GROUP BY 1""")
def dispersion_by_group(spark, sf_dir):
    return rounded(S.dispersion(t(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice"), 4, "mean", "sd", "p05", "median", "p95", "iqr")


@query("""
SELECT o_orderstatus, count(*) AS n, CAST(0 AS BIGINT) AS n_non_finite, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd,
       round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(median(o_totalprice), 4) AS q2, round(quantile_cont(o_totalprice, 0.75), 4) AS q3 FROM orders GROUP BY 1""")
def disperse_sample(spark, sf_dir):
    return rounded(S.sample_dispersion(t(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice"), 4, "mean", "sd", "q1", "q2", "q3")


@query("""
WITH s AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1)
SELECT l_returnflag, CAST(len(v) AS BIGINT) AS n, v[CAST(floor(0.05 * (len(v) - 1)) AS BIGINT) + 1] AS p5, v[CAST(floor(0.5 * (len(v) - 1)) AS BIGINT) + 1] AS p50, v[CAST(floor(0.95 * (len(v) - 1)) AS BIGINT) + 1] AS p95 FROM s""")
def nearest_rank_band(spark, sf_dir):
    return quantiles.nearest_rank(t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p5": 0.05, "p50": 0.5, "p95": 0.95})


@query("""
SELECT l_linestatus, count(*) AS n, round(avg(l_quantity), 4) AS mean, round(sqrt(avg(l_quantity * l_quantity)), 4) AS rms, round(median(l_quantity), 4) AS p50, round(quantile_cont(l_quantity, 0.95), 4) AS p95,
       min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem GROUP BY 1""")
def summarise_rms(spark, sf_dir):
    return rounded(S.summarise(t(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_quantity"), 4, "mean", "rms", "p50", "p95")


@query("""
WITH s AS (SELECT l_returnflag, median(l_extendedprice) / 1.1774 AS s, count(*) AS n, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1),
o AS (SELECT l_returnflag, s * 1.5 AS t0, n, v[greatest(1, CAST(floor(n * (1 - 0.2::DOUBLE)) AS BIGINT))] AS cap, len(list_filter(v, lambda x: x > s * 1.5)) AS over FROM s),
c AS (SELECT l_returnflag, CASE WHEN over > 0.2 * n THEN cap ELSE t0 END AS threshold FROM o)
SELECT l_returnflag, round(threshold, 4) AS threshold, count(*) FILTER (l_extendedprice <= threshold) AS kept, count(*) FILTER (l_extendedprice > threshold) AS rejected FROM lineitem JOIN c USING (l_returnflag) GROUP BY l_returnflag, c.threshold""")
def robust_scale_reject(spark, sf_dir):
    return rounded(S.reject_outliers(t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", k=1.5), 4, "threshold")


@query("""
SELECT l_suppkey, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(*) >= 64 THEN round(greatest(1.0, median(l_quantity) / 1.1774), 4) END AS scale FROM lineitem GROUP BY 1""")
def variance_components(spark, sf_dir):
    return rounded(S.robust_scale(t(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", least=64, floor=1.0), 4, "scale")


@query("""
WITH r AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders)
SELECT CAST(ceil((r + 1) * 16 / n) - 1 AS INTEGER) AS bin, count(*) AS n, round(median(o_totalprice), 4) AS level FROM r GROUP BY 1""")
def equal_count_bins(spark, sf_dir):
    binned = S.equal_count_bins(t(spark, sf_dir, "orders"), "o_totalprice", ["o_orderkey"], 16)
    return rounded(S.median(binned, ["bin"], "o_totalprice", "level"), 4, "level")


@query("""
WITH l AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part),
h AS (SELECT CAST(floor((p_retailprice - lo) * 255 / (hi - lo) + 0.5) AS BIGINT) AS bin, count(*) AS c FROM part, l GROUP BY 1),
w AS (SELECT bin, sum(c) OVER o AS w0, sum(c * bin) OVER o AS s0, sum(c) OVER () AS n, sum(c * bin) OVER () AS s FROM h WINDOW o AS (ORDER BY bin ROWS UNBOUNDED PRECEDING)),
b AS (SELECT bin, round(w0::DOUBLE * (n - w0) * pow(s0 / w0 - (s - s0) / (n - w0), 2), 3) AS between FROM w WHERE w0 < n)
SELECT CAST(arg_max(bin, (between, -bin)) AS INTEGER) AS bin, round(any_value(lo) + arg_max(bin, (between, -bin)) * (any_value(hi) - any_value(lo)) / 255, 4) AS threshold FROM b, l""")
def otsu_threshold(spark, sf_dir):
    return rounded(S.otsu(t(spark, sf_dir, "part"), "p_retailprice"), 4, "threshold")


@query("""
WITH m AS (SELECT (min(value) + max(value)) / 2 AS mid FROM events)
SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(count(*) FILTER (value > mid)::DOUBLE / count(*), 6) AS lit FROM events, m GROUP BY 1""")
def lit_fraction(spark, sf_dir):
    return rounded(S.lit_fractions(t(spark, sf_dir, "events"), ["event_type"], "value"), 4, "mean").withColumn("lit", F.round("lit", 6))


@query("""
WITH m AS (SELECT l_returnflag, var_pop(l_quantity) AS a, var_pop(l_discount) AS b, covar_pop(l_quantity, l_discount) AS c FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(a, 6) AS sxx, round(b, 6) AS syy, round(c, 6) AS sxy, round((a + b) / 2 + sqrt(pow((a - b) / 2, 2) + c * c), 6) AS major,
       round(greatest((a + b) / 2 - sqrt(pow((a - b) / 2, 2) + c * c), 0), 6) AS minor, round(atan2(2 * c, a - b) / 2, 6) AS angle FROM m""")
def covariance_axes(spark, sf_dir):
    return rounded(S.covariance_axes(t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount"), 6, "sxx", "syy", "sxy", "major", "minor", "angle")


@query("""
WITH b AS (SELECT l_returnflag, CAST(floor(l_extendedprice / 10000) AS BIGINT) AS bin, count(*) AS n, sum(l_quantity) AS s, sum(l_quantity * l_quantity) AS ss FROM lineitem GROUP BY ALL),
g AS (SELECT l_returnflag, sum(n) AS n, sum(s) AS s, sum(ss) AS ss, sum(s * s / n) AS b FROM b GROUP BY 1)
SELECT l_returnflag, CAST(n AS BIGINT) AS n, round((b - s * s / n) / (ss - s * s / n), 6) AS share FROM g""")
def radial_structure(spark, sf_dir):
    binned = t(spark, sf_dir, "lineitem").withColumn("bin", F.floor(F.col("l_extendedprice") / 10000))
    return rounded(S.between_bins(binned, ["l_returnflag"], "bin", "l_quantity"), 6, "share")


@query("SELECT l_linestatus, count(*) AS n, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS slope FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY 1")
def loglog_slope(spark, sf_dir):
    return rounded(S.log_slope(t(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_quantity", "l_extendedprice"), 6, "slope")


@query("""
WITH x AS (SELECT [1.0, l_quantity, l_discount, l_extendedprice] AS v FROM lineitem)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(v[i + 1] * v[j + 1]), 1) AS value FROM x, range(0, 4) a(i), range(0, 4) b(j) WHERE i <= j GROUP BY i, j""")
def normal_equations(spark, sf_dir):
    return rounded(S.normal_equations(t(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice"), 1, "value")


@query("""
WITH c AS (SELECT l_suppkey, l_returnflag, CAST(floor(l_quantity / 10) AS BIGINT) AS cell, count(*) AS n, sum(l_discount) AS s FROM lineitem GROUP BY ALL),
p AS (SELECT l_suppkey, l_returnflag, count(*) AS cells, CAST(sum(n) AS BIGINT) AS n, var_pop(s / n) AS between FROM c GROUP BY ALL)
SELECT l_suppkey, l_returnflag, cells, n, round(between, 8) AS between_cells FROM p""")
def pair_coherence(spark, sf_dir):
    return rounded(S.pair_coherence(t(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"], F.floor(F.col("l_quantity") / 10), "l_discount"), 8, "between_cells")


# Cascades, gates and verdicts


@query("""
SELECT coalesce(CASE WHEN l_discount >= 0.09 THEN 'low-modulation' WHEN l_quantity < 5 THEN 'off-image' WHEN l_tax > 0.07 THEN 'disagree' END, 'accepted') AS reason, count(*) AS n, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1""")
def reject_cascade(spark, sf_dir):
    rules = [("low-modulation", F.col("l_discount") >= 0.09), ("off-image", F.col("l_quantity") < 5), ("disagree", F.col("l_tax") > 0.07)]
    return rounded(gates.reject_counts(t(spark, sf_dir, "lineitem"), rules, [], "l_extendedprice"), 4, "mean")


def _gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scenario"), F.col("o_orderpriority").alias("metric"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("value"), (F.col("o_orderkey") % 97 == 0).alias("censored"))
    rules = spark.createDataFrame([("g1", "1-URGENT", 400000.0), ("g2", "2-HIGH", 1e9), ("g3", "5-LOW", 1e9), ("g4", "no-such", 1.0)], "gate string, metric string, limit double")
    return gates.gate_rollup(metrics, rules)


_GATES = """
WITH m AS (SELECT o_orderkey AS scenario, o_orderpriority AS metric, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS value, o_orderkey % 97 = 0 AS censored FROM orders),
g(gate, metric, lim) AS (VALUES ('g1', '1-URGENT', 400000.0::DOUBLE), ('g2', '2-HIGH', 1e9), ('g3', '5-LOW', 1e9), ('g4', 'no-such', 1.0)),
r AS (SELECT gate, lim AS "limit", count(*) FILTER (value IS NOT NULL AND NOT censored) AS scored, count(*) FILTER (scenario IS NOT NULL AND (value IS NULL OR censored OR value > lim)) AS failed,
  count(*) FILTER (scenario IS NOT NULL AND (value IS NULL OR censored)) AS unmeasured, max(value) FILTER (NOT censored) AS worst FROM g LEFT JOIN m USING (metric) GROUP BY gate, lim),
v AS (SELECT *, CASE WHEN scored = 0 THEN 'not-measured' WHEN failed > 0 THEN 'fail' ELSE 'pass' END AS verdict FROM r)"""


@query(_GATES + " SELECT * FROM v")
def gate_rollup(spark, sf_dir):
    return _gates(spark, sf_dir)


@query(_GATES + """, w(gate, status, expires, ceiling) AS (VALUES ('g1', 'OPEN', '2099-01-01', 1.0::DOUBLE), ('g2', 'OPEN', '2099-01-01', 1e12), ('g3', 'CLOSED', '2099-01-01', 1e12))
SELECT gate, verdict, CASE WHEN verdict <> 'fail' THEN verdict WHEN status IS NULL THEN 'fail:unwaived' WHEN status <> 'OPEN' THEN 'fail:not-open' WHEN expires < '2026-01-01' THEN 'fail:expired' WHEN ceiling IS NOT NULL AND (worst IS NULL OR worst > ceiling) THEN 'fail:above-ceiling' ELSE 'waived' END AS outcome FROM v LEFT JOIN w USING (gate)""")
def gate_waivers(spark, sf_dir):
    waivers = spark.createDataFrame([("g1", "OPEN", "2099-01-01", 1.0), ("g2", "OPEN", "2099-01-01", 1e12), ("g3", "CLOSED", "2099-01-01", 1e12)], "gate string, status string, expires string, ceiling double")
    return gates.judge_waived(_gates(spark, sf_dir), waivers, "2026-01-01")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 4 = 0)")
def unmatched_anti(spark, sf_dir):
    customer, orders = t(spark, sf_dir, "customer"), t(spark, sf_dir, "orders").where("o_orderkey % 4 = 0")
    return customer.join(orders, customer["c_custkey"] == orders["o_custkey"], "left_anti").select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def occluded_semi(spark, sf_dir):
    customer, orders = t(spark, sf_dir, "customer"), t(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return customer.join(orders, customer["c_custkey"] == orders["o_custkey"], "left_semi").select("c_custkey", "c_mktsegment")


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderpriority, month, n, v, w, s): median, mean and a spread of each month."""
    months = t(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return S.median(months, ["o_orderpriority", "month"], "o_totalprice", "v", [F.avg("_x").alias("w"), (F.stddev_pop("_x") / 20).alias("s")])


_MONTHS = "SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, median(o_totalprice) AS med, stddev_pop(o_totalprice) / 20 AS spread FROM orders GROUP BY ALL"


@query(f"""
WITH m AS ({_MONTHS}), w AS (SELECT *, lag(med) OVER p AS prev, greatest(spread, lag(spread) OVER p) AS dead FROM m WINDOW p AS (PARTITION BY o_orderpriority ORDER BY month))
SELECT o_orderpriority, month, CASE WHEN prev IS NULL THEN 'flat' WHEN med - prev < -dead THEN 'improved' WHEN med - prev > dead THEN 'regressed' ELSE 'flat' END AS movement FROM w""")
def round_movement(spark, sf_dir):
    months = _months(spark, sf_dir).withColumnsRenamed({"v": "med", "s": "spread"})
    return sequences.movement(months, ["o_orderpriority"], "month", "med", "spread").select("o_orderpriority", "month", "movement")


# Pairing, ranks and weights


@query("""
WITH a AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1), b AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1)
SELECT count(*) AS n, round(exp(avg(ln(a.v / b.v))), 6) AS ratio, count(*) FILTER (b.v < a.v) AS wins FROM a JOIN b USING (o_custkey)""")
def pair_ratio_geomean(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    year = lambda y: orders.where(F.col("y") == y).groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    return rounded(pairing.paired(year(1995), year(1996), ["o_custkey"], "v"), 6, "ratio")


@query("""
WITH g AS (SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_acctbal < 4500) AS k FROM customer GROUP BY 1),
f AS (SELECT c_nationkey, n, k, least(k, n - k) AS m FROM g),
p AS (SELECT c_nationkey, n, k, list_sum(list_transform(range(0, m + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0)))) AS tail FROM f)
SELECT c_nationkey, n, k AS wins, round(least(1.0, 2 * tail), 6) AS p FROM p""")
def sign_test(spark, sf_dir):
    g = t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 4500).alias("wins"))
    return g.select("c_nationkey", "n", "wins", F.round(pairing.sign_test(F.col("wins"), F.col("n")), 6).alias("p"))


@query("""
WITH m AS (SELECT o_orderpriority, count(*) AS n, median(o_totalprice) AS median FROM orders GROUP BY 1)
SELECT o_orderpriority, n, round(median, 4) AS median, round(median / (SELECT median FROM m WHERE o_orderpriority = '5-LOW'), 6) AS ratio FROM m""")
def ratio_to_control(spark, sf_dir):
    out = pairing.ratio_to_control(t(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", "5-LOW")
    return rounded(out, 4, "median").withColumn("ratio", F.round("ratio", 6))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 5 AND NOT bool_or(o_orderstatus = 'P')")
def usable_groups(spark, sf_dir):
    return pairing.usable_groups(t(spark, sf_dir, "orders"), ["o_custkey"], 5, F.col("o_orderstatus") == "P")


@query("SELECT s_nationkey, arg_max(s_name, (s_acctbal, -s_suppkey)) AS s_name, max(s_acctbal) AS s_acctbal FROM supplier GROUP BY 1")
def worst_with_tie(spark, sf_dir):
    return pairing.worst(t(spark, sf_dir, "supplier"), ["s_nationkey"], "s_name", "s_acctbal")


@query("""
SELECT l_orderkey, l_partkey, l_quantity, place FROM (SELECT l_orderkey, l_partkey, l_quantity, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_suppkey, l_extendedprice, l_linenumber) AS INTEGER) AS place FROM lineitem) WHERE place <= 2""")
def top2_weights(spark, sf_dir):
    order = [F.desc("l_quantity"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_extendedprice"), F.asc("l_linenumber")]
    return pairing.top(t(spark, sf_dir, "lineitem"), ["l_orderkey"], order, 2).select("l_orderkey", "l_partkey", "l_quantity", "place")


@query("SELECT l_orderkey, l_partkey, l_extendedprice, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS weight FROM lineitem")
def blend_normalise(spark, sf_dir):
    return rounded(pairing.normalised(t(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity", "weight"), 6, "weight").select("l_orderkey", "l_partkey", "l_extendedprice", "weight")


@query("""
WITH p AS (SELECT a.s_nationkey AS nation, a.s_suppkey AS i, b.s_suppkey AS j, abs(a.s_acctbal - b.s_acctbal) AS gap FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey)
SELECT nation, arg_max(i, (gap, -i, -j)) AS i, arg_max(j, (gap, -i, -j)) AS j, round(max(gap), 4) AS gap FROM p GROUP BY nation""")
def worst_pair(spark, sf_dir):
    return rounded(pairing.worst_pair(t(spark, sf_dir, "supplier"), ["s_nationkey"], "s_suppkey", "s_acctbal").withColumnRenamed("s_nationkey", "nation"), 4, "gap")


@query("""
WITH a AS (SELECT * FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 11 <> 0)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b USING (o_orderkey) WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus""")
def structural_diff(spark, sf_dir):
    orders = t(spark, sf_dir, "orders")
    new = orders.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")))
    return pairing.differences(orders.where("o_orderkey % 10 <> 0"), new, ["o_orderkey"], ["o_orderstatus"])


@query("SELECT sha256(text) AS signature, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dup_signature(spark, sf_dir):
    return pairing.repeated_signatures(t(spark, sf_dir, "documents"), "text", "doc_id").withColumnRenamed("first", "first_id")


# Sequences and intervals


@query("""
WITH i AS (SELECT user_id, value > 50 AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
g AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY i) AS g FROM i), r AS (SELECT user_id, g, count(*) FILTER (f) AS c, min(i) FILTER (f) AS a FROM g GROUP BY ALL)
SELECT user_id, max(c) AS longest, CAST(sum(c) AS BIGINT) AS flagged, CAST(min(a) AS INTEGER) AS first_index FROM r GROUP BY 1""")
def longest_burst(spark, sf_dir):
    return sequences.longest_burst(t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value") > 50)


@query("""
WITH s AS (SELECT user_id, sum(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment FROM events)
SELECT user_id, CAST(segment AS BIGINT) AS segment, count(*) AS length FROM s GROUP BY ALL""")
def bookend_segments(spark, sf_dir):
    events = t(spark, sf_dir, "events")
    opener = events.agg(F.min("event_type").alias("_open"))
    return sequences.segments(events.crossJoin(F.broadcast(opener)), ["user_id"], ["ts", "event_id"], F.col("event_type") == F.col("_open"))


@query("SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), -1) AS asked_at FROM conversations")
def running_heading(spark, sf_dir):
    out = sequences.running_heading(t(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), "asked_at")
    return out.select("conv_id", "turn", F.coalesce("asked_at", F.lit(-1).cast("bigint")).alias("asked_at"))


@query("""
WITH i AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey FROM i WHERE n <= 4 OR list_contains(list_transform(range(0, 4), lambda k: (k * n) // 4), i)""")
def deterministic_decimate(spark, sf_dir):
    return sequences.decimate(t(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 4).select("o_custkey", "o_orderkey")


@query("""
WITH m AS (SELECT o_orderpriority, datediff('month', DATE '1991-12-01', CAST(o_orderdate AS DATE)) AS x, sum(o_totalprice) AS v FROM orders GROUP BY ALL),
c AS (SELECT o_orderpriority, CAST(x AS DOUBLE) AS x, sum(v) OVER (PARTITION BY o_orderpriority ORDER BY x) AS y FROM m),
l AS (SELECT *, lag(x) OVER p AS px, lag(y) OVER p AS py FROM c WINDOW p AS (PARTITION BY o_orderpriority ORDER BY x)), h AS (SELECT o_orderpriority, min(x) AS x FROM l WHERE y >= 1e7 GROUP BY 1)
SELECT o_orderpriority, round(CASE WHEN h.x IS NULL THEN 'Infinity'::DOUBLE WHEN px IS NULL THEN 0 ELSE exp(ln(px) + (ln(1e7) - ln(py)) / (ln(y) - ln(py)) * (ln(l.x) - ln(px))) END, 6) AS crossing
FROM (SELECT DISTINCT o_orderpriority FROM l) d LEFT JOIN h USING (o_orderpriority) LEFT JOIN l ON l.o_orderpriority = d.o_orderpriority AND l.x = h.x""")
def threshold_crossing(spark, sf_dir):
    month = (F.year("o_orderdate") - 1991) * 12 + F.month("o_orderdate") - 12
    months = t(spark, sf_dir, "orders").groupBy("o_orderpriority", month.cast("double").alias("x")).agg(F.sum("o_totalprice").alias("v"))
    running = months.withColumn("y", F.sum("v").over(Window.partitionBy("o_orderpriority").orderBy("x")))
    return rounded(sequences.threshold_crossing(running, ["o_orderpriority"], "x", "y", 1e7), 6, "crossing")


@query("""
WITH e AS (SELECT event_id, value AS a, value + 7.5 AS b FROM events)
SELECT event_id, step, round((least(b, (step + 1) * 3.0) - greatest(a, step * 3.0)) / 7.5, 6) AS weight FROM e, UNNEST(range(CAST(floor(a / 3.0) AS BIGINT), CAST(ceil(b / 3.0) AS BIGINT))) AS s(step) WHERE (least(b, (step + 1) * 3.0) - greatest(a, step * 3.0)) > 0""")
def interval_overlap(spark, sf_dir):
    return rounded(sequences.overlaps(t(spark, sf_dir, "events").select("event_id", "value"), "value", 7.5, 3.0), 6, "weight").select("event_id", "step", "weight")


# Column functions


@query("SELECT p_partkey, xor(p_partkey, p_partkey >> 1) AS gray, p_partkey AS back FROM part")
def gray_code(spark, sf_dir):
    part = t(spark, sf_dir, "part").select("p_partkey", gray.to_gray(F.col("p_partkey")).alias("gray"))
    return part.select("p_partkey", "gray", gray.from_gray(F.col("gray")).alias("back"))


_ANGLES = "SELECT c_custkey, radians((c_custkey % 179) - 89.0) AS la, radians((c_custkey * 7 % 360) * 1.0) AS lo FROM customer"


@query(f"WITH a AS ({_ANGLES}) SELECT c_custkey, round(cos(la) * cos(lo), 6) AS x, round(cos(la) * sin(lo), 6) AS y, round(sin(la), 6) AS z FROM a")
def latlon_vector(spark, sf_dir):
    x, y, z = G.direction((F.col("c_custkey") % 179) - 89.0, (F.col("c_custkey") * 7 % 360) * 1.0)
    return t(spark, sf_dir, "customer").select("c_custkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(z, 6).alias("z"))


@query(f"""
WITH a AS ({_ANGLES}), v AS (SELECT c_custkey, cos(la) * cos(lo) AS x, cos(la) * sin(lo) AS y, sin(la) AS z FROM a),
q AS (SELECT c_custkey, -3 * x AS b, 9 - 2.25 AS c FROM v)
SELECT c_custkey, round(CASE WHEN b * b - c >= 0 AND -b - sqrt(greatest(b * b - c, 0)) >= 0 THEN -b - sqrt(greatest(b * b - c, 0)) END, 5) AS hit FROM q""")
def ray_sphere_hit(spark, sf_dir):
    ray = G.direction((F.col("c_custkey") % 179) - 89.0, (F.col("c_custkey") * 7 % 360) * 1.0)
    return t(spark, sf_dir, "customer").select("c_custkey", F.round(G.ray_sphere((F.lit(-3.0), F.lit(0.0), F.lit(0.0)), ray, 1.5), 5).alias("hit"))


@query("""
WITH x AS (SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, least(greatest(l_quantity / 50, 0), 1) AS t FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, round(t, 6) AS linear, round((1 - cos(t * pi())) / 2, 6) AS cosine, round(t * t * (3 - 2 * t), 6) AS smoothstep, round((exp(-4.5 * (1 - t) * (1 - t)) - exp(-4.5)) / (1 - exp(-4.5)), 6) AS gaussian, round(0.9 * (0.98 * pow(t, 2.4) + 0.02), 6) AS emitted FROM x""")
def ramp_shapes(spark, sf_dir):
    x = F.col("l_quantity") / 50
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", *(F.round(photometry.ramp(s, x), 6).alias(s) for s in photometry.RAMPS), F.round(photometry.emitted(x, 2.4, 0.9, 0.02), 6).alias("emitted"))


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm FROM embeddings")
def vector_norm(spark, sf_dir):
    return t(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(G.array_dot(F.col("embedding"), F.col("embedding"))), 5).alias("norm"))


@query("""
WITH s AS (SELECT c_custkey, [2 + cos(radians(c_custkey % 360) - k * pi() / 2) FOR k IN [0, 1, 2, 3]] AS v FROM customer), w AS (SELECT c_custkey, v[2] - v[4] AS sn, v[1] - v[3] AS cs FROM s)
SELECT c_custkey, round(sqrt(sn * sn + cs * cs) / 2, 5) AS amplitude, CAST(round(degrees(CASE WHEN atan2(sn, cs) < -1e-9 THEN atan2(sn, cs) + 2 * pi() ELSE abs(atan2(sn, cs)) END)) AS BIGINT) % 360 AS degrees FROM w""")
def phase_fit(spark, sf_dir):
    samples = [2 + F.cos(F.radians(F.col("c_custkey") % 360) - k * math.pi / 2) for k in range(4)]
    angle, amplitude = gray.phase(samples)
    return t(spark, sf_dir, "customer").select("c_custkey", F.round(amplitude, 5).alias("amplitude"), (F.round(F.degrees(angle)).cast("bigint") % 360).alias("degrees"))


# Graphs


@query("""
WITH RECURSIVE e AS (SELECT s_suppkey AS src, s_suppkey + 7 AS dst FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey + 7 IN (SELECT s_suppkey FROM supplier)),
b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(root, id) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT root, dst FROM r JOIN b ON id = src)
SELECT id, min(root) AS component FROM r GROUP BY id""")
def connected_components(spark, sf_dir):
    nodes = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    edges = nodes.where("id % 3 <> 0").select(F.col("id").alias("src"), (F.col("id") + 7).alias("dst"))
    return graph.connected_components(nodes, edges.join(nodes, edges["dst"] == nodes["id"], "left_semi"))


@query("""
WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 3 + 1) % 25 AS dst, 1.0 + n_regionkey AS length FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 5) % 25, 2.5 FROM nation),
p(id, distance, hops) AS (SELECT 0, CAST(0.0 AS DOUBLE), 0 UNION ALL SELECT dst, distance + length, hops + 1 FROM p JOIN e ON id = src WHERE hops < 14)
SELECT CAST(id AS INTEGER) AS id, min(distance) AS distance FROM p GROUP BY id""")
def shortest_path(spark, sf_dir):
    nation = t(spark, sf_dir, "nation")
    edges = nation.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 3 + 1) % 25).alias("dst"), (1.0 + F.col("n_regionkey")).alias("length"))
    edges = edges.union(nation.select("n_nationkey", (F.col("n_nationkey") + 5) % 25, F.lit(2.5)))
    return graph.shortest_paths(edges, nation.where("n_nationkey = 0").select(F.col("n_nationkey").alias("id")))


# Resampling


@query("""
WITH c AS (SELECT c_nationkey AS k, sum(c_acctbal) AS num, count(*) AS den FROM customer GROUP BY 1), ranked AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM c),
draws AS (SELECT rep, ((rep * 7919 + slot * 104729 + 12345) * 1103515245 % 2147483648) // 1024 % n AS i FROM range(0, 200) a(rep), (SELECT any_value(n) AS n FROM ranked), UNNEST(range(0, n)) b(slot))
SELECT rep, round(sum(num) / sum(den) + 1e-7, 4) AS ratio FROM draws JOIN ranked USING (i) GROUP BY rep""")
def cluster_bootstrap(spark, sf_dir):
    """Ratios of sums over resampled clusters, never rows."""
    reps = pairing.cluster_bootstrap(t(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal")
    return reps.select("rep", F.round(F.col("ratio") + 1e-7, 4).alias("ratio"))  # amounts are in hundredths, so exact halves occur


# Colour, rotations, lattices, steps and folds


@query("""
WITH p AS (SELECT p_partkey, p_size + 20.0::DOUBLE AS l1, p_partkey % 101 - 49.5::DOUBLE AS a1, p_partkey % 83 - 40.863::DOUBLE AS b1, p_size + 17.0::DOUBLE + p_partkey % 7 AS l2, p_partkey * 7 % 101 - 49.5::DOUBLE AS a2, p_partkey * 5 % 83 - 40.863::DOUBLE AS b2 FROM part),
m AS (SELECT *, pow((sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2, 7) AS m7 FROM p),
g AS (SELECT *, 1.5 - 0.5 * sqrt(m7 / (m7 + pow(25.0, 7))) AS g FROM m),
h AS (SELECT *, sqrt(a1 * g * a1 * g + b1 * b1) AS c1, sqrt(a2 * g * a2 * g + b2 * b2) AS c2, CASE WHEN atan2(b1, a1 * g) < 0 THEN degrees(atan2(b1, a1 * g)) + 360 ELSE degrees(atan2(b1, a1 * g)) END AS h1, CASE WHEN atan2(b2, a2 * g) < 0 THEN degrees(atan2(b2, a2 * g)) + 360 ELSE degrees(atan2(b2, a2 * g)) END AS h2 FROM g),
t AS (SELECT *, CASE WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS turn, CASE WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2) / 2 + 180 ELSE (h1 + h2) / 2 - 180 END AS hue, (c1 + c2) / 2 AS c, pow((l1 + l2) / 2 - 50, 2) AS o FROM h),
e AS (SELECT *, (l2 - l1) / (1 + 0.015 * o / sqrt(20 + o)) AS dl, (c2 - c1) / (1 + 0.045 * c) AS dc,
  2 * sqrt(c1 * c2) * sin(radians(turn / 2)) / (1 + 0.015 * c * (1 - 0.17 * cos(radians(hue - 30)) + 0.24 * cos(radians(2 * hue)) + 0.32 * cos(radians(3 * hue + 6)) - 0.20 * cos(radians(4 * hue - 63)))) AS dh,
  -sin(radians(60 * exp(-pow((hue - 275) / 25, 2)))) * 2 * sqrt(pow(c, 7) / (pow(c, 7) + pow(25.0, 7))) AS twist FROM t)
SELECT p_partkey, round(sqrt(dl * dl + dc * dc + dh * dh + twist * dc * dh), 5) AS delta FROM e""")
def delta_e2000(spark, sf_dir):
    k = F.col("p_partkey")
    labs = t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + 20.0).alias("l1"), (k % 101 - 49.5).alias("a1"), (k % 83 - 40.863).alias("b1"), (F.col("p_size") + 17.0 + k % 7).alias("l2"), (k * 7 % 101 - 49.5).alias("a2"), (k * 5 % 83 - 40.863).alias("b2"))
    return rounded(colour.delta_e2000(labs, ("l1", "a1", "b1"), ("l2", "a2", "b2"), "delta"), 5, "delta").select("p_partkey", "delta")


@query("""
WITH c AS (SELECT c_custkey, c_custkey % 181 - 90 AS lat FROM customer)
SELECT c_custkey, round(CASE WHEN lat >= 0 OR abs(lat) <= 60 THEN 1.0 WHEN abs(lat) >= 70 THEN 0.0 ELSE 0.5 + 0.5 * cos(pi() * (abs(lat) - 60) / 10) END, 6) AS by_latitude,
       round(CASE WHEN abs(lat) <= 20 THEN 1.0 WHEN abs(lat) >= 30 THEN 0.0 ELSE 0.5 + 0.5 * cos(pi() * (abs(lat) - 20) / 10) END, 6) AS by_colatitude FROM c""")
def polar_mask(spark, sf_dir):
    lat = F.col("c_custkey") % 181 - 90
    return t(spark, sf_dir, "customer").select("c_custkey", F.round(photometry.polar_mask(lat, 60, 70), 6).alias("by_latitude"), F.round(photometry.polar_mask(lat, 60, 70, False, True), 6).alias("by_colatitude"))


@query("""
WITH d AS (SELECT c_custkey, radians(c_custkey % 180 - 90) AS lat, radians(c_custkey % 360) AS lon, radians(30) AS w, radians(10) AS p, radians(5) AS r FROM customer),
v AS (SELECT *, cos(lat) * cos(lon) AS x, cos(lat) * sin(lon) AS y, sin(lat) AS z FROM d),
a AS (SELECT *, cos(r) * y - sin(r) * z AS y1, sin(r) * y + cos(r) * z AS z1 FROM v), b AS (SELECT *, cos(p) * x - sin(p) * z1 AS x2, sin(p) * x + cos(p) * z1 AS z2 FROM a)
SELECT c_custkey, round(cos(w) * x2 - sin(w) * y1, 5) + 0.0 AS x, round(sin(w) * x2 + cos(w) * y1, 5) + 0.0 AS y, round(z2, 5) + 0.0 AS z FROM b""")
def rotate_vector(spark, sf_dir):
    v = G.rotate(G.direction(F.col("c_custkey") % 180 - 90, F.col("c_custkey") % 360), F.lit(30.0), F.lit(10.0), F.lit(5.0))
    return t(spark, sf_dir, "customer").select("c_custkey", *((F.round(x, 5) + 0.0).alias(n) for n, x in zip("xyz", v, strict=True)))


def _lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point of a lattice for each customer, and the size of the lattice."""
    customer = t(spark, sf_dir, "customer")
    rows = customer.select(F.col("c_custkey").alias("i"), "c_acctbal").crossJoin(F.broadcast(customer.agg(F.count("*").alias("n"))))  # one row
    z, lon = G.lattice_point(F.col("i"), F.col("n"))
    return rows.select("n", "c_acctbal", z.alias("z"), lon.alias("lon"))


_LATTICE = "WITH p AS (SELECT n, c_acctbal, 1 - (2 * i + 1) / CAST(n AS DOUBLE) AS z, degrees((i * (pi() * (3 - sqrt(5.0)))) % (2 * pi())) - 180 AS lon FROM (SELECT c_custkey AS i, c_acctbal, count(*) OVER () AS n FROM customer))"


@query(_LATTICE + " SELECT CAST(floor(z * 10) AS BIGINT) AS band, CAST(floor(lon / 45) AS BIGINT) AS octant, count(*) AS n, round(sum(z), 6) AS height FROM p GROUP BY ALL")
def lattice_coverage(spark, sf_dir):
    return _lattice(spark, sf_dir).groupBy(F.floor(F.col("z") * 10).alias("band"), F.floor(F.col("lon") / 45).alias("octant")).agg(F.count("*").alias("n"), F.round(F.sum("z"), 6).alias("height"))


@query(_LATTICE + " SELECT CAST(floor(lon / 45) AS BIGINT) AS octant, round(sum(4 * pi() / n), 6) AS sr, round(sum(4 * pi() * 2.25 / n), 6) AS m2, round(sum(4 * pi() * 2.25 / n) / (4 * pi() * 2.25), 6) AS share, round(sum(4 * pi() / n * c_acctbal), 4) AS integral FROM p GROUP BY 1")
def lattice_integral(spark, sf_dir):
    """Solid angle, area and an integral over each octant of a sphere of radius 1.5, by the equal weights of its lattice."""
    n = F.col("n")
    sums = [F.round(F.sum(G.lattice_weight_sr(n)), 6).alias("sr"), F.round(F.sum(G.lattice_weight_m2(n, 1.5)), 6).alias("m2"), F.round(F.sum(G.lattice_weight_m2(n, 1.5)) / G.sphere_area(1.5), 6).alias("share"), F.round(F.sum(G.lattice_weight_sr(n) * F.col("c_acctbal")), 4).alias("integral")]
    return _lattice(spark, sf_dir).groupBy(F.floor(F.col("lon") / 45).alias("octant")).agg(*sums)


@query("""
WITH n AS (SELECT l_returnflag, l_quantity - 25.5 AS s, l_extendedprice / 1000 AS v FROM lineitem WHERE abs(l_quantity - 25.5) <= 20),
f AS (SELECT l_returnflag, regr_intercept(v, s) FILTER (s <= -2) AS l, regr_intercept(v, s) FILTER (s >= 2) AS r, regr_intercept(v, s) FILTER (abs(s) >= 2) AS b, regr_slope(v, s) FILTER (abs(s) >= 2) AS m FROM n GROUP BY 1),
i AS (SELECT l_returnflag, max(abs(v - b - m * s)) AS band FROM n JOIN f USING (l_returnflag) WHERE abs(s) < 2 GROUP BY 1)
SELECT l_returnflag, round(l, 4) AS left_level, round(r, 4) AS right_level, round(abs(l - r), 4) AS step, round(coalesce(band, 0), 4) AS band, round(greatest(abs(l - r), coalesce(band, 0)) / (abs(l + r) / 2), 4) AS fraction FROM f LEFT JOIN i USING (l_returnflag)""")
def trend_step(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") - 25.5).alias("s"), (F.col("l_extendedprice") / 1000).alias("v"))
    found = S.step_estimate(rows, ["l_returnflag"], "s", "v", 2, 20).withColumnsRenamed({"left": "left_level", "right": "right_level"})
    return rounded(found, 4, "left_level", "right_level", "step", "band", "fraction")


@query("""
WITH RECURSIVE m AS (SELECT o_orderpriority AS p, strftime(o_orderdate, '%Y-%m') AS month, median(o_totalprice) AS v, avg(o_totalprice) AS w, stddev_pop(o_totalprice) / 20 AS s FROM orders GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY month) AS i FROM m),
f AS (SELECT p, i, month, month AS best, v, w, s FROM o WHERE i = 1 UNION ALL
  SELECT x.p, x.i, x.month, CASE WHEN b THEN x.month ELSE x.best END, CASE WHEN b THEN x.nv ELSE x.v END, CASE WHEN b THEN x.nw ELSE x.w END, CASE WHEN b THEN x.ns ELSE x.s END
  FROM (SELECT f.p, o.i, o.month, f.best, f.v, f.w, f.s, o.v AS nv, o.w AS nw, o.s AS ns,
          (o.v - f.v < -greatest(o.s, f.s) OR o.w - f.w < -greatest(o.s, f.s)) AND NOT (o.v - f.v > greatest(o.s, f.s) OR o.w - f.w > greatest(o.s, f.s)) AS b FROM f JOIN o ON o.p = f.p AND o.i = f.i + 1) x)
SELECT p AS o_orderpriority, month, best FROM f""")
def best_round_fold(spark, sf_dir):
    months = _months(spark, sf_dir).withColumn("s2", F.col("s"))
    return sequences.best_rounds(months, ["o_orderpriority"], "month", ["v", "w"], ["s", "s2"])


@query("SELECT gate FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('6-GONE'), ('7-NEVER')) w(gate) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderpriority = gate)")
def unused_waivers(spark, sf_dir):
    waivers = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("6-GONE",), ("7-NEVER",)], "gate string")
    gates_seen = t(spark, sf_dir, "orders").select("o_orderpriority").distinct()
    return waivers.join(gates_seen, waivers["gate"] == gates_seen["o_orderpriority"], "left_anti")


@query("SELECT user_id, event_type, max(value) AS value FROM events GROUP BY ALL")
def stream_ledger(spark, sf_dir):
    key, values, base = ["user_id", "event_type"], ["value"], f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    events = spark.readStream.schema(t(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    stream_ledgers.start_max_merge(events, key, values, f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return stream_ledgers.merged(spark, f"{base}/table", key, values)
