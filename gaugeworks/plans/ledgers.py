"""Queries over transcripts and what they cost, and Monte Carlo bands."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws
from ..operators import impact, ledger, pairing
from ..sources.ledger import list_projects, read_transcripts
from ..sources.shared import cut, shared_dir
from .registry import query, rounded, t

# Transcripts made of the events: event e tells of message e % 3000, in parts, in folders by e, and some lines are torn or not billed.

_RATES = [("alpha", 5.0, 25.0, 10.0, 50.0, None, None, None), ("beta", 3.0, 15.0, None, None, 2.0, 10.0, "2026-08-31"), ("gamma", 1.0, 5.0, None, None, None, None, None)]
_CARD = "model string, input double, output double, fast_input double, fast_output double, intro_input double, intro_output double, intro_until string"
_AS_OF = "2026-07-01T00:00:00Z"


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the lines as text files and read them as a ledger."""
    e, m = F.col("event_id"), F.col("event_id") % 3000
    usage = F.struct(
        (e % 1000).alias("input_tokens"), F.struct((e * 7 % 300).alias("ephemeral_1h_input_tokens"), (e * 3 % 200).alias("ephemeral_5m_input_tokens")).alias("cache_creation"),
        (e * 11 % 5000).alias("cache_read_input_tokens"), (e * 13 % 400).alias("output_tokens"), F.when(m % 9 == 0, "fast").alias("speed"), F.when(m % 17 == 0, "batch").alias("service_tier"),
    )
    model = F.get(F.array(*map(F.lit, ("alpha", "beta", "gamma", "delta", "<synthetic>"))), (m % 5).cast("int"))
    message = F.struct(F.concat(F.lit("m"), m).alias("id"), F.when(e % 50 == 1, "user").otherwise("assistant").alias("role"), model.alias("model"), usage.alias("usage"))
    line = F.to_json(F.struct(message.alias("message"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.concat(F.lit("s"), m % 40).alias("sessionId"), F.concat(F.lit("b"), m % 7).alias("gitBranch")))
    whole = F.when(e % 101 == 0, F.expr("substr(line, 1, length(line) - 2)")).otherwise(F.col("line"))
    lines = t(spark, sf_dir, "events").select("event_id", line.alias("line")).select("event_id", whole.alias("value"))
    root = f"{shared_dir(spark)}/transcripts/{uuid.uuid4().hex}"
    for folder, rule in (("main", "event_id % 10 > 2"), ("main/subagents/a", "event_id % 10 IN (1, 2)"), ("main/subagents/workflows/a", "event_id % 10 = 0")):
        lines.where(rule).select("value").coalesce(4).write.text(f"{root}/{folder}")
    return read_transcripts(spark, root, "*.txt")


_LINES = """
WITH l AS (SELECT event_id AS e, event_id % 3000 AS m, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts FROM events),
lines AS (SELECT *, CASE WHEN e % 10 = 0 THEN 2 WHEN e % 10 IN (1, 2) THEN 1 ELSE 0 END AS rank FROM l WHERE e % 50 <> 1 AND e % 101 <> 0 AND m % 5 <> 4),
merged AS (SELECT m, max(rank) AS rank, max(e % 1000) AS uncached, max(e * 7 % 300) AS write_1h, max(e * 3 % 200) AS write_5m, max(e * 11 % 5000) AS read, max(e * 13 % 400) AS output FROM lines GROUP BY m),
named AS (SELECT *, ['alpha', 'beta', 'gamma', 'delta'][m % 5 + 1] AS model, CASE WHEN m % 9 = 0 THEN 'fast' ELSE 'standard' END AS speed, CASE WHEN m % 17 = 0 THEN 'batch' ELSE 'standard' END AS tier, ['main', 'subagent', 'workflow'][rank + 1] AS bucket FROM merged),
classes AS (SELECT model, speed, tier, count(*) AS messages, sum(uncached)::BIGINT AS uncached, sum(write_1h)::BIGINT AS write_1h, sum(write_5m)::BIGINT AS write_5m, sum(read)::BIGINT AS read, sum(output)::BIGINT AS output FROM named GROUP BY ALL),
rated AS (SELECT *, CASE model WHEN 'alpha' THEN CASE speed WHEN 'fast' THEN 10.0 ELSE 5.0 END WHEN 'beta' THEN 2.0 WHEN 'gamma' THEN 1.0 END::DOUBLE * CASE tier WHEN 'batch' THEN 0.5 ELSE 1 END AS rate_in,
  CASE model WHEN 'alpha' THEN CASE speed WHEN 'fast' THEN 50.0 ELSE 25.0 END WHEN 'beta' THEN 10.0 WHEN 'gamma' THEN 5.0 END::DOUBLE * CASE tier WHEN 'batch' THEN 0.5 ELSE 1 END AS rate_out FROM classes),
priced AS (SELECT *, (uncached * rate_in + write_1h * rate_in * 2 + write_5m * rate_in * 1.25 + read * rate_in * 0.1 + output * rate_out) / 1e6 AS amount FROM rated),
known AS (SELECT sum(uncached) AS uncached, sum(write_1h) AS write_1h, sum(write_5m) AS write_5m, sum(read) AS read, sum(output) AS output, sum(rate_in * (uncached + write_1h + write_5m + read)) / sum(uncached + write_1h + write_5m + read) AS ri, sum(rate_out * output) / sum(output) AS ro, sum(amount) AS total FROM priced WHERE amount IS NOT NULL)
"""


@query(_LINES + """
SELECT (SELECT count(*) FROM lines) AS raw_lines, (SELECT count(DISTINCT ts[1:10]) FROM lines) AS active_days, (SELECT min(ts) FROM lines) AS first_at, (SELECT max(ts) FROM lines) AS last_at,
  count(*) AS messages, count(DISTINCT m % 40) AS sessions, count(DISTINCT m % 7) AS branches, CAST(sum((uncached + write_1h + write_5m + read) * output) AS BIGINT) AS context_output FROM merged""")
def transcript_counts(spark, sf_dir):
    lines = cut(_transcripts(spark, sf_dir))
    return ledger.ledger_counts(lines, ledger.messages(lines))


@query(_LINES + "SELECT bucket, count(*) AS messages, round(sum(uncached * (SELECT ri FROM known) + write_1h * (SELECT ri FROM known) * 2 + write_5m * (SELECT ri FROM known) * 1.25 + read * (SELECT ri FROM known) * 0.1 + output * (SELECT ro FROM known)) / 1e6, 6) AS amount FROM named GROUP BY bucket")
def price_by_bucket(spark, sf_dir):
    merged = cut(ledger.messages(_transcripts(spark, sf_dir)))
    blended = ledger.blended_rates(ledger.price_classes(merged, spark.createDataFrame(_RATES, _CARD), _AS_OF))
    return rounded(ledger.price_buckets(merged, blended), 6, "amount").drop("share")


@query(_LINES + "SELECT model, speed, tier, messages, uncached, write_1h, write_5m, read, output, rate_in, rate_out, round(amount, 6) AS amount FROM priced")
def price_by_class(spark, sf_dir):
    priced = ledger.price_classes(ledger.messages(_transcripts(spark, sf_dir)), spark.createDataFrame(_RATES, _CARD), _AS_OF)
    return rounded(priced, 6, "amount")


@query(_LINES + """
, i AS (SELECT unnest([{'item': 'uncached', 'tokens': uncached, 'rate': ri}, {'item': 'write_1h', 'tokens': write_1h, 'rate': ri * 2}, {'item': 'write_5m', 'tokens': write_5m, 'rate': ri * 1.25}, {'item': 'read', 'tokens': read, 'rate': ri * 0.1}, {'item': 'output', 'tokens': output, 'rate': ro}], recursive := true), total FROM known)
SELECT item, CAST(tokens AS BIGINT) AS tokens, round(rate, 6) AS rate, round(tokens / 1e6 * rate, 6) AS amount, round(tokens / 1e6 * rate / total, 6) AS share FROM i""")
def price_line_items(spark, sf_dir):
    priced = ledger.price_classes(ledger.messages(_transcripts(spark, sf_dir)), spark.createDataFrame(_RATES, _CARD), _AS_OF)
    return rounded(ledger.price_lines(ledger.blended_rates(priced)), 6, "rate", "amount", "share").drop("label")


@query(_LINES + """
SELECT round(total, 6) AS total, round((uncached + write_1h + write_5m + read) / 1e6 * ri + output / 1e6 * ro, 6) AS without_cache, round((uncached * ri + (write_1h + write_5m) * ri * 2 + read * ri * 0.1 + output * ro) / 1e6, 6) AS all_one_hour FROM known""")
def price_counterfactuals(spark, sf_dir):
    priced = ledger.price_classes(ledger.messages(_transcripts(spark, sf_dir)), spark.createDataFrame(_RATES, _CARD), _AS_OF)
    return rounded(ledger.counterfactuals(ledger.blended_rates(priced)), 6, "total", "without_cache", "all_one_hour")


@query(_LINES + "SELECT 'b' || (m % 7) AS branch, count(*) AS messages FROM merged WHERE m % 40 = 3 GROUP BY 1")
def scoped_branches(spark, sf_dir):
    return ledger.counted(ledger.messages(ledger.in_scope(_transcripts(spark, sf_dir), session="s3")), "branch")


@query("SELECT 'event_type=' || event_type AS project, 1::BIGINT AS files, true AS dated FROM events GROUP BY event_type")
def project_list(spark, sf_dir):
    """The projects below a folder, when each type of event is a project of one transcript."""
    root = f"{shared_dir(spark)}/projects/{uuid.uuid4().hex}"
    lines = t(spark, sf_dir, "events").select("event_type", F.to_json(F.struct("event_id", "user_id")).alias("value"))
    lines.repartition("event_type").write.partitionBy("event_type").text(root)
    found = list_projects(spark, root, "*.txt")
    return found.select("project", "files", F.col("modified").isNotNull().alias("dated"))


# Monte Carlo, on draws that are functions of their key


def hash_sql(x: str) -> str:
    return f"list_transform(list_transform(list_transform([CAST(({x}) & 4294967295 AS HUGEINT)], lambda h: (xor(h, h >> 16) * 2246822507) & 4294967295), lambda h: (xor(h, h >> 13) * 3266489909) & 4294967295), lambda h: xor(h, h >> 16))[1]"


def uniform_sql(*key: str) -> str:
    h = "CAST(2654435769 AS HUGEINT)"
    for part in key:
        h = f"(({hash_sql(f'xor({h}, CAST({part} AS HUGEINT) & 4294967295)')} + 2654435769) & 4294967295)"
    return f"(CAST({hash_sql(h)} AS DOUBLE) / 4294967296.0)"


def normal_sql(*key: str, k: int = 0) -> str:
    """The normal of the uniforms 2 k and 2 k + 1 of a key."""
    return f"(sqrt(-2 * ln({uniform_sql(*key, str(2 * k))} + pow(2.0, -33))) * cos(2 * pi() * {uniform_sql(*key, str(2 * k + 1))}))"


@query(f"SELECT CAST(i AS BIGINT) AS i, CAST({hash_sql('i')} AS BIGINT) AS word, round({uniform_sql('i', '7')}, 9) AS uniform, round({normal_sql('42', 'i')}, 6) AS normal FROM (SELECT o_orderkey AS i FROM orders)")
def keyed_draws(spark, sf_dir):
    """Draws keyed by the ids of the orders."""
    i = F.col("o_orderkey")
    return t(spark, sf_dir, "orders").select(i.alias("i"), draws.hash_word(i).alias("word"), F.round(draws.uniform(i, F.lit(7)), 9).alias("uniform"), F.round(draws.standard_normal(F.lit(42), i), 6).alias("normal"))


@query("SELECT CAST(i AS BIGINT) AS i, round(list_sum(list_transform(range(0, 40), lambda k: (i // CAST(pow(2, k) AS BIGINT) % 2) / pow(2, k + 1))), 9) AS halves, round(list_sum(list_transform(range(0, 26), lambda k: (i // CAST(pow(3, k) AS BIGINT) % 3) / pow(3, k + 1))), 9) AS thirds FROM (SELECT o_orderkey AS i FROM orders)")
def radical_inverse(spark, sf_dir):
    """The place of each order in two low-discrepancy sequences."""
    i = F.col("o_orderkey")
    return t(spark, sf_dir, "orders").select(i.alias("i"), F.round(draws.radical_inverse(i, 2), 9).alias("halves"), F.round(draws.radical_inverse(i, 3), 9).alias("thirds"))


_MU, _SIGMA = "(ln(80.0) + ln(600.0)) / 2", "(ln(600.0) - ln(80.0)) / (2 * 1.6448536269514722)"


@query(f"""
WITH d AS (SELECT exp({_MU} + {_SIGMA} * {normal_sql('42', 'i')}) AS v FROM (SELECT o_orderkey AS i FROM orders)), s AS (SELECT list_sort(list(v)) AS v FROM d)
SELECT CAST(len(v) AS BIGINT) AS n, round(v[CAST(floor(0.05 * (len(v) - 1)) AS BIGINT) + 1], 4) AS p5, round(v[CAST(floor(0.5 * (len(v) - 1)) AS BIGINT) + 1], 4) AS p50, round(v[CAST(floor(0.95 * (len(v) - 1)) AS BIGINT) + 1], 4) AS p95 FROM s""")
def monte_carlo_bands(spark, sf_dir):
    """Lognormal draws with 90 % between two bounds, one an order."""
    constants = impact.constants_of(t(spark, sf_dir, "orders"), "o_orderkey", {"carbon": (80.0, 600.0)}, 42)
    found = impact.nearest_rank(constants, [], "carbon", {"p5": 0.05, "p50": 0.5, "p95": 0.95})
    return rounded(found, 4, "p5", "p50", "p95")


#: Bounds of the sample estimate: (low, high) that hold 90 %
_BOUNDS = {
    "watts": (700.0, 1200.0), "overhead": (1.05, 1.3), "parameters": (2e10, 4e11), "flops": (2e14, 8e14), "bytes_per_parameter": (0.5, 2.0), "batch": (8.0, 128.0), "bandwidth": (2e12, 8e12),
    "kv_bytes": (2e4, 2e5), "staging_bandwidth": (1e10, 1e11), "utilisation": (0.3, 0.8), "query_context": (200.0, 2000.0), "query_output": (200.0, 800.0), "published_wh": (0.2, 0.5), "margin": (0.4, 0.7), "compute_share": (0.5, 0.9), "dollars_per_hour": (1.5, 4.0),
}
#: Tokens of each kind of work a unit that is ordered
_WORK = {"prefill": 100.0, "output": 10.0, "context_output": 8e5, "read": 2000.0}
_CONSTANTS = ", ".join(f"exp((ln({low}) + ln({high})) / 2 + (ln({high}) - ln({low})) / (2 * 1.6448536269514722) * {normal_sql('7', 'i', k=k)}) AS {name}" for k, (name, (low, high)) in enumerate(_BOUNDS.items()))


@query(f"""
WITH q AS (SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS q FROM lineitem), d AS (SELECT i, q, {_CONSTANTS} FROM (SELECT c_custkey AS i FROM customer), q), j AS (SELECT *, watts * overhead / 3.6e6 AS perj FROM d),
m AS (SELECT *, (2 * parameters * (100 * q) / flops * perj + parameters * bytes_per_parameter / (batch * bandwidth) * perj * (10 * q) + (8e5 * q) * kv_bytes / bandwidth * perj + (2000 * q) * kv_bytes / staging_bandwidth * perj) / utilisation AS physical,
  (2 * parameters * query_context / flops * perj + parameters * bytes_per_parameter / (batch * bandwidth) * perj * query_output + query_context * query_output * kv_bytes / bandwidth * perj) / utilisation * 1000 AS short,
  500.0 * (1 - margin) * compute_share / dollars_per_hour * watts * overhead / 1000 AS cost FROM j),
r AS (SELECT physical * published_wh / short AS vendor, physical, cost FROM m),
u AS (SELECT unnest(['vendor', 'physical', 'cost', 'pooled', 'pooled', 'pooled']) AS method, unnest([vendor, physical, cost, vendor, physical, cost]) AS kwh FROM r), s AS (SELECT method, list_sort(list(kwh)) AS v FROM u GROUP BY method)
SELECT method, CAST(len(v) AS BIGINT) AS n, round(v[CAST(floor(0.05 * (len(v) - 1)) AS BIGINT) + 1], 4) AS p5, round(v[CAST(floor(0.1 * (len(v) - 1)) AS BIGINT) + 1], 4) AS p10, round(v[CAST(floor(0.5 * (len(v) - 1)) AS BIGINT) + 1], 4) AS p50, round(v[CAST(floor(0.9 * (len(v) - 1)) AS BIGINT) + 1], 4) AS p90, round(v[CAST(floor(0.95 * (len(v) - 1)) AS BIGINT) + 1], 4) AS p95 FROM s""")
def impact_bands(spark, sf_dir):
    """Three estimates of the energy of the work ordered, on constants drawn for each customer, and their equal mixture."""
    units = t(spark, sf_dir, "lineitem").agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("_units"))
    constants = cut(impact.constants_of(t(spark, sf_dir, "customer"), "c_custkey", _BOUNDS, 7).crossJoin(F.broadcast(units)))  # one row
    results = impact.methods(constants, {k: F.col("_units") * n for k, n in _WORK.items()}, 500.0)
    return rounded(impact.bands(results), 4, *impact.BAND)


@query("""
WITH c AS (SELECT c_nationkey AS k, sum(c_acctbal) AS num, count(*) AS den FROM customer GROUP BY 1), ranked AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM c),
draws AS (SELECT rep, ((rep * 7919 + slot * 104729 + 12345) * 1103515245 % 2147483648) // 1024 % n AS i FROM range(0, 200) a(rep), (SELECT any_value(n) AS n FROM ranked), UNNEST(range(0, n)) b(slot)),
r AS (SELECT rep, sum(num) / sum(den) AS ratio FROM draws JOIN ranked USING (i) GROUP BY rep)
SELECT count(*) AS n, round(quantile_cont(ratio, 0.025), 4) AS low, round(median(ratio), 4) AS median, round(quantile_cont(ratio, 0.975), 4) AS high FROM r""")
def bootstrap_interval(spark, sf_dir):
    reps = pairing.cluster_bootstrap(t(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal")
    return rounded(pairing.bootstrap_interval(reps), 4, "low", "median", "high")
