"""Monte Carlo bands of an energy estimate: lognormal constants, three methods, one pooled band.

Draw i of a constant is a function of (seed, i, the constant's place), so tasks
need no shared generator, and every constant of a draw scales all methods alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import box_muller, log_normal, uniforms
from .quantiles import nearest_rank

JOULES_PER_KWH = 3.6e6
BAND = {"p5": 0.05, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p95": 0.95}


def constants_of(draws: DataFrame, number: str, bounds: dict[str, tuple[float, float]], seed: int) -> DataFrame:
    """(draw, one column a constant) of each row: lognormal, with 90 % between its bounds, fixed by (seed, its ``number``).

    Bounds must be positive and in order. Rows of one number have the same
    constants; a row without one has nulls.
    """
    for name, (low, high) in bounds.items():
        if not 0 < low <= high:
            raise ValueError(f"{name}: bounds must be positive and in order")
    i = F.col("draw")
    drawn = draws.select(F.col(number).cast("long").alias("draw")).select(i, F.when(i.isNotNull(), uniforms(2 * len(bounds), F.lit(seed), i)).alias("_u"))
    normal = lambda k: box_muller(F.get("_u", F.lit(2 * k)), F.get("_u", F.lit(2 * k + 1)))
    return drawn.select(i, *(log_normal(low, high, normal(k)).alias(name) for k, (name, (low, high)) in enumerate(bounds.items())))


def draw_constants(spark: SparkSession, bounds: dict[str, tuple[float, float]], draws: int, seed: int) -> DataFrame:
    """``constants_of`` of the draws 0 to ``draws`` - 1."""
    return constants_of(spark.range(draws), "id", bounds, seed)


def energy_terms(prefill_tokens: Column, output_tokens: Column, context_output: Column, read_tokens: Column) -> dict[str, Column]:
    """kWh of prefill, decode, attention and staging at the constants of a draw, before the fleet's utilisation."""
    per_joule = F.col("watts") * F.col("overhead") / JOULES_PER_KWH
    return {
        "prefill": 2 * F.col("parameters") * prefill_tokens / F.col("flops") * per_joule,
        "decode": F.col("parameters") * F.col("bytes_per_parameter") / (F.col("batch") * F.col("bandwidth")) * per_joule * output_tokens,
        "attention": context_output * F.col("kv_bytes") / F.col("bandwidth") * per_joule,
        "staging": read_tokens * F.col("kv_bytes") / F.col("staging_bandwidth") * per_joule,
    }


def _amount(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def bottom_up(work: dict[str, Column | float]) -> Column:
    """kWh of the work (prefill, output, context_output, read; numbers or columns) at a draw."""
    terms = energy_terms(*(_amount(work[k]) for k in ("prefill", "output", "context_output", "read")))
    return (terms["prefill"] + terms["decode"] + terms["attention"] + terms["staging"]) / F.col("utilisation")


def short_query_wh() -> Column:
    """Wh of the reference query: its context read once, its output generated, nothing staged."""
    context, output = F.col("query_context"), F.col("query_output")
    terms = energy_terms(context, output, context * output, F.lit(0.0))
    return (terms["prefill"] + terms["decode"] + terms["attention"]) / F.col("utilisation") * 1000


def methods(draws: DataFrame, work: dict[str, Column | float], dollars: Column | float) -> DataFrame:
    """(draw, vendor, physical, cost, short_query, no_cache) kWh: the physical sum, that scaled to published figures, and one from money."""
    physical, predicted = bottom_up(work), short_query_wh()
    cost = _amount(dollars) * (1 - F.col("margin")) * F.col("compute_share") / F.col("dollars_per_hour") * F.col("watts") * F.col("overhead") / 1000
    uncached = work | {"prefill": work["prefill"] + work["read"], "read": 0.0}
    return draws.select("draw", F.when(predicted > 0, physical * F.col("published_wh") / predicted).otherwise(0.0).alias("vendor"), physical.alias("physical"), cost.alias("cost"), predicted.alias("short_query"), bottom_up(uncached).alias("no_cache"))


def bands(results: DataFrame, pooled: tuple[str, ...] = ("vendor", "physical", "cost")) -> DataFrame:
    """(method, n, p5, p10, p50, p90, p95) of each method, and of all of them together (``pooled``): a mixture, not a mean."""
    rows = results.unpivot(["draw"], list(pooled), "method", "kwh").select(F.explode(F.array("method", F.lit("pooled"))).alias("method"), "kwh")
    return nearest_rank(rows, ["method"], "kwh", BAND)
