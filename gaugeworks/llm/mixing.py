"""Mixing sources to target weights, by hierarchical budgeting.

The sources form a tree: domain, language, source. Weights propagate a token
budget from the root down. A child gets its share by weight, but never more
than its subtree holds; what it can't use goes to its siblings in proportion
to their weights, and only what all siblings together can't use shows up as
the parent's own shortage, which the parent's siblings then share. Each leaf
then takes the token-prefix of seeded epochs: its documents in the order of a
seeded hash, again and again in other orders, until its budget is met.

Scale: the leaves' totals are one small aggregate. Prefix sums are taken in two
levels - token sums of slices of the hash order, then a window inside each
slice - so a leaf with a third of all rows is spread over all its slices.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, stored

LEVELS = ("domain", "language", "source")
SLICES = 1024


@dataclass(frozen=True)
class Mix:
    """Weights by name at each level (``default`` for other names), and how much to take.

    fraction: of all tokens, the budget. epochs: how often a document may be
    taken at most. seed: of the order.
    """

    domains: dict[str, float] = field(default_factory=lambda: {"d0": 5.0, "d1": 3.0, "d2": 2.0})
    languages: dict[str, float] = field(default_factory=lambda: {"en": 5.0, "de": 2.0, "fr": 2.0})
    sources: dict[str, float] = field(default_factory=dict)
    default: float = 1.0
    fraction: float = 0.6
    epochs: int = 2
    seed: int = 17


def token_count(text: Column) -> Column:
    """How many words ``[^\\x20\\x09-\\x0D]+`` a text has; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The domain of a source: its number modulo 3; other names are ``other``."""
    number = F.regexp_extract(source, r"([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (number.cast("long") % 3).cast("string"))).otherwise("other")


def _weight(name: Column, weights: dict[str, float], default: float) -> Column:
    out = F.lit(float(default))
    for k, v in weights.items():
        out = F.when(name == k, F.lit(float(v))).otherwise(out)
    return out


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Fill ``budget`` of each node from its parent's (column ``given``).

    Among siblings in the order of capacity per weight, a node is full if
    its capacity is at most its weight's share of what the fuller ones before
    it have left; the others share the rest by weight.
    """
    w = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), name)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("given") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(Window.partitionBy(*parent)) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    step = nodes.withColumn("rate", rest / weight_left).withColumn("full", F.col("capacity") <= F.col("rate") * F.col("weight"))
    # The first node that isn't full sets the rate for itself and all after it.
    rate = F.first(F.when(~F.col("full"), F.col("rate")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return step.withColumn("final", rate).withColumn("budget", F.when(F.col("final").isNull() | F.col("full"), F.least("capacity", "given")).otherwise(F.least("capacity", F.col("final") * F.col("weight")))).drop("rate", "full", "final")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(domain, language, source, tokens, budget) from (domain, language, source, tokens).

    The budget of a leaf is in whole tokens, rounded down, and at most
    ``epochs`` times its tokens. Leaves without tokens get nothing.
    """
    full = leaves.where("tokens > 0")
    one = full.select(*LEVELS, "tokens", (F.col("tokens") * mix.epochs).cast("double").alias("capacity"))
    total = one.agg(F.floor(F.sum("tokens") * F.lit(mix.fraction)).cast("double").alias("given"))
    top = one.groupBy("domain").agg(F.sum("capacity").alias("capacity")).crossJoin(F.broadcast(total))  # one row
    top = top.withColumn("given", F.least("given", F.sum("capacity").over(Window.partitionBy(F.lit(0)))))
    top = _share(top.withColumn("weight", _weight(F.col("domain"), mix.domains, mix.default)).withColumn("root", F.lit(0)), ["root"], "domain")
    middle = one.groupBy("domain", "language").agg(F.sum("capacity").alias("capacity")).join(top.select("domain", F.col("budget").alias("given")), "domain")
    middle = _share(middle.withColumn("weight", _weight(F.col("language"), mix.languages, mix.default)), ["domain"], "language")
    low = one.join(middle.select("domain", "language", F.col("budget").alias("given")), ["domain", "language"])
    low = _share(low.withColumn("weight", _weight(F.col("source"), mix.sources, mix.default)), ["domain", "language"], "source")
    return low.select(*LEVELS, "tokens", F.floor(F.col("budget") + F.lit(1e-6)).cast("long").alias("budget"))


def mix_sources(docs: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents of the mixture, once for each epoch that takes them.

    Returns ``id_col``, epoch (from 0), domain, language, source, n_tokens and
    take_tokens (the tokens within the leaf's budget: all of a document, or
    the first so many of the one in which the budget ends).

    A null language or source is the name ``unknown``. Documents without
    words have no tokens and are never taken. A null id sorts as the text
    ``null``. Ties of the hash are ordered by id, then by tokens; rows equal
    in all of these are interchangeable, and each counts. An empty table, or
    a budget of 0, gives no rows.
    """
    mix = mix or Mix()
    source = F.coalesce(F.col(source_col), F.lit("unknown"))
    counted = docs.select(F.col(id_col).alias("_id"), domain_of(source).alias("domain"), F.coalesce(F.col(lang_col), F.lit("unknown")).alias("language"), source.alias("source"), token_count(F.col(text_col)).alias("n_tokens"))
    counted = stored(counted, "token-counts").where("n_tokens > 0")
    leaves = counted.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    plan = stored(budgets(leaves, mix), "budgets").where("budget > 0")

    # Epoch e of a leaf is needed if its budget exceeds e times its tokens.
    wanted = counted.join(plan, list(LEVELS)).withColumn("epoch", F.explode(F.sequence(F.lit(0), ((F.col("budget") - 1) / F.col("tokens")).cast("int"))))
    order = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("epoch").cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit("null"))).cast("binary"))
    wanted = wanted.withColumn("_order", order).withColumn("_slice", F.conv(F.substring("_order", 1, 4), 16, 10).cast("int") % SLICES)
    part = [*LEVELS, "epoch", "_slice"]
    sums = wanted.groupBy(*part).agg(F.sum("n_tokens").alias("_sum"))
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(Window.partitionBy(*LEVELS, "epoch").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy(*part).orderBy("_order", "_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = wanted.join(starts.drop("_sum"), part).withColumn("_before", F.col("epoch") * F.col("tokens") + F.col("_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    taken = placed.where("_before < budget")
    return taken.select(F.col("_id").alias(id_col), "epoch", *LEVELS, "n_tokens", F.least("n_tokens", F.col("budget") - F.col("_before")).alias("take_tokens"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"))


def _level_sql(name: str, parent: str, rows: str) -> str:
    """The water-filling of one level, for siblings in ``rows`` (capacity, weight, given)."""
    return f"""
{name}_step AS (
  SELECT *, (given - coalesce(sum(capacity) OVER b, 0.0)) / (sum(weight) OVER p - coalesce(sum(weight) OVER b, 0.0)) AS rate
  FROM {rows} WINDOW p AS (PARTITION BY {parent}), b AS (PARTITION BY {parent} ORDER BY capacity / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), {name}_rate AS (
  SELECT *, capacity <= rate * weight AS is_full,
         first(CASE WHEN NOT (capacity <= rate * weight) THEN rate END IGNORE NULLS) OVER (PARTITION BY {parent} ORDER BY capacity / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final
  FROM {name}_step
), {name}_budget AS (
  SELECT *, CASE WHEN final IS NULL OR is_full THEN least(capacity, given) ELSE least(capacity, final * weight) END AS budget FROM {name}_rate
)"""


OP1_SQL = rf"""
WITH counted AS (
  SELECT doc_id, CASE WHEN regexp_extract(source, '[0-9]{{1,9}}$') <> '' THEN 'd' || CAST(CAST(regexp_extract(source, '[0-9]{{1,9}}$') AS BIGINT) % 3 AS VARCHAR) ELSE 'other' END AS domain,
         coalesce(lang, 'unknown') AS language, coalesce(source, 'unknown') AS source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents
), leaves AS (SELECT domain, language, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * 2 AS DOUBLE) AS capacity FROM counted WHERE n_tokens > 0 GROUP BY ALL),
top AS (
  SELECT 0 AS root, domain, sum(capacity) AS capacity, CASE domain WHEN 'd0' THEN 5.0::DOUBLE WHEN 'd1' THEN 3.0 WHEN 'd2' THEN 2.0 ELSE 1.0 END AS weight,
         (SELECT least(floor(CAST(sum(tokens) AS DOUBLE) * CAST(0.6 AS DOUBLE)), sum(capacity)) FROM leaves) AS given
  FROM leaves GROUP BY domain
), {_level_sql("domain", "root", "top")}, middle AS (
  SELECT l.domain, l.language, sum(l.capacity) AS capacity, CASE l.language WHEN 'en' THEN 5.0::DOUBLE WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 ELSE 1.0 END AS weight, any_value(b.budget) AS given
  FROM leaves l JOIN domain_budget b USING (domain) GROUP BY l.domain, l.language
), {_level_sql("language", "domain", "middle")}, low AS (
  SELECT l.*, 1.0::DOUBLE AS weight, b.budget AS given FROM leaves l JOIN language_budget b USING (domain, language)
), {_level_sql("source", "domain, language", "low")}, plan AS (
  SELECT domain, language, source, tokens, CAST(floor(budget + 1e-6) AS BIGINT) AS budget FROM source_budget
), wanted AS (
  SELECT c.*, p.tokens, p.budget, e.epoch, md5('17:' || e.epoch || ':' || c.doc_id) AS o
  FROM counted c JOIN plan p USING (domain, language, source), (SELECT 0 AS epoch UNION ALL SELECT 1) e WHERE n_tokens > 0 AND budget > e.epoch * p.tokens
), placed AS (
  SELECT *, epoch * tokens + coalesce(sum(n_tokens) OVER (PARTITION BY domain, language, source, epoch ORDER BY CAST(concat('0x', o[1:4]) AS INTEGER) % 1024, o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM wanted
)
SELECT doc_id, CAST(epoch AS INTEGER) AS epoch, domain, language, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(least(n_tokens, budget - before) AS BIGINT) AS take_tokens
FROM placed WHERE before < budget
"""
