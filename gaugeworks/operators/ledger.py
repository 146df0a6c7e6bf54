"""Append-only usage ledgers: repeated and partial records of an id merge to their greatest values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut


def max_merge(df: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key with the greatest of each value: idempotent under re-delivery. A null is less than any value; null keys make a key."""
    return df.groupBy(*key).agg(*(F.max(v).alias(v) for v in values))


def totals(df: DataFrame, bucket: str, values: Sequence[str]) -> DataFrame:
    """Sums by bucket, and over all (bucket ``total``), of merged rows."""
    rolled = df.rollup(bucket).agg(F.grouping(bucket).alias("_all"), F.count("*").alias("n"), *(F.sum(v).alias(v) for v in values))
    return rolled.withColumn(bucket, F.when(F.col("_all") == 1, "total").otherwise(F.col(bucket))).drop("_all")


def first_bucket(path: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The name of the first rule whose fragment the path contains."""
    out = F.lit(default)
    for fragment, name in reversed(rules):
        out = F.when(F.contains(path, F.lit(fragment)), name).otherwise(out)
    return out


def priced(df: DataFrame, rates: DataFrame, model: str, day: str) -> DataFrame:
    """Left join with the rate that is valid on the day: from (inclusive) to until (exclusive, null for open).

    Rows of a model without a valid rate keep nulls; count them, as they cost
    something nobody knows. The rates are stored, so that Spark knows their
    size and broadcasts them only if they are small.
    """
    r = cut(rates)
    on = (df[model] == r["rate_model"]) & (df[day] >= r["valid_from"]) & (r["valid_until"].isNull() | (df[day] < r["valid_until"]))
    return df.join(r, on, "left")


TOKENS = ("uncached", "write_1h", "write_5m", "read", "output")
#: What a cached token costs relative to an input token, and a batch request relative to others
MULTIPLIERS = {"uncached": 1.0, "write_1h": 2.0, "write_5m": 1.25, "read": 0.1}
BATCH = 0.5
RANKS = ("main", "subagent", "workflow")
LABELS = {"uncached": "input", "write_1h": "cache writes, one hour", "write_5m": "cache writes, five minutes", "read": "cache reads", "output": "output"}


def in_scope(lines: DataFrame, session: str | None = None, branch: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Ledger lines of a session, of a branch, and from one time (inclusive, as text) to another; null times are in no range."""
    for rule in (session and F.col("session") == session, branch and F.col("branch") == branch, since and F.col("ts") >= since, until and F.col("ts") <= until):
        lines = lines.where(rule) if rule is not None and not isinstance(rule, str) else lines
    return lines


def messages(lines: DataFrame) -> DataFrame:
    """One row per message id: the greatest of each token count, the highest bucket, and session, branch and class of its first line.

    A message may be filed in several places and delivered in parts. First is
    the least (ts, path); a null ts comes last.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, RANKS)), F.col("bucket")).cast("int"), F.lit(0))
    first = F.struct(F.col("ts").isNull(), "ts", "path")
    told = [F.min_by(c, first).alias(c) for c in ("session", "branch", "model", "speed", "tier")]
    merged = lines.groupBy("id").agg(F.max(rank).alias("_rank"), *told, *(F.max(c).alias(c) for c in TOKENS))
    return merged.select("id", F.coalesce(F.get(F.array(*map(F.lit, RANKS)), F.col("_rank") - 1), F.lit("main")).alias("bucket"), "session", "branch", "model", "speed", "tier", *TOKENS)


def context_tokens() -> Column:
    """What a message had in its context: all but its output."""
    return sum((F.col(c) for c in TOKENS[1:-1]), F.col(TOKENS[0]))


def ledger_counts(lines: DataFrame, merged: DataFrame) -> DataFrame:
    """One row: raw_lines, messages, active_days, first_at, last_at, sessions, branches, and the sum of context times output.

    Lines of one message are one message; days are the first ten letters of ts.
    """
    raw = lines.agg(F.count("*").alias("raw_lines"), F.count_distinct(F.substring("ts", 1, 10)).alias("active_days"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    once = merged.agg(F.count("*").alias("messages"), F.count_distinct("session").alias("sessions"), F.count_distinct("branch").alias("branches"), F.sum(context_tokens() * F.col("output")).alias("context_output"))
    return raw.crossJoin(F.broadcast(once))  # one row each


def agents(lines: DataFrame) -> DataFrame:
    """(bucket, agents): transcripts beside the main ones by file name; one that is filed twice counts in its highest bucket."""
    rank = F.array_position(F.array(*map(F.lit, RANKS)), F.col("bucket"))
    files = lines.where("bucket <> 'main'").groupBy(F.regexp_extract("path", "[^/]*$", 0).alias("_file")).agg(F.max_by("bucket", rank).alias("bucket"))
    return files.groupBy("bucket").agg(F.count("*").alias("agents"))


def counted(merged: DataFrame, by: str) -> DataFrame:
    """(``by``, messages), most first: sessions, branches or models. Nulls are left out."""
    return merged.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("messages")).orderBy(F.desc("messages"), by)


def class_rates(classes: DataFrame, rates: DataFrame, as_of: Column) -> DataFrame:
    """The rows of ``classes`` (model, speed, tier, ...) with rate_in and rate_out in money a million tokens; null for a model without rates.

    rates: one row a model: input, output, and where there are any
    fast_input, fast_output, intro_input, intro_output, intro_until. The
    introductory rate holds up to that day; fast rates replace it; a batch
    costs ``BATCH`` of either.
    """
    r = rates.withColumnsRenamed({c: f"_{c}" for c in rates.columns})
    j = classes.join(r, F.col("model") == F.col("_model"), "left")
    out = []
    for side, name in (("input", "rate_in"), ("output", "rate_out")):
        intro = F.col(f"_intro_{side}").isNotNull() & (F.substring(as_of, 1, 10) <= F.col("_intro_until"))
        base = F.when(intro, F.col(f"_intro_{side}")).otherwise(F.col(f"_{side}"))
        fast = F.when((F.col("speed") == "fast") & F.col(f"_fast_{side}").isNotNull(), F.col(f"_fast_{side}")).otherwise(base)
        out.append((fast * F.when(F.col("tier") == "batch", BATCH).otherwise(1.0)).alias(name))
    return j.select(*classes.columns, *out)


def cost_of(rate_in: Column, rate_out: Column, tokens: dict[str, Column] | None = None) -> Column:
    """What token counts cost at rates a million."""
    t = tokens or {c: F.col(c) for c in TOKENS}
    return sum((t[c] / 1e6 * rate_in * m for c, m in MULTIPLIERS.items()), t["output"] / 1e6 * rate_out)


def price_classes(merged: DataFrame, rates: DataFrame, as_of: str | None = None) -> DataFrame:
    """One row a class (model, speed, tier): messages, ``TOKENS``, rate_in, rate_out, amount (null where there are no rates).

    as_of: the day whose rates hold, as text; without one no introductory rate does.
    """
    classes = merged.groupBy("model", "speed", "tier").agg(F.count("*").alias("messages"), *(F.sum(c).alias(c) for c in TOKENS))
    found = class_rates(classes, rates, F.lit(as_of).cast("string"))
    return found.withColumn("amount", cost_of(F.col("rate_in"), F.col("rate_out")))


def blended_rates(priced: DataFrame) -> DataFrame:
    """One row: ``TOKENS`` of the classes with rates, their mean rates by tokens (0 without tokens), and the total amount."""
    known = priced.where("amount IS NOT NULL")
    context = context_tokens()
    mean = lambda rate, n: F.coalesce(F.sum(F.col(rate) * n) / F.nullif(F.sum(n), F.lit(0).cast("long")), F.lit(0.0))
    return known.agg(*(F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in TOKENS), mean("rate_in", context).alias("rate_in"), mean("rate_out", F.col("output")).alias("rate_out"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total"))


def price_lines(blended: DataFrame) -> DataFrame:
    """(item, label, tokens, rate, amount, share): the five lines of a bill at its blended rates; share is 0 for an empty bill."""
    lines = [F.struct(F.lit(c).alias("item"), F.lit(LABELS[c]).alias("label"), F.col(c).alias("tokens"), (F.col("rate_in") * m).alias("rate")) for c, m in MULTIPLIERS.items()]
    lines.append(F.struct(F.lit("output").alias("item"), F.lit(LABELS["output"]).alias("label"), F.col("output").alias("tokens"), F.col("rate_out").alias("rate")))
    rows = blended.select("total", F.explode(F.array(*lines)).alias("l")).select("total", "l.*").withColumn("amount", F.col("tokens") / 1e6 * F.col("rate"))
    return rows.select("item", "label", "tokens", "rate", "amount", F.when(F.col("total") > 0, F.col("amount") / F.nullif("total", F.lit(0.0))).otherwise(0.0).alias("share"))


def price_buckets(merged: DataFrame, blended: DataFrame) -> DataFrame:
    """(bucket, messages, amount, share) at the blended rates: an attribution, so classes without rates count too."""
    sums = merged.groupBy("bucket").agg(F.count("*").alias("messages"), *(F.sum(c).alias(c) for c in TOKENS))
    both = sums.crossJoin(F.broadcast(blended.select("rate_in", "rate_out")))  # one row
    amounts = both.select("bucket", "messages", cost_of(F.col("rate_in"), F.col("rate_out")).alias("amount"))
    whole = F.sum("amount").over(Window.partitionBy(F.lit(0)))  # a row a bucket
    return amounts.withColumn("share", F.when(whole > 0, F.col("amount") / F.nullif(whole, F.lit(0.0))).otherwise(0.0))


def counterfactuals(blended: DataFrame) -> DataFrame:
    """One row: total, and what the same tokens cost without a cache, and with all cache writes held for an hour."""
    longer = {c: F.col(c) for c in TOKENS} | {"write_1h": F.col("write_1h") + F.col("write_5m"), "write_5m": F.lit(0)}
    rates = F.col("rate_in"), F.col("rate_out")
    return blended.select("total", (context_tokens() / 1e6 * rates[0] + F.col("output") / 1e6 * rates[1]).alias("without_cache"), cost_of(*rates, longer).alias("all_one_hour"))


def unpivot_items(df: DataFrame, items: dict[str, str]) -> DataFrame:
    """(item, total, n): sums of columns under new names, as rows; nulls count for neither."""
    wide = df.select(*(F.col(c).cast("double").alias(name) for c, name in items.items()))
    return wide.unpivot([], list(items.values()), "item", "v").groupBy("item").agg(F.sum("v").alias("total"), F.count("v").alias("n"))


def active_days(df: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    """days with any row, first and last time of each group."""
    return df.groupBy(*by).agg(F.count_distinct(F.to_date(ts)).alias("days"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def sum_of_products(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, and the sum of the products of two columns over rows that have both (null without any)."""
    return df.agg(F.count("*").alias("n"), F.sum(F.col(a) * F.col(b)).alias("product"))
