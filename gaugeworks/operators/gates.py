"""Quality gates: a missing measurement is never a pass, and a waiver covers only what it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut
from .quantiles import finite


def passes(value: Column, limit: Column, censored: Column) -> Column:
    """Null without a limit; else whether the value is finite (either infinity fails), not censored and at most the limit."""
    ok = finite(value) & ~F.coalesce(censored, F.lit(False)) & (value <= limit)
    return F.when(limit.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(ok, F.lit(False)))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, null if none: an ordered reject cascade. A null rule doesn't hold."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return out


def reject_counts(df: DataFrame, rules: list[tuple[str, Column]], by: list[str], value: str) -> DataFrame:
    """``by``, reason (``accepted`` where no rule holds), n and the mean value: the counters of a cascade."""
    reason = F.coalesce(first_reason(rules), F.lit("accepted"))
    return df.groupBy(*by, reason.alias("reason")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def _measured(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    # Stored, the rules have a size that the planner knows: few are broadcast, so the metrics aren't shuffled by name.
    rules = cut(gates.select("gate", "metric", "limit"))
    j = metrics.join(rules, "metric").where("scenario IS NOT NULL")
    real = finite(F.col("value")) & ~F.coalesce("censored", F.lit(False))
    return j.select("gate", "limit", "scenario", "value", real.alias("_real"), F.coalesce(passes(F.col("value"), F.col("limit"), F.col("censored")), F.lit(True)).alias("_ok"))


def gate_rollup(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """Per gate: limit, scenarios scored, failed and unmeasured, the worst value, and the verdict.

    metrics: (scenario, metric, value, censored). gates: (gate, metric, limit).
    A value that is null, NaN, infinite or censored (a lower bound) is
    unmeasured and failed, is not scored and is not the worst. A gate without
    a limit fails nothing. A gate that scored nothing is not measured. Rows
    with a null scenario or metric count for no gate; repeated ones count
    again. The metrics are summed up by gate before gates without any are
    added, so only a row a gate is joined.
    """
    found = _measured(metrics, gates).groupBy("gate").agg(
        F.count_if("_real").alias("scored"), F.count_if(~F.col("_ok")).alias("failed"), F.count_if(~F.col("_real")).alias("unmeasured"), F.max(F.when(F.col("_real"), F.col("value"))).alias("worst")
    )
    zero = F.lit(0).cast("long")
    out = gates.join(found, "gate", "left").select(*(c for c in gates.columns if c != "metric"), *(F.coalesce(c, zero).alias(c) for c in ("scored", "failed", "unmeasured")), "worst")
    return out.withColumn("verdict", F.when(F.col("scored") == 0, "not-measured").when(F.col("failed") > 0, "fail").otherwise("pass"))


def failed_scenarios(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """(gate, scenario) of each scenario that failed a gate, once."""
    return _measured(metrics, gates).where(~F.col("_ok")).select("gate", "scenario").distinct()


def judge_waived(gates: DataFrame, waivers: DataFrame, today: str) -> DataFrame:
    """Failed gates with a waiver that is open, not expired and not exceeded pass as waived.

    waivers: (gate, status, expires, ceiling), one a gate. Without a ceiling
    (null) none is exceeded; with one, a gate without any value exceeds it.
    """
    j = gates.join(waivers, "gate", "left")
    above = F.col("ceiling").isNotNull() & (F.col("worst").isNull() | (F.col("worst") > F.col("ceiling")))
    why = first_reason([("unwaived", F.col("status").isNull()), ("not-open", F.col("status") != "OPEN"), ("expired", F.col("expires") < today), ("above-ceiling", above)])
    outcome = F.when(F.col("verdict") != "fail", F.col("verdict")).otherwise(F.coalesce(F.concat(F.lit("fail:"), why), F.lit("waived")))
    return j.select("gate", "verdict", outcome.alias("outcome"))


def resolve_citations(waivers: DataFrame, amendments: DataFrame) -> DataFrame:
    """The waivers, each with what its citation resolves to: candidates, matches, and the status of the one match.

    waivers: (waiver, gate, amendment, title, ...), ``waiver`` a number of its
    own; amendments: (id, title, status). An entry matches if it has the id
    and its title contains the waiver's, whatever the case. Only exactly one
    match is a citation; otherwise ``cited`` is null.
    """
    entries = amendments.select(F.col("id").alias("_id"), F.lower("title").alias("_title"), F.col("status").alias("_status"))
    hit = F.contains(F.col("_title"), F.lower(F.col("title")))
    found = waivers.select("waiver", "amendment", "title").join(entries, F.col("amendment") == F.col("_id")).groupBy("waiver")
    found = found.agg(F.count("*").alias("candidates"), F.count_if(hit).alias("matches"), F.max(F.when(hit, F.col("_status"))).alias("_status"))
    zero = F.lit(0).cast("long")
    j = waivers.join(found, "waiver", "left").withColumns({"candidates": F.coalesce("candidates", zero), "matches": F.coalesce("matches", zero)})
    return j.withColumn("cited", F.when(F.col("matches") == 1, F.col("_status"))).drop("_status")


def evaluate_gates(gates: DataFrame, failed: DataFrame, waivers: DataFrame, amendments: DataFrame, archetypes: DataFrame, today: str) -> DataFrame:
    """(gate, status, why): the verdict on each gate of ``gate_rollup`` (with boolean columns provisional and advisory).

    In order: a provisional gate is NOT-JUDGED; one that scored nothing, or
    that a scenario owes a value, is NOT-MEASURED (ADVISORY if advisory); an
    advisory gate is PASS or ADVISORY; a gate without failures is PASS; without
    a waiver it is FAIL. A waiver makes it WAIVED unless its citation doesn't
    resolve, its amendment isn't OPEN, it has expired, it has a ceiling that
    the worst value exceeds or that has no value to compare with, or a failed
    scenario's archetype isn't among those it names (null: all).

    failed: (gate, scenario). archetypes: (scenario, archetype); a scenario
    that isn't there is its own. waivers: (waiver, gate, amendment, title,
    expires, ceiling, scenarios); of several for a gate the lowest number
    counts. Nulls in provisional and advisory are false.
    """
    own = Window.partitionBy("gate").orderBy("waiver")
    first = waivers.withColumn("_at", F.row_number().over(own)).where("_at = 1").drop("_at")
    cited = resolve_citations(first, amendments)
    kinds = archetypes.select(F.col("scenario").alias("_scenario"), "archetype")
    broken = failed.join(kinds, F.col("scenario") == F.col("_scenario"), "left").select("gate", F.coalesce("archetype", "scenario").alias("_kind"))
    named = cited.where("scenarios IS NOT NULL").select("gate", "scenarios")
    stray = broken.join(named, "gate").groupBy("gate").agg(F.bool_or(~F.array_contains("scenarios", F.col("_kind"))).alias("_stray"))
    j = gates.join(cited.select("gate", "waiver", "candidates", "cited", "expires", "ceiling"), "gate", "left").join(stray, "gate", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    provisional, advisory = yes("provisional"), yes("advisory")
    unmeasured = (F.col("scored") == 0) | (F.col("unmeasured") > 0)
    passed = F.col("failed") == 0
    ceiling = F.col("ceiling").isNotNull()
    reasons = [
        ("provisional", provisional), ("unmeasured", unmeasured), ("advisory", advisory & ~passed), ("passed", passed), ("no-waiver", F.col("waiver").isNull()),
        ("no-amendment", F.col("candidates") == 0), ("ambiguous", F.col("cited").isNull()), ("not-open", F.col("cited") != "OPEN"), ("expired", F.lit(today) > F.col("expires")),
        ("no-value", ceiling & F.col("worst").isNull()), ("above-ceiling", ceiling & (F.col("worst") > F.col("ceiling"))), ("stray", yes("_stray")),
    ]
    why = F.coalesce(first_reason(reasons), F.lit("waived"))
    out = j.select("gate", why.alias("why"), advisory.alias("_advisory"))
    status = F.when(F.col("why") == "provisional", "NOT-JUDGED").when(F.col("why") == "unmeasured", F.when(F.col("_advisory"), "ADVISORY").otherwise("NOT-MEASURED")).when(F.col("why") == "advisory", "ADVISORY").when(F.col("why") == "passed", "PASS").when(F.col("why") == "waived", "WAIVED").otherwise("FAIL")
    return out.select("gate", status.alias("status"), "why")


def unused_waivers(waivers: DataFrame, gates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(waiver, gate, why) of the waivers that no failing gate reached: ``no-gate``, ``measured-nothing`` or ``passed``."""
    reached = verdicts.where(~F.col("why").isin("provisional", "unmeasured", "advisory", "passed")).select(F.col("gate").alias("_reached"))
    first = waivers.withColumn("_at", F.row_number().over(Window.partitionBy("gate").orderBy("waiver")))
    j = first.join(reached, F.col("gate") == F.col("_reached"), "left").where("_reached IS NULL OR _at > 1")
    seen = gates.select(F.col("gate").alias("_gate"), "scored")
    why = F.when(F.col("_gate").isNull(), "no-gate").when(F.col("scored") == 0, "measured-nothing").otherwise("passed")
    return j.join(seen, F.col("gate") == F.col("_gate"), "left").select("waiver", "gate", why.alias("why"))


def waiver_audit(waivers: DataFrame, amendments: DataFrame, gates: DataFrame) -> DataFrame:
    """(waiver, gate, amendment, amendment_status, resolves, gate_failed) of every waiver; UNRESOLVED where no single entry is cited."""
    seen = gates.select(F.col("gate").alias("_gate"), (F.col("failed") > 0).alias("_failed"))
    j = resolve_citations(waivers, amendments).join(seen, F.col("gate") == F.col("_gate"), "left")
    return j.select("waiver", "gate", "amendment", F.coalesce("cited", F.lit("UNRESOLVED")).alias("amendment_status"), (F.col("matches") == 1).alias("resolves"), F.coalesce("_failed", F.lit(False)).alias("gate_failed"))
