"""Verdicts on scenarios, cells and captures in which what is missing counts: nothing owed disappears from a denominator.

Null keys make groups like any other; nulls, NaN and infinities are no values
unless a docstring says otherwise. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from .gates import first_reason, passes
from .quantiles import finite
from .statistics import dispersion, median, sample_dispersion

def _same(by: Sequence[str], names: Sequence[str]) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, names, strict=True)]


def gate_summary(metrics: DataFrame, gates: DataFrame, scenarios: DataFrame) -> DataFrame:
    """``gates``' columns and for each gate scored, failed, unmeasured, not_measurable, worst, worst_scenario and verdict.

    metrics: (scenario, metric, value, censored, samples). gates: (gate,
    metric, limit, ...). scenarios: (scenario, measurable), each once: what
    ran. A scenario that isn't measurable owes no gate anything, whatever rows
    it has; a measurable one without a row owes its value and is unmeasured.
    One with 0 samples had nothing to measure: neither failed nor owed. A
    value that isn't finite, or is censored, is failed and unmeasured, not
    scored and never the worst. A scenario that repeats counts once: by its
    greatest value, and failed or unmeasured if one of its rows is. Of equal
    worst values the least scenario is named.

    Gates about which no measurable scenario says anything are left out.
    Rows of scenarios that aren't listed count for nothing; null scenarios
    and metrics too. Scenarios that owe are counted as a difference, so gates
    and scenarios are never multiplied.
    """
    rules = cut(gates.select("gate", "metric", "limit"))
    ran = scenarios.where("scenario IS NOT NULL").select(F.col("scenario").alias("_s"), F.coalesce("measurable", F.lit(True)).alias("_m"))
    rows = metrics.join(rules, "metric").join(ran.where("_m"), F.col("scenario") == F.col("_s"))
    nothing = F.coalesce(F.col("samples") == 0, F.lit(False))
    real = finite(F.col("value")) & ~F.coalesce("censored", F.lit(False))
    bad = ~F.coalesce(passes(F.col("value"), F.col("limit"), F.col("censored")), F.lit(True))
    each = rows.groupBy("gate", "scenario").agg(
        F.bool_and(nothing).alias("_none"), F.bool_or(~nothing & ~real).alias("_owed"), F.bool_or(~nothing & (bad | ~real & F.col("limit").isNotNull())).alias("_bad"), F.max(F.when(real & ~nothing, F.col("value"))).alias("_v")
    )
    top = F.min(F.when(F.col("_v").isNotNull(), F.struct((-F.col("_v")).alias("v"), F.col("scenario").alias("s"))))
    found = each.groupBy("gate").agg(
        F.count("*").alias("_seen"), F.count_if(~F.col("_none") & ~F.col("_owed")).alias("scored"), F.count_if("_bad").alias("failed"), F.count_if("_owed").alias("_owing"), F.count_if("_none").alias("_nothing"), top.alias("_top")
    )
    sizes = ran.agg(F.count_if("_m").alias("_all"), F.count_if(~F.col("_m")).alias("_off"))
    zero = F.lit(0).cast("long")
    count = lambda c: F.coalesce(c, zero)
    j = gates.join(found, "gate", "left").crossJoin(F.broadcast(sizes))  # sizes: one row
    out = j.select(
        *gates.columns, count("scored").alias("scored"), count("failed").alias("failed"), (count("_owing") + F.col("_all") - count("_seen")).alias("unmeasured"), (count("_nothing") + F.col("_off")).alias("not_measurable"),
        (-F.col("_top.v") + 0.0).alias("worst"), F.col("_top.s").alias("worst_scenario"), count("_nothing").alias("_nothing"),
    )
    verdict = F.when((F.col("scored") == 0) | (F.col("unmeasured") > 0), "not-measured").when(F.col("failed") > 0, "fail").otherwise("pass")
    return out.where("scored + failed + unmeasured + _nothing > 0").drop("_nothing").withColumn("verdict", verdict)


def unscorable(tracked: DataFrame, gates: DataFrame) -> DataFrame:
    """(key, gate, problem) of the tracked figures a round can't be ranked on: their gate is ``missing``, or ``provisional``.

    tracked: (key, gate). gates: (gate, provisional), each gate once; null is not provisional.
    """
    seen = gates.select(F.col("gate").alias("_gate"), F.coalesce("provisional", F.lit(False)).alias("_p"))
    j = tracked.join(seen, F.col("gate") == F.col("_gate"), "left")
    problem = first_reason([("missing", F.col("_gate").isNull()), ("provisional", F.col("_p"))])
    return j.select("key", "gate", problem.alias("problem")).where("problem IS NOT NULL")


def scenario_series(values: DataFrame, scenarios: DataFrame, metric: str, value: str) -> DataFrame:
    """``metric``, n, missing and the ``dispersion`` of each metric's values over all scenarios that ran.

    values: (scenario, metric, value); scenarios: (scenario), each once. A
    scenario without a finite value of a metric doesn't disappear: it is in
    ``missing``, so n + missing is the same for every metric. Of several
    values of a scenario the least finite one counts. Scenarios that aren't
    listed, and null ones, count for nothing; a metric that only they have is a row with n 0.
    """
    x = F.col(value).cast("double")
    ran = scenarios.where("scenario IS NOT NULL").select(F.col("scenario").alias("_s"))
    one = values.groupBy(F.col(metric).alias("_metric"), "scenario").agg(F.min(F.when(finite(x), x)).alias("_raw"))
    kept = one.join(ran, F.col("scenario") == F.col("_s"), "left").select("_metric", F.when(F.col("_s").isNotNull(), F.col("_raw")).alias("_value"))
    size = ran.agg(F.count("*").alias("_all"))
    out = dispersion(kept, ["_metric"], "_value").crossJoin(F.broadcast(size))  # one row
    return out.select(F.col("_metric").alias(metric), "n", (F.col("_all") - F.col("n")).alias("missing"), *(c for c in out.columns if c not in ("_metric", "n", "_all")))


def cells(runs: DataFrame, by: Sequence[str], seed: str, x: str, fields: Sequence[str], error: str, seconds: str) -> DataFrame:
    """A row for each cell and field: ``by``, field, runs, failed, x, median_seconds and the field's ``sample_dispersion``.

    A failed run (``error`` isn't null) stays in the cell: it counts in runs
    and failed, and its fields count among n_non_finite where they have no
    finite value. x is that of the least seed. Fields are unpivoted, so each
    is aggregated in the same shuffle.
    """
    long = runs.select(*by, F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("_value")) for f in fields))))
    found = sample_dispersion(long, [*by, "field"], "_value")
    also = [F.count("*").alias("runs"), F.count("_e").alias("failed"), F.min_by("_at", "_seed").alias("x")]
    named = [f"_b{i}" for i in range(len(by))]
    plain = runs.select(*(F.col(c).alias(k) for c, k in zip(by, named, strict=True)), F.col(error).alias("_e"), F.col(x).alias("_at"), F.col(seed).alias("_seed"), F.col(seconds).cast("double").alias("_sec"))
    counts, middle = plain.groupBy(*named).agg(*also), median(plain, named, "_sec", "median_seconds").drop("n")
    again = [f"_a{i}" for i in range(len(by))]
    middle = middle.withColumnsRenamed(dict(zip(named, again, strict=True)))
    whole = counts.join(middle, _same(named, again)) if by else counts.crossJoin(F.broadcast(middle))  # without keys one row
    j = found.join(whole, _same(by, named)) if by else found.crossJoin(F.broadcast(whole))
    return j.select(*by, "field", "runs", "failed", "x", "median_seconds", *(c for c in found.columns if c not in (*by, "field")))


def quadrature_check(medians: DataFrame, by: Sequence[str], level: str, value: str, base: str, parts: Sequence[str], whole: str) -> DataFrame:
    """``by``, baseline, one excess a part, predicted, measured and ratio: whether excesses over a base add up in quadrature to those of all at once.

    medians: one row a level (of several the greatest counts). An excess is at
    least 0. Groups that lack a level give no row; ratio is null where nothing is predicted.
    """
    names = [base, *parts, whole]
    wide = medians.groupBy(*by).agg(*(F.max(F.when((F.col(level) == n) & finite(F.col(value).cast("double")), F.col(value).cast("double"))).alias(f"_q{i}") for i, n in enumerate(names)))
    wide = wide.dropna(subset=[f"_q{i}" for i in range(len(names))])
    excess = [F.greatest(F.lit(0.0), F.col(f"_q{i + 1}") - F.col("_q0")) for i in range(len(parts))]
    squares = F.col("_q0") * F.col("_q0")
    for e in excess:
        squares = squares + e * e
    measured, predicted = F.col(f"_q{len(names) - 1}"), F.sqrt(squares)
    return wide.select(*by, F.col("_q0").alias("baseline"), *(e.alias(f"excess_{n}") for e, n in zip(excess, parts, strict=True)), predicted.alias("predicted"), measured.alias("measured"), F.try_divide(measured, predicted).alias("ratio"))


def gate_flips(solves: DataFrame, by: Sequence[str], rig: str, twin: str, value: str, censored: str, gate: float) -> DataFrame:
    """``by``, flips, of, twin_low and twin_high: how often repeating a solve alone moves it over a gate that its twin passes.

    solves: a row a solve, ``twin`` true for the plain one of a rig, false or
    null for its repeats. ``of`` are the repeats with a finite, uncensored
    value on rigs whose twin has one; of several twins the least counts. Rigs
    without repeats don't enter the twins' range. One aggregate by rig, no self-join.
    """
    v, plain = F.col(value).cast("double"), F.coalesce(twin, F.lit(False))
    good = finite(v) & ~F.coalesce(censored, F.lit(False))
    rigs = solves.groupBy(*by, rig).agg(F.min(F.when(plain & good, v)).alias("_t"), F.count_if(~plain).alias("_all"), F.count_if(~plain & good).alias("_of"), F.count_if(~plain & good & (v > gate)).alias("_over"))
    known = F.col("_t").isNotNull() & (F.col("_all") > 0)
    zero = F.lit(0).cast("long")
    sums = [F.coalesce(F.sum(F.when(known & (F.col("_t") <= gate), F.col("_over"))), zero).alias("flips"), F.coalesce(F.sum(F.when(known, F.col("_of"))), zero).alias("of")]
    return rigs.groupBy(*by).agg(*sums, F.min(F.when(known, F.col("_t"))).alias("twin_low"), F.max(F.when(known, F.col("_t"))).alias("twin_high"))


def _contributions(pairs: DataFrame, by: Sequence[str], camera: str, projector: str, counts: Sequence[str], cameras: DataFrame | None, projectors: DataFrame | None) -> DataFrame:
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    none = F.lit(None)
    zero = F.lit(0).cast("long")
    sums = [F.coalesce(F.col(c).cast("long"), zero).alias(f"_n{i}") for i, c in enumerate(counts)]
    rows = pairs.select(*keys, F.col(camera).alias("_c"), F.col(projector).alias("_p"), *sums, F.lit(1).cast("long").alias("_pair"))
    empty = [zero.alias(f"_n{i}") for i in range(len(counts))]
    if cameras is not None:
        rows = rows.unionByName(cameras.select(*keys, F.col(camera).alias("_c"), none.cast(pairs.schema[projector].dataType).alias("_p"), *empty, zero.alias("_pair")))
    if projectors is not None:
        rows = rows.unionByName(projectors.select(*keys, none.cast(pairs.schema[camera].dataType).alias("_c"), F.col(projector).alias("_p"), *empty, zero.alias("_pair")))
    names = [f"_k{i}" for i in range(len(by))]
    return rows.groupBy(*names, "_c", "_p").agg(*(F.sum(f"_n{i}").alias(f"_n{i}") for i in range(len(counts))), F.sum("_pair").alias("_pair"))


def capture_worth(pairs: DataFrame, by: Sequence[str], camera: str, projector: str, accepted: str, considered: str, reasons: Sequence[str], cameras: DataFrame | None = None, projectors: DataFrame | None = None) -> DataFrame:
    """A row for each capture: what it was worth, from what each camera decoded of each projector.

    ``by``, pairs, accepted, considered, cameras (that accepted something),
    silent_cameras, silent_pairs, projectors, underseen (projectors that fewer
    than two cameras accepted something of), dominant (the reason most
    rejections have; of equal ones the first of ``reasons``), dominant_count,
    dominant_share (of all rejections), usable and refusal:
    ``nothing-decoded``, ``one-camera`` or ``underseen``, in this order.

    cameras: (by, camera) handed in, silent where they have no pair.
    projectors: (by, projector) of the rig, underseen where no pair names
    them. A capture that only they name is refused. Null counts are 0; a row
    with a null camera or projector enters the totals only. A pair that
    repeats is one pair with the sum of its counts.
    """
    counts = [accepted, considered, *reasons]
    each = _contributions(pairs, by, camera, projector, counts, cameras, projectors)
    keys = [f"_k{i}" for i in range(len(by))]
    lit = F.col("_n0") > 0
    whole = F.col("_c").isNotNull() & F.col("_p").isNotNull() & (F.col("_pair") > 0)
    by_camera = each.groupBy(*keys, "_c").agg(
        *(F.sum(f"_n{i}").alias(f"_n{i}") for i in range(len(counts))), F.count_if(whole).alias("_pairs"), F.count_if(whole & ~lit).alias("_silent")
    )
    named = F.col("_c").isNotNull()
    totals = by_camera.groupBy(*keys).agg(
        *(F.sum(f"_n{i}").alias(f"_n{i}") for i in range(len(counts))), F.sum("_pairs").alias("pairs"), F.sum("_silent").alias("silent_pairs"), F.count_if(named & lit).alias("cameras"), F.count_if(named & ~lit).alias("silent_cameras")
    )
    views = each.where("_p IS NOT NULL").groupBy(*keys, "_p").agg(F.count_if(F.col("_c").isNotNull() & lit).alias("_views"))
    rig = views.groupBy(*(F.col(k).alias(f"{k}v") for k in keys)).agg(F.count("*").alias("_projectors"), F.count_if(F.col("_views") < 2).alias("_underseen"))
    j = totals.join(rig, _same(keys, [f"{k}v" for k in keys]), "left") if keys else totals.crossJoin(F.broadcast(rig))  # without keys one row
    zero = F.lit(0).cast("long")
    lost = [F.col(f"_n{i + 2}") for i in range(len(reasons))]
    most, total = (F.greatest(*lost) if len(lost) > 1 else lost[0]) if lost else zero, sum(lost, zero)
    dominant = first_reason([(name, (count == most) & (most > 0)) for name, count in zip(reasons, lost, strict=True)])
    refusal = first_reason([("nothing-decoded", F.col("_n0") == 0), ("one-camera", F.col("cameras") < 2), ("underseen", F.coalesce("_underseen", zero) > 0)])
    out = j.select(
        *(F.col(k).alias(c) for k, c in zip(keys, by, strict=True)), "pairs", F.col("_n0").alias("accepted"), F.col("_n1").alias("considered"), "cameras", "silent_cameras", "silent_pairs", F.coalesce("_projectors", zero).alias("projectors"), F.coalesce("_underseen", zero).alias("underseen"),
        dominant.alias("dominant"), F.when(most > 0, most).alias("dominant_count"), F.when(most > 0, most / total).alias("dominant_share"), refusal.alias("refusal"),
    )
    return out.withColumn("usable", F.col("refusal").isNull())


def unheard(pairs: DataFrame, by: Sequence[str], camera: str, projector: str, accepted: str, cameras: DataFrame | None = None, projectors: DataFrame | None = None) -> DataFrame:
    """``by``, kind, camera, projector and views: every silent ``camera``, silent ``pair`` and underseen ``projector`` of ``capture_worth``, a row each.

    views: the cameras that accepted something of an underseen projector; 0 for the other kinds.
    """
    each = _contributions(pairs, by, camera, projector, [accepted], cameras, projectors)
    keys = [f"_k{i}" for i in range(len(by))]
    none, zero = F.lit(None), F.lit(0).cast("long")
    types = {c: pairs.schema[c].dataType for c in (camera, projector)}
    silent = each.where("_c IS NOT NULL").groupBy(*keys, "_c").agg(F.sum("_n0").alias("_n0")).where("_n0 = 0").select(*keys, F.lit("camera").alias("kind"), "_c", none.cast(types[projector]).alias("_p"), zero.alias("views"))
    apart = each.where("_c IS NOT NULL AND _p IS NOT NULL AND _pair > 0 AND _n0 = 0").select(*keys, F.lit("pair").alias("kind"), "_c", "_p", zero.alias("views"))
    views = each.where("_p IS NOT NULL").groupBy(*keys, "_p").agg(F.count_if(F.col("_c").isNotNull() & (F.col("_n0") > 0)).alias("views")).where("views < 2")
    under = views.select(*keys, F.lit("projector").alias("kind"), none.cast(types[camera]).alias("_c"), "_p", "views")
    rows = silent.unionByName(apart).unionByName(under)
    return rows.select(*(F.col(k).alias(c) for k, c in zip(keys, by, strict=True)), "kind", F.col("_c").alias(camera), F.col("_p").alias(projector), "views")
