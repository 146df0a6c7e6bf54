"""Order-dependent operators, each within groups; the order is total, so results don't depend on partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import prefix
from .quantiles import finite


def longest_burst(df: DataFrame, by: Sequence[str], order: Sequence[str], flag: Column) -> DataFrame:
    """The longest run of consecutive flagged rows, and the first index (from 0) that is flagged; null without one. A null flag is none."""
    p = prefix(df)
    w = Window.partitionBy(*by).orderBy(*order)
    at = df.withColumns({f"{p}i": F.row_number().over(w) - 1, f"{p}f": F.coalesce(flag, F.lit(False))})
    runs = at.withColumn(f"{p}g", F.sum(F.when(F.col(f"{p}f"), 0).otherwise(1)).over(Window.partitionBy(*by).orderBy(f"{p}i")))
    sizes = runs.groupBy(*by, f"{p}g").agg(F.count_if(f"{p}f").alias(f"{p}c"), F.min(F.when(F.col(f"{p}f"), F.col(f"{p}i"))).alias(f"{p}first"))
    return sizes.groupBy(*by).agg(F.max(f"{p}c").alias("longest"), F.sum(f"{p}c").alias("flagged"), F.min(f"{p}first").alias("first_index"))


def segments(df: DataFrame, by: Sequence[str], order: Sequence[str], opens: Column) -> DataFrame:
    """Number the segments that a row with ``opens`` begins (0 before the first) and give their lengths. A null ``opens`` begins none; null keys are a group; an empty table gives no rows."""
    w = Window.partitionBy(*by).orderBy(*order)
    numbered = df.withColumn("segment", F.sum(F.when(opens, 1).otherwise(0)).over(w))
    return numbered.groupBy(*by, "segment").agg(F.count("*").alias("length"))


def running_heading(df: DataFrame, by: Sequence[str], order: Sequence[str], heading: Column, alias: str) -> DataFrame:
    """Add the latest heading at or before each row; null before the first. A null heading is none; null keys are a group."""
    return df.withColumn(alias, F.last(heading, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def decimate(df: DataFrame, by: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """Keep the indexes floor(i * n / most) of each group of more than ``most`` rows; smaller groups stay whole.

    Null keys make a group. Rows equal in ``order`` are interchangeable.
    """
    p = prefix(df)
    w = Window.partitionBy(*by)
    at, n = F.col(f"{p}i"), F.col(f"{p}n")
    numbered = df.withColumn(f"{p}i", F.row_number().over(w.orderBy(*order)) - 1).withColumn(f"{p}n", F.count("*").over(w))
    # An index is kept if it is the floor for some i: the i-th multiple at or after it falls before the next index.
    i = F.ceil(at * most / n)
    return numbered.where((n <= most) | ((i < most) & (F.floor(i * n / most) == at))).select(*df.columns)


def threshold_crossing(df: DataFrame, by: Sequence[str], x: str, y: str, threshold: float) -> DataFrame:
    """The x at which y first reaches the threshold, by log-log interpolation with the point before.

    0 if the first point is there already, infinity if none is.
    """
    p = prefix(df)
    w = Window.partitionBy(*by).orderBy(x)
    px, py, hit = (f"{p}{n}" for n in ("px", "py", "hit"))
    steps = df.withColumn(px, F.lag(x).over(w)).withColumn(py, F.lag(y).over(w)).withColumn(hit, F.col(y) >= threshold)
    first = steps.groupBy(*by).agg(F.min_by(F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(px).alias("px"), F.col(py).alias("py")), F.when(F.col(hit), F.col(x))).alias(f"{p}p"))
    at = F.col(f"{p}p")
    t = (F.ln(F.lit(threshold)) - F.ln(at["py"])) / (F.ln(at["y"]) - F.ln(at["py"]))
    value = F.when(at.isNull(), float("inf")).when(at["px"].isNull(), 0.0).otherwise(F.exp(F.ln(at["px"]) + t * (F.ln(at["x"]) - F.ln(at["px"]))))
    return first.select(*by, value.alias("crossing"))


def moved(now: Column, before: Column, now_spread: Column, before_spread: Column) -> Column:
    """How a value that should fall moved: flat, lost, unqualified, improved or regressed.

    Without a finite value before: flat. Without one now: lost. Without a
    finite spread on both sides: unqualified, as nobody knows the noise. Else
    improved or regressed by more than the larger spread (a negative one
    counts as 0), or flat.
    """
    zero = F.lit(0.0)
    bar = F.greatest(F.greatest(now_spread, zero), F.greatest(before_spread, zero))
    delta = now - before
    return F.when(~finite(before), "flat").when(~finite(now), "lost").when(~finite(now_spread) | ~finite(before_spread), "unqualified").when(delta < -bar, "improved").when(delta > bar, "regressed").otherwise("flat")


def movement(df: DataFrame, by: Sequence[str], order: str, value: str, spread: str) -> DataFrame:
    """Add ``movement``: each round against the one before, see ``moved``; the first round of a group is flat."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("movement", moved(F.col(value), F.lag(value).over(w), F.col(spread), F.lag(spread).over(w)))


def classify_rounds(df: DataFrame, by: Sequence[str], order: str, metric: str, value: str, spread: str, tracked: Sequence[str]) -> DataFrame:
    """One row a round: improved and regressed (sorted metrics; lost ones count as regressed), improving and qualified.

    df has a row for each round and metric; a tracked metric that a round
    lacks has no value there. improving: something improved and nothing
    regressed. qualified: no metric was unqualified. The first round has moved
    in nothing. Metrics that aren't tracked are ignored.
    """
    given = df.where(F.col(metric).isin(*tracked)).select(*by, order, F.col(metric).alias("_metric"), F.col(value).cast("double").alias("_value"), F.col(spread).cast("double").alias("_spread"))
    every = df.select(*by, order).distinct().withColumn("_metric", F.explode(F.array(*map(F.lit, tracked))))
    full = every.join(given, [*by, order, "_metric"], "left")
    steps = movement(full, [*by, "_metric"], order, "_value", "_spread")
    names = lambda *kinds: F.array_sort(F.collect_set(F.when(F.col("movement").isin(*kinds), F.col("_metric"))))  # noqa: E731 - at most the tracked metrics
    out = steps.groupBy(*by, order).agg(names("improved").alias("improved"), names("regressed", "lost").alias("regressed"), (F.count_if(F.col("movement") == "unqualified") == 0).alias("qualified"))
    return out.withColumn("improving", (F.size("improved") > 0) & (F.size("regressed") == 0))


def rank_rounds(values: DataFrame, gates: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by``, metric, median, gate_max, gate_fraction and spread: the ranking vector of rounds in units of their gates.

    values: ``by``, metric, median, spread. gates: metric, gate_max,
    provisional; every tracked metric needs one that isn't provisional, so
    rows without such a gate have ``scorable`` false and no fraction. A gate of
    0 makes the fraction infinite.
    """
    limits = gates.select(F.col("metric").alias("_metric"), "gate_max", F.coalesce("provisional", F.lit(False)).alias("_provisional"))
    j = values.join(limits, F.col("metric") == F.col("_metric"), "left")
    scorable = F.col("_metric").isNotNull() & ~F.coalesce("_provisional", F.lit(False))
    fraction = F.when(F.col("gate_max") == 0, float("inf")).otherwise(F.col("median") / F.nullif("gate_max", F.lit(0.0)))
    return j.select(*by, "metric", "median", "spread", "gate_max", F.when(scorable, fraction).alias("gate_fraction"), scorable.alias("scorable"))


def overlaps(intervals: DataFrame, start: str, length: float, dwell: float) -> DataFrame:
    """The steps of a clock of period ``dwell`` that [start, start + length) meets, with the share of the interval in each."""
    a, b = F.col(start), F.col(start) + length
    step = F.explode(F.sequence(F.floor(a / dwell), F.ceil(b / dwell) - 1))
    spread = intervals.withColumn("step", step)
    inside = F.least(b, (F.col("step") + 1) * dwell) - F.greatest(a, F.col("step") * dwell)
    return spread.withColumn("weight", inside / length).where("weight > 0")


def best_rounds(df: DataFrame, by: Sequence[str], order: str, values: Sequence[str], spreads: Sequence[str]) -> DataFrame:
    """The rounds of each group, each with the best round so far (``best``).

    A round takes over if some value improved on the best round's and none
    regressed or was lost, as ``moved`` says; unqualified ones count for
    nothing, and the first round is best by default. A fold over the rounds of
    a group: one small row a round.
    """
    rounds = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, *values, *spreads))).alias("_r"))

    def fold(state: Column, x: Column) -> Column:
        best = state["best"]
        steps = [moved(x[v], best[v], x[s], best[s]) for v, s in zip(values, spreads, strict=True)]
        better, worse = F.lit(False), F.lit(False)
        for step in steps:
            better, worse = better | (step == "improved"), worse | step.isin("regressed", "lost")
        better = better & ~worse
        now = F.when(best.isNull() | better, x).otherwise(best)
        return F.struct(now.alias("best"), F.array_append(state["seen"], F.struct(x[order].alias(order), now[order].alias("best"))).alias("seen"))

    kind = rounds.schema["_r"].dataType.elementType
    row = kind.simpleString()
    key = kind[order].dataType.simpleString()
    start = F.struct(F.lit(None).cast(row).alias("best"), F.array().cast(f"array<struct<{order}:{key},best:{key}>>").alias("seen"))
    return rounds.select(*by, F.inline(F.aggregate("_r", start, fold, lambda s: s["seen"])))


# Frames of a capture: rows (group, position, lit), lit the lit fraction of the frame

#: Where a frame counts as white or black, relative to the brightest, and how far apart the kinds must be
WHITE_CUT, BLACK_CUT, LEAST_MARGIN = 0.75, 0.25, 0.15


def classify_frames(frames: DataFrame, by: Sequence[str], lit: str = "lit") -> DataFrame:
    """The frames with ``kind`` (white, black or patterned) and the ``margin`` of their group.

    The margin is the lesser gap between neighbouring kinds that are there, at
    least 0: without black frames that between white and patterned counts. It
    is 0 without patterned frames, as then there is no gap. A group without
    light is all black, with margin 0; a null ``lit`` is patterned.
    """
    group = Window.partitionBy(*by)
    peak = F.max(lit).over(group)
    part = F.when(peak > 0, F.col(lit) / F.when(peak > 0, peak)).otherwise(0.0)
    p = prefix(frames)
    parts = frames.withColumn(f"{p}part", part)
    kind = F.when(F.col(f"{p}part") > WHITE_CUT, "white").when(F.col(f"{p}part") < BLACK_CUT, "black").otherwise("patterned")
    kinds = parts.withColumn("kind", kind)
    of = lambda f, k: f(F.when(F.col("kind") == k, F.col(f"{p}part"))).over(group)
    gap = F.least(of(F.min, "white") - of(F.max, "patterned"), of(F.min, "patterned") - of(F.max, "black"))  # of two, one may be null
    return kinds.withColumn("margin", F.greatest(F.lit(0.0), F.coalesce(gap, F.lit(0.0)))).select(*frames.columns, "kind", "margin")


def index_by_order(frames: DataFrame, by: Sequence[str], order: Sequence[str], run: int, runs: int) -> DataFrame:
    """The frames with ``assigned``, their place in the capture (null beyond it), and ``ok``: the group has run * runs frames."""
    w = Window.partitionBy(*by)
    at = F.row_number().over(w.orderBy(*order)) - 1
    return frames.withColumn("assigned", F.when(at < run * runs, at)).withColumn("ok", F.count("*").over(w) == run * runs)


def index_by_bookends(frames: DataFrame, by: Sequence[str], order: str, plan: Sequence[str], runs: int, lit: str = "lit") -> DataFrame:
    """The frames with ``assigned`` (null where not placed) and ``problem``: why their run, or their whole group, is refused.

    plan: the kinds of one run. Its leading kinds up to the first patterned
    one mark where a run starts; each start is found anew, so a fault inside a
    run costs that run only. Refused whole: ``no-bookends`` (the plan begins
    patterned), ``margin`` (below ``LEAST_MARGIN``), ``runs`` (not ``runs``
    starts found). Refused alone: ``before`` (frames ahead of the first
    start), ``length`` and ``kinds`` (a run that differs from the plan).
    """
    head = next((i for i, k in enumerate(plan) if k == "patterned"), len(plan))
    if head == 0:
        return frames.withColumn("assigned", F.lit(None).cast("int")).withColumn("problem", F.lit("no-bookends"))
    p = prefix(frames)
    group, w = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(order)
    seen = classify_frames(frames, by, lit).withColumnsRenamed({"kind": f"{p}kind", "margin": f"{p}margin"})
    hit = F.lit(True)
    for i in range(head):
        hit = hit & F.coalesce(F.lead(f"{p}kind", i).over(w) == plan[i], F.lit(False))
    marks = seen.withColumn(f"{p}hit", hit).withColumn(f"{p}i", F.row_number().over(w))
    if head > 1:
        # A head may begin inside the one before. Of each chain of such hits, every one is taken that doesn't overlap the last taken.
        hits = marks.where(f"{p}hit").select(*by, f"{p}i")
        near = F.coalesce(F.col(f"{p}i") - F.lag(f"{p}i").over(Window.partitionBy(*by).orderBy(f"{p}i")) < head, F.lit(False))
        chains = hits.withColumn(f"{p}chain", F.sum((~near).cast("int")).over(Window.partitionBy(*by).orderBy(f"{p}i"))).groupBy(*by, f"{p}chain").agg(F.array_sort(F.collect_list(f"{p}i")).alias(f"{p}at"))
        taken = F.aggregate(f"{p}at", F.array().cast("array<int>"), lambda got, i: F.when((F.size(got) == 0) | (i >= F.try_element_at(got, F.lit(-1)) + head), F.array_append(got, i)).otherwise(got))
        starts = chains.select(*(F.col(c).alias(f"{p}b{k}") for k, c in enumerate(by)), F.explode(taken).alias(f"{p}start"))
        same = [F.col(c).eqNullSafe(F.col(f"{p}b{k}")) for k, c in enumerate(by)]
        marks = marks.join(starts, [*same, F.col(f"{p}i") == F.col(f"{p}start")], "left").withColumn(f"{p}hit", F.col(f"{p}start").isNotNull())
    numbered = marks.withColumn(f"{p}run", F.sum(F.col(f"{p}hit").cast("int")).over(w) - 1)
    within = Window.partitionBy(*by, f"{p}run")
    at = F.row_number().over(within.orderBy(order)) - 1
    placed = numbered.withColumns({f"{p}at": at, f"{p}length": F.count("*").over(within), f"{p}runs": F.sum(F.col(f"{p}hit").cast("int")).over(group)})
    wanted = F.get(F.array(*map(F.lit, plan)), F.col(f"{p}at"))
    same = F.min((F.col(f"{p}kind") == wanted).cast("int")).over(within) == 1
    problem = F.when(F.col(f"{p}margin") < LEAST_MARGIN, "margin").when(F.col(f"{p}runs") != runs, "runs").when(F.col(f"{p}run") < 0, "before").when(F.col(f"{p}length") != len(plan), "length").when(~same, "kinds")
    judged = placed.withColumn("problem", problem)
    return judged.withColumn("assigned", F.when(F.col("problem").isNull(), F.col(f"{p}run") * len(plan) + F.col(f"{p}at")).cast("int")).select(*frames.columns, "assigned", "problem")
