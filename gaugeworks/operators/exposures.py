"""What the shutter of a camera saw of a sequence of steps, and the times at which shutters open."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws
from .names import prefix

#: Mean and spread, in seconds, of the reaction to a tone
REACTION = (0.25, 0.08)


def straddles(opened: Column, exposure: Column, dwell: Column | float) -> Column:
    """Whether a step of a clock of period ``dwell`` begins strictly while the shutter is open; null if an argument is."""
    step = F.lit(dwell)
    return F.floor(opened / step) * step + step < opened + exposure


def blend(df: DataFrame, opened: str, exposure: str, dwell: float, late: float = 0.0, jitter: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each row once for every step its exposure met, with ``step`` and ``weight``, the share of the exposure in it.

    Step m begins at m * (dwell + late), after step 0 delayed by ``jitter(m)``,
    which must be at least 0 and less than a period. A step that is met for no
    time is no part. Rows whose times are null or not finite, or whose exposure
    isn't positive, give no rows; step and weight replace columns of that name.
    """
    period = dwell + late
    if not period > 0:
        raise ValueError("a step must last")
    p = prefix(df)
    a, b, m = F.col(opened).cast("double"), F.col(opened).cast("double") + F.col(exposure).cast("double"), F.col(f"{p}step")
    begins = lambda k: k * period + (F.when(k > 0, jitter(k)).otherwise(0.0) if jitter else 0.0)
    # A delay is shorter than a step, so at most one step before that of the opening is still on.
    first = F.floor(a / period) - (1 if jitter else 0)
    sound = (F.abs(a) < float("inf")) & (F.abs(b) < float("inf")) & (b > a)
    every = df.where(sound).withColumn(f"{p}step", F.explode(F.sequence(first, F.floor(b / period))))
    inside = (F.least(b, begins(m + 1)) - F.greatest(a, begins(m))) / (b - a)
    others = [c for c in df.columns if c not in ("step", "weight")]
    return every.select(*others, m.alias("step"), inside.alias("weight")).where("weight > 0")


def content_majority(parts: DataFrame, by: Sequence[str], row: str) -> DataFrame:
    """``by``, step and share of the photographs of which one step has more than half the light.

    parts: a row for each read-out row of a photograph and each step in it
    (step, weight); a step's share is its weight averaged over the
    photograph's rows. Others, exact halves among them, give no row.
    """
    rows = parts.groupBy(*by, row, "step").agg(F.sum("weight").alias("_w"))
    shares = rows.groupBy(*by, "step").agg(F.sum("_w").alias("_w"))
    sizes = parts.groupBy(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(by))).agg(F.count_distinct(row).alias("_rows"))
    both = shares.join(sizes, [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)])
    return both.select(*by, "step", (F.col("_w") / F.col("_rows")).alias("share")).where("share > 0.5")


def shot_times(captures: DataFrame, seed: str, positions: int, frames: int, dwell: float, phase: str, drift_ppm: float = 0.0, jitter: float = 0.0) -> DataFrame:
    """The columns of each capture with position, filed_step and opened, in seconds from the start of the position.

    phase: ``uniform`` over the dwell, ``on-tick`` (a reaction after the step
    began) or ``aimed`` (the middle of the dwell, give or take a quarter).
    The camera's clock runs fast or slow by ``drift_ppm``, the sign drawn once
    a capture; the start is drawn once a position, and ``jitter`` is the
    spread of each shot. All draws are functions of the capture's ``seed``.
    """
    s, at, j = F.col(seed), F.col("position"), F.col("filed_step")
    u = draws.uniform(s, F.lit(1), at)
    starts = {"uniform": u * dwell, "aimed": dwell / 2 + (u - 0.5) * (dwell / 2), "on-tick": F.pmod(REACTION[0] + REACTION[1] * draws.standard_normal(s, F.lit(1), at), F.lit(dwell))}
    if phase not in starts:
        raise ValueError(f"unknown phase {phase}")
    rate = 1 + F.when(draws.uniform(s, F.lit(0)) < 0.5, -drift_ppm).otherwise(drift_ppm) / 1e6
    shake = jitter * draws.standard_normal(s, F.lit(2), at, j) if jitter > 0 else F.lit(0.0)
    whole = captures.withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(positions - 1)))).withColumn("filed_step", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))))
    return whole.withColumn("opened", j * dwell / rate + starts[phase] + shake)


def break_capture(shots: DataFrame, by: Sequence[str], at: str, seed: Column, drops: int, dupes: int) -> DataFrame:
    """The shots of each capture with ``drops`` of them lost and ``dupes`` taken twice; ``copy`` counts a shot's copies from 0.

    at: the shot's number, which with ``by`` is unique and not null. The
    lost ones have the least draws of their capture, and one shot always
    stays; each repeated one is drawn among those that are left, so one may be
    drawn twice. Draws are functions of ``seed`` and the number.
    """
    p = prefix(shots)
    w = Window.partitionBy(*by)
    ranked = shots.withColumn(f"{p}place", F.row_number().over(w.orderBy(draws.uniform(seed, F.lit(3), F.col(at)), at))).withColumn(f"{p}n", F.count("*").over(w))
    left = F.least(F.lit(drops), F.col(f"{p}n") - 1)
    kept = ranked.where(F.col(f"{p}place") > left).withColumn(f"{p}place", F.col(f"{p}place") - left - 1).withColumn(f"{p}n", F.col(f"{p}n") - left)
    picks = sum(((F.floor(draws.uniform(seed, F.lit(4), F.lit(d)) * F.col(f"{p}n")) == F.col(f"{p}place")).cast("int") for d in range(dupes)), F.lit(0))
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(0), picks))).select(*shots.columns, "copy")
