"""From photographed patterns to correspondences: Gray planes folded to an address, and refined by a wrapped phase."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import prefix
from .noise import noise_at
from .quantiles import finite

#: Why a pixel has no correspondence, in the order in which it is asked
REASONS = ("modulation", "mask", "gray", "phase", "disagree", "range", "missing", "segment")


@dataclass(frozen=True)
class Axis:
    """The frames of one axis, as positions in a pixel's stack, and what they show.

    patterns and inverses: Gray planes, highest bit first, ``stride`` projector
    pixels a code step. steps: evenly spaced samples of one cosine of ``period`` projector pixels.
    """

    res: float
    patterns: Sequence[int] = ()
    inverses: Sequence[int] = ()
    stride: float = 0.0
    steps: Sequence[int] = ()
    period: float = 0.0


@dataclass(frozen=True)
class Limits:
    """Fixed values, each of which a caller may set: the least modulation, bit separation and fringe amplitude (the last two
    as parts of the pixel's modulation), how far Gray and phase may differ (parts of a period), the noise of a sample where none is known, the least sigma."""

    modulation: float = 0.02
    separation: float = 0.25
    amplitude: float = 0.15
    tolerance: float = 0.4
    noise: float = 0.01
    sigma: float = 0.01


def apart(df: DataFrame, column: str) -> DataFrame:
    """df, its ``column`` passed through a lambda, which Spark evaluates outside the code that it makes of a whole stage.

    Else all steps of a decoding are one method of that code, longer than the
    JVM compiles (8,000 bytes), and each pixel is interpreted.
    """
    return df.withColumn(column, F.get(F.transform(F.array(column), lambda x: x), F.lit(0)))


def pixel_stacks(pixels: DataFrame, by: Sequence[str], frame: str, value: str, frames: int) -> DataFrame:
    """``by`` and ``stack``: a pixel's values in frames 0 to ``frames`` - 1, null where there is none.

    Rows of other frames are left out; of several values of one frame the least
    counts, NaN being the greatest. A pixel without any row of these frames is not there.
    """
    p = prefix(pixels)
    v = F.col(value).cast("double")
    rows = pixels.where(F.col(frame).between(0, frames - 1)).groupBy(*by).agg(*(F.min(F.when(F.col(frame) == i, v)).alias(f"{p}{i}") for i in range(frames)))
    return rows.select(*by, F.array(*(F.col(f"{p}{i}") for i in range(frames))).alias("stack"))


def reference_planes(stack: Column, axes: Sequence[Axis], white: int | None = None, black: int | None = None) -> tuple[Column, Column]:
    """(white, black) of a pixel: the frames of that name, or without both of them the most and the least of the Gray frames (phase frames, if there are no Gray ones).

    Values that aren't finite don't count; without any the two are null.
    """
    if white is not None and black is not None:
        return F.get(stack, F.lit(white)), F.get(stack, F.lit(black))
    frames = [i for a in axes for i in (*a.patterns, *a.inverses)] + [i for a in axes for i in a.steps]
    values = F.filter(F.array(*(F.get(stack, F.lit(i)) for i in frames)), finite)
    return F.array_max(values), F.array_min(values)


def fringe(df: DataFrame, stack: str, axis: Axis, alias: str) -> DataFrame:
    """df with ``alias``: struct(level, phase in 0..2 pi, amplitude, residual) of the samples of an axis; the residual is the length of what the cosine leaves."""
    p, n = prefix(df), len(axis.steps)
    samples = [F.get(stack, F.lit(i)) for i in axis.steps]
    total = lambda w: sum((s * x for s, x in zip(samples, w, strict=True)), F.lit(0.0))
    turn = [2 * math.pi * i / n for i in range(n)]
    fitted = df.withColumns({f"{p}l": total([1 / n] * n), f"{p}c": total([2 / n * math.cos(e) for e in turn]), f"{p}s": total([2 / n * math.sin(e) for e in turn])})
    fitted = apart(fitted, f"{p}l")
    level, c, s = (F.col(f"{p}{x}") for x in "lcs")
    left = [v - level - c * math.cos(e) - s * math.sin(e) for v, e in zip(samples, turn, strict=True)]
    fitted = fitted.withColumns({f"{p}a": F.atan2(s, c), f"{p}r": F.sqrt(sum((d * d for d in left), F.lit(0.0)))})
    angle = F.col(f"{p}a")
    phase = F.when(angle < 0, angle + 2 * math.pi).otherwise(angle)
    return fitted.select(*df.columns, F.struct(level.alias("level"), phase.alias("phase"), F.sqrt(c * c + s * s).alias("amplitude"), F.col(f"{p}r").alias("residual")).alias(alias))


def decode_axis(df: DataFrame, stack: str, axis: Axis, modulation: str, alias: str, limits: Limits = Limits(), noise: str | None = None) -> DataFrame:
    """df with ``alias``: struct(coord, sigma, modulation, reason) of one axis; reason is null where coord is good.

    A bit is one if its pattern is brighter than its inverse; a bit that
    separates by less than the least part of the modulation, and one of a value
    that isn't finite, makes the address ambiguous (``gray``). The phase picks
    the place within a period nearest to the address, and where they differ by
    more than the tolerance nothing is said (``disagree``); equal distances take
    the later period. ``phase``: the fringe is weak or not finite. ``range``: beyond the projector. ``missing``: the
    axis has no frames, or phases of several periods and no address. noise: a
    column, the noise of a sample; without it the pixel's own residual counts.
    Every step is a projection of its own, so that none repeats the one before.
    """
    p, m = prefix(df), F.col(modulation)
    none, bits, n = F.lit(None).cast("double"), len(axis.patterns), len(axis.steps)
    clear, word = F.lit(True), F.lit(0).cast("long")
    for i, j in zip(axis.patterns, axis.inverses, strict=True):
        a, b = F.get(stack, F.lit(i)), F.get(stack, F.lit(j))
        clear = clear & finite(a) & finite(b) & (F.abs(a - b) >= limits.separation * m)
        word = word * 2 + F.when(a > b, 1).otherwise(0)
    seen = apart(df.withColumns({f"{p}clear": F.coalesce(clear, F.lit(False)), f"{p}index": word}), f"{p}index")
    for shift in (1, 2, 4, 8, 16, 32):  # Gray code back to a number; each step doubles the bits that are right
        if shift < bits:
            seen = seen.withColumn(f"{p}index", F.col(f"{p}index").bitwiseXOR(F.shiftright(f"{p}index", shift)))
    seen = seen.withColumn(f"{p}coarse", (F.col(f"{p}index") + 0.5) * axis.stride if bits else none)
    coarse = F.col(f"{p}coarse")
    early = F.when(~F.col(f"{p}clear"), "gray") if bits else F.lit(None if n else "missing").cast("string")
    if n:
        seen = fringe(seen, stack, axis, f"{p}f")
        amplitude = F.col(f"{p}f.amplitude")
        early = F.coalesce(early, F.when(~F.coalesce(finite(amplitude) & (amplitude >= limits.amplitude * m), F.lit(False)), "phase"))
        seen = apart(seen.withColumn(f"{p}place", F.col(f"{p}f.phase") / (2 * math.pi) * axis.period), f"{p}place")
        place = F.col(f"{p}place")
        nearest = F.floor((coarse - place) / axis.period + 0.5) * axis.period + place
        seen = seen.withColumn(f"{p}coord", nearest if bits else place)
        late = F.when(F.abs(F.col(f"{p}coord") - coarse) > limits.tolerance * axis.period, "disagree") if bits else F.lit("missing" if axis.period < axis.res else None).cast("string")
        sample = F.col(noise) if noise else F.col(f"{p}f.residual") / math.sqrt(n - 3) if n > 3 else F.lit(limits.noise)
        sample = F.greatest(F.coalesce(sample, F.lit(limits.noise)), F.lit(limits.noise * 1e-3))
        sigma = F.greatest(F.try_divide(sample * (axis.period / (2 * math.pi) * math.sqrt(2 / n)), amplitude), F.lit(limits.sigma))
        share = F.try_divide(amplitude, m)
    else:
        seen = seen.withColumn(f"{p}coord", coarse)
        late, sigma, share = F.lit(None).cast("string"), F.lit(max(axis.stride / math.sqrt(12), limits.sigma)), m
    coord = F.col(f"{p}coord")
    seen = apart(seen.withColumn(f"{p}reason", F.coalesce(early, late, F.when((coord < 0) | (coord > axis.res), "range"))), f"{p}reason")
    good = F.col(f"{p}reason").isNull()
    return seen.select(*df.columns, F.struct(F.when(good, coord).alias("coord"), F.when(good, sigma).alias("sigma"), F.when(good, share).alias("modulation"), F.col(f"{p}reason").alias("reason")).alias(alias))


def decode(pixels: DataFrame, u: Axis, v: Axis, stack: str = "stack", white: int | None = None, black: int | None = None, limits: Limits = Limits(), model: DataFrame | None = None, mask: Column | None = None, segment: Column | None = None) -> DataFrame:
    """The pixels with proj_u, proj_v, sigma_u, sigma_v, modulation and ``reason``, which is null for a correspondence.

    model: (level, sigma), the noise of a sample by its level as
    ``noise.phase_noise`` gives; without it a pixel's own residual counts.
    mask: pixels that are looked at; segment: a condition on proj_u and proj_v, asked last.
    Of two axes that fail, u's reason is given. A pixel without a finite
    modulation is one of too little. Every pixel is its own: nothing is shuffled, repeated rows
    give repeated results, and an empty table gives no rows.
    """
    p = prefix(pixels)
    top, bottom = reference_planes(F.col(stack), [u, v], white, black)
    seen = apart(pixels.withColumn(f"{p}m", top - bottom), f"{p}m")
    noise = {}
    for name, axis in (("u", u), ("v", v)):
        if model is not None and axis.steps:
            level = fringe(seen, stack, axis, f"{p}f{name}").withColumn(f"{p}l{name}", F.col(f"{p}f{name}.level"))
            seen = noise_at(level, model, f"{p}l{name}", f"{p}n{name}")
            noise[name] = f"{p}n{name}"
    m = F.col(f"{p}m")
    for name, axis in (("u", u), ("v", v)):
        seen = decode_axis(seen, stack, axis, f"{p}m", f"{p}{name}", limits, noise.get(name))
    first = F.when(~F.coalesce(finite(m) & (m >= limits.modulation), F.lit(False)), "modulation")
    if mask is not None:
        first = F.coalesce(first, F.when(~F.coalesce(mask, F.lit(False)), "mask"))
    seen = apart(seen.withColumn("reason", F.coalesce(first, F.col(f"{p}u.reason"), F.col(f"{p}v.reason"))), "reason")
    good = F.col("reason").isNull()
    seen = seen.withColumns({
        "proj_u": F.when(good, F.col(f"{p}u.coord")), "proj_v": F.when(good, F.col(f"{p}v.coord")), "sigma_u": F.when(good, F.col(f"{p}u.sigma")), "sigma_v": F.when(good, F.col(f"{p}v.sigma")),
        "modulation": F.when(good, F.least(f"{p}u.modulation", f"{p}v.modulation")),
    })
    made = ["proj_u", "proj_v", "sigma_u", "sigma_v", "modulation"]
    if segment is not None:
        seen = seen.withColumn("reason", F.coalesce("reason", F.when(~F.coalesce(segment, F.lit(False)), "segment")))
        seen = seen.withColumns({c: F.when(F.col("reason").isNull(), F.col(c)) for c in made})
    return seen.select(*pixels.columns, *made, "reason")


def decode_counts(decoded: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by``, considered, accepted, and for each of ``REASONS`` how many pixels it cost: one partial aggregate."""
    each = [F.count_if(F.col("reason") == r).alias(f"rejected_{r}") for r in REASONS]
    return decoded.groupBy(*by).agg(F.count("*").alias("considered"), F.count_if(F.col("reason").isNull()).alias("accepted"), *each)


def epochs(axis: Axis) -> float:
    """When an axis was photographed, in frames: the mean place of its phase frames, or without any of its Gray frames; 0 without both."""
    frames = list(axis.steps) or [*axis.patterns, *axis.inverses]
    return sum(frames) / len(frames) if frames else 0.0
