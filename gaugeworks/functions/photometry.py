"""Ramps, transfer functions and colour, as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(x: Column) -> Column:
    """Cut to 0..1; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


RAMPS = ("linear", "cosine", "smoothstep", "gaussian")


def ramp(shape: str, x: Column) -> Column:
    """A blend ramp from 0 to 1 (x outside is cut): linear, cosine, smoothstep or gaussian (scaled to reach exactly 0 and 1)."""
    t = unit(x)
    if shape == "linear":
        return t
    if shape == "cosine":
        return (1 - F.cos(t * math.pi)) / 2
    if shape == "smoothstep":
        return t * t * (3 - 2 * t)
    if shape == "gaussian":
        floor = math.exp(-4.5)  # fixed value: the shape's width
        return (F.exp(-4.5 * (1 - t) * (1 - t)) - floor) / (1 - floor)
    raise ValueError(f"unknown ramp {shape!r}; expected one of {', '.join(RAMPS)}")


def ramp_weight(shape: str, x: Column, gamma: float) -> Column:
    """The ramp raised to a positive finite power, 0 where the ramp is."""
    if not (0 < gamma < math.inf):
        raise ValueError(f"gamma must be positive and finite, not {gamma}")
    w = ramp(shape, x)
    return F.when(w == 0, 0.0).otherwise(F.pow(w, F.lit(float(gamma))))


def crossfade_sum(shape: str, gamma: float, x: Column) -> Column:
    """What two mirrored ramps add up to at a place, before they are normalised."""
    return ramp_weight(shape, x, gamma) + ramp_weight(shape, 1 - x, gamma)


def crossfade_weight(shape: str, gamma: float, x: Column) -> Column:
    """The part of the first of two mirrored ramps; 0 where neither shows."""
    total = crossfade_sum(shape, gamma, x)
    return F.when(total > 0, ramp_weight(shape, x, gamma) / F.when(total > 0, total)).otherwise(0.0)


def emitted(signal: Column, gamma: float, gain: float, black: float) -> Column:
    """Radiance of a signal in 0..1: a power law on a black floor, so that full white is ``gain`` whatever the floor."""
    return F.lit(gain) * (F.lit(1 - black) * F.pow(unit(signal), F.lit(gamma)) + F.lit(black))


def signal_for(radiance: Column, gamma: float, gain: float, black: float) -> Column:
    """The signal that emits a radiance: ``emitted`` undone; NaN below the floor, above full white, or without gain."""
    if not gain > 0:
        return F.lit(math.nan)
    above = (radiance / gain - black) / (1 - black)
    return F.when((above >= 0) & (above <= 1), F.pow(above, F.lit(1 / gamma))).otherwise(math.nan)


#: The published tuning constants of the two losses
HUBER_K, CAUCHY_C = 1.86, 2.3849


def robust_loss(s: Column, kind: str = "huber", tuning: float | None = None) -> tuple[Column, Column]:
    """(loss, weight) of a standardised residual: huber, cauchy or none; the square and 1 where it is small."""
    a, square = F.abs(s), s * s
    if kind == "huber":
        k = HUBER_K if tuning is None else tuning
        return F.when(a <= k, square).otherwise(k * (2 * a - k)), F.when(a <= k, 1.0).otherwise(k / F.when(a > k, a))
    if kind == "cauchy":
        c2 = (CAUCHY_C if tuning is None else tuning) ** 2
        return c2 * F.log(1 + square / c2), 1 / (1 + square / c2)
    if kind == "none":
        return square, F.lit(1.0)
    raise ValueError(f"unknown loss {kind!r}")


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Rec. 709 weights."""
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def polar_mask(lat_deg: Column, low: float, high: float, bottom_only: bool = True, colatitude: bool = False) -> Column:
    """1 where visible, 0 where masked, with a cosine feather between two latitudes (or colatitudes)."""
    onset, full = (90 - high, 90 - low) if colatitude else (low, high)
    a = F.abs(lat_deg)
    feather = 0.5 + 0.5 * F.cos((a - onset) / (full - onset) * math.pi) if full != onset else F.lit(0.0)
    shown = F.when(a <= onset, 1.0).when(a >= full, 0.0).otherwise(feather)
    return F.when(lat_deg >= 0, 1.0).otherwise(shown) if bottom_only else shown
