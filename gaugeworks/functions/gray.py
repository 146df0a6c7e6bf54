"""Gray code and wrapped phase."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_gray(n: Column) -> Column:
    return n.bitwiseXOR(F.shiftright(n, 1))


def from_gray(g: Column) -> Column:
    """Undo ``to_gray`` for any value of 64 bits from 0: each step doubles the bits already right."""
    for shift in (1, 2, 4, 8, 16, 32):
        g = g.cast("long").bitwiseXOR(F.shiftright(g.cast("long"), shift))
    return g


def pattern_bit(index: Column, bits: int, j: int) -> Column:
    """Bit ``j`` of the Gray code of an index, the highest of ``bits`` first."""
    return F.shiftright(to_gray(index), bits - 1 - j).bitwiseAND(F.lit(1))


def phase(samples: list[Column]) -> tuple[Column, Column]:
    """(phase in 0..2 pi, amplitude) of equally spaced samples of one period."""
    n = len(samples)
    s = sum((v * math.sin(2 * math.pi * k / n) for k, v in enumerate(samples)), F.lit(0.0))
    c = sum((v * math.cos(2 * math.pi * k / n) for k, v in enumerate(samples)), F.lit(0.0))
    angle = F.atan2(s, c)
    return F.when(angle < 0, angle + 2 * math.pi).otherwise(angle), 2.0 / n * F.sqrt(s * s + c * c)
