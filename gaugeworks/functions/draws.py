"""Random draws that are functions of their seed and index: the same in every task, order and engine.

32-bit words are kept in longs; nothing here runs a job or leaves the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = 0xFFFFFFFF
# The published Murmur3 finaliser, and the golden-ratio step between the values of a key
_FIRST, _SECOND, _STEP = 0x85EBCA6B, 0xC2B2AE35, 0x9E3779B9


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once however often f uses it: nested uses would else double the expression each time."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _times(h: Column, factor: int) -> Column:
    """The low 32 bits of a product, in two halves so that no product leaves 63 bits."""
    low = (h.bitwiseAND(F.lit(0xFFFF)) * factor).bitwiseAND(F.lit(_WORD))
    high = F.shiftleft((F.shiftright(h, 16) * factor).bitwiseAND(F.lit(0xFFFF)), 16)
    return (low + high).bitwiseAND(F.lit(_WORD))


def hash_word(x: Column) -> Column:
    """The Murmur3 finaliser of the low 32 bits, as a long from 0."""
    folded = lambda bits: lambda h: h.bitwiseXOR(F.shiftright(h, bits))
    h = _let(x.cast("long").bitwiseAND(F.lit(_WORD)), folded(16))
    h = _let(_let(h, lambda v: _times(v, _FIRST)), folded(13))
    return _let(_let(h, lambda v: _times(v, _SECOND)), folded(16))


def uniform(*key: Column) -> Column:
    """A number in [0, 1) that a key of whole numbers fixes."""
    h = F.lit(_STEP).cast("long")
    for part in key:
        h = (hash_word(h.bitwiseXOR(part.cast("long").bitwiseAND(F.lit(_WORD)))) + _STEP).bitwiseAND(F.lit(_WORD))
    return hash_word(h) * 2.0**-32


def uniforms(count: int, *key: Column) -> Column:
    """An array of ``count`` uniforms: those of the key with 0, 1, ... as its last part. One expression, however many."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: uniform(*key, k))


def box_muller(first: Column, second: Column) -> Column:
    """A normal draw of two uniforms; the first is kept off 0."""
    return F.sqrt(-2 * F.log(first + 2.0**-33)) * F.cos(2 * math.pi * second)


def standard_normal(*key: Column) -> Column:
    """A normal draw of a key, from its uniforms 0 and 1."""
    return box_muller(uniform(*key, F.lit(0)), uniform(*key, F.lit(1)))


#: Fixed value: a standard normal lies within so much of 0 with 90 %
WITHIN_90 = 1.6448536269514722


def log_normal(low: float, high: float, normal: Column) -> Column:
    """A lognormal draw with 90 % between ``low`` and ``high``: its median is their geometric mean."""
    mu, sigma = (math.log(low) + math.log(high)) / 2, (math.log(high) - math.log(low)) / (2 * WITHIN_90)
    return F.exp(F.lit(mu) + F.lit(sigma) * normal)


def radical_inverse(index: Column, base: int) -> Column:
    """The digits of an index in a base, mirrored behind the point: a low-discrepancy sequence."""
    if base < 2:
        raise ValueError(f"base must be at least 2, not {base}")
    digits = math.ceil(63 / math.log2(base))
    start = F.struct(F.lit(0.0).alias("v"), index.cast("long").alias("i"), F.lit(1.0 / base).alias("f"))
    step = lambda s, _: F.struct((s["v"] + (s["i"] % base) * s["f"]).alias("v"), F.floor(s["i"] / base).alias("i") if base > 2 else F.shiftright(s["i"], 1).alias("i"), (s["f"] / base).alias("f"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(digits)), start, step, lambda s: s["v"])
