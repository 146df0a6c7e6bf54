"""Colour difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import prefix

#: Fixed value of the published formula
_KNEE = 25.0**7


def _length(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def delta_e2000(df: DataFrame, first: tuple[str, str, str], second: tuple[str, str, str], alias: str) -> DataFrame:
    """Add CIEDE2000 of two Lab colours, with unit weights; null if any part is.

    Steps are columns of their own, so that none is computed twice; their
    names are ones that the table doesn't have.
    """
    p = prefix(df)
    c = lambda name: F.col(p + name)
    (l1, a1, b1), (l2, a2, b2) = (tuple(F.col(x).cast("double") for x in lab) for lab in (first, second))

    def step(table: DataFrame, **columns: Column) -> DataFrame:
        return table.withColumns({p + name: column for name, column in columns.items()})

    mean7 = F.pow((_length(a1, b1) + _length(a2, b2)) / 2, F.lit(7.0))
    out = step(df, g=1.5 - 0.5 * F.sqrt(mean7 / (mean7 + _KNEE)))
    hue_of = lambda a, b: F.pmod(F.degrees(F.atan2(b, a * c("g"))), F.lit(360.0))
    out = step(out, c1=_length(a1 * c("g"), b1), c2=_length(a2 * c("g"), b2), h1=hue_of(a1, b1), h2=hue_of(a2, b2))
    gap, total, grey = c("h2") - c("h1"), c("h1") + c("h2"), c("c1") * c("c2") == 0
    turn = F.when(grey, 0.0).when(F.abs(gap) <= 180, gap).when(gap > 180, gap - 360).otherwise(gap + 360)
    hue = F.when(grey, total).when(F.abs(gap) <= 180, total / 2).when(total < 360, total / 2 + 180).otherwise(total / 2 - 180)
    out = step(out, turn=turn, hue=hue, chroma=(c("c1") + c("c2")) / 2, off=F.pow((l1 + l2) / 2 - 50, F.lit(2.0)))
    cosine = lambda k, shift: F.cos(F.radians(k * c("hue") + shift))
    t = 1 - 0.17 * cosine(1, -30) + 0.24 * cosine(2, 0) + 0.32 * cosine(3, 6) - 0.20 * cosine(4, -63)
    chroma7 = F.pow(c("chroma"), F.lit(7.0))
    twist = -F.sin(F.radians(60 * F.exp(-F.pow((c("hue") - 275) / 25, F.lit(2.0))))) * 2 * F.sqrt(chroma7 / (chroma7 + _KNEE))
    out = step(
        out,
        dl=(l2 - l1) / (1 + 0.015 * c("off") / F.sqrt(20 + c("off"))),
        dc=(c("c2") - c("c1")) / (1 + 0.045 * c("chroma")),
        dh=2 * F.sqrt(c("c1") * c("c2")) * F.sin(F.radians(c("turn") / 2)) / (1 + 0.015 * c("chroma") * t),
        twist=twist,
    )
    total = c("dl") * c("dl") + c("dc") * c("dc") + c("dh") * c("dh") + c("twist") * c("dc") * c("dh")
    return out.select(*df.columns, F.sqrt(total).alias(alias))
