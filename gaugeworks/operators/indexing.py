"""Frames of a capture by what they show: block fingerprints, and runs whose complementary frames still add up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import prefix
from .noise import EVIDENCE_SHARE
from .quantiles import finite
from .sequences import index_by_bookends

#: Fixed value: how far a pair may miss white and black together, as a part of the modulation
PAIR_LIMIT = 0.15


def fingerprints(pixels: DataFrame, by: Sequence[str], x: str, y: str, value: str, blocks: int, width: int, height: int, mask: Column | None = None) -> DataFrame:
    """``by``, blocks, and two arrays of blocks * blocks entries in rows of blocks: values (means) and measured.

    pixels: a row a pixel, x and y from 0. The grid divides ``width`` and
    ``height`` evenly, the last block taking what is left. Pixels outside the
    frame, those that ``mask`` doesn't hold for, and values that aren't finite
    aren't measured; a block without any has value 0 and measured false. A
    frame without any measured pixel is a row of such blocks. Pixels that
    repeat weigh each time. Sums of a block are partial in every task, so
    frames of any number of pixels are never gathered; an empty table gives no rows.
    """
    if blocks < 1:
        raise ValueError("blocks must be at least 1")
    inside = F.col(x).between(0, width - 1) & F.col(y).between(0, height - 1)
    place = F.least(F.lit(blocks - 1), F.floor(F.col(y) * blocks / height)) * blocks + F.least(F.lit(blocks - 1), F.floor(F.col(x) * blocks / width))
    v = F.col(value).cast("double")
    good = inside & finite(v) & (mask if mask is not None else F.lit(True))
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    cells = pixels.select(*keys, F.when(good, place.cast("int")).alias("_b"), F.when(good, v).alias("_v")).groupBy(*names, "_b").agg(F.avg("_v").alias("_mean"))
    found = cells.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.when(F.col("_b").isNotNull(), F.struct("_b", "_mean")))).alias("_m"))
    every = F.sequence(F.lit(0), F.lit(blocks * blocks - 1))
    values = F.transform(every, lambda b: F.coalesce(F.try_element_at("_m", b), F.lit(0.0)))
    measured = F.transform(every, lambda b: F.try_element_at("_m", b).isNotNull())
    return found.select(*(F.col(k).alias(c) for k, c in zip(names, by, strict=True)), F.lit(blocks).alias("blocks"), values.alias("values"), measured.alias("measured"))


def pair_residual(a: Column, b: Column, white: Column, black: Column) -> Column:
    """How far fingerprints a and b, structs of values and measured, miss white and black together, over the modulation of the blocks that count.

    Blocks count that all four measured, with finite values, if their
    modulation is at least ``EVIDENCE_SHARE`` of the greatest. Null where none
    does, where there is no modulation, or where the grids differ.
    """
    parts = [c["values"] for c in (a, b, white, black)] + [c["measured"] for c in (a, b, white, black)]
    rows = F.arrays_zip(*(p.alias(f"c{i}") for i, p in enumerate(parts)))
    good = lambda r: r["c4"] & r["c5"] & r["c6"] & r["c7"] & finite(r["c0"]) & finite(r["c1"]) & finite(r["c2"]) & finite(r["c3"])
    cells = F.transform(F.filter(rows, good), lambda r: F.struct((r["c2"] - r["c3"]).alias("m"), F.abs(r["c0"] + r["c1"] - r["c2"] - r["c3"]).alias("g")))
    peak = F.array_max(F.transform(cells, lambda r: r["m"]))
    kept = F.filter(cells, lambda r: (peak > 0) & (r["m"] >= EVIDENCE_SHARE * peak))
    total = lambda name: F.aggregate(kept, F.lit(0.0), lambda s, r: s + r[name])
    same = F.lit(True)
    for p in parts[1:]:
        same = same & (F.size(p) == F.size(parts[0]))
    return F.when(same, F.try_divide(total("g"), total("m")))


def index_by_fingerprint(frames: DataFrame, by: Sequence[str], order: str, plan: Sequence[str], runs: int, pairs: Sequence[tuple[int, int]], least_blocks: int, lit: str = "lit", blocks: str = "blocks", values: str = "values", measured: str = "measured") -> DataFrame:
    """The frames with ``assigned``, ``problem`` and ``residual``: places by bookends, of runs in which each pair still adds up to white and black.

    frames: a row a photograph, with its fingerprint. pairs: places in the plan
    that show complements. Beside the problems of ``index_by_bookends``, a whole
    capture is refused for ``no-pairs``, ``outside`` (a pair beyond the plan),
    ``no-reference`` (no white or no black in the plan), ``shape`` (arrays that
    aren't blocks * blocks long), ``grids`` (frames of several grids) and
    ``coarse`` (fewer than ``least_blocks`` blocks, which would average the
    finest pattern away); a run for ``pair`` (the first pair that misses by
    more than ``PAIR_LIMIT``, whose residual is given), or else for
    ``unmeasured`` (a pair without evidence). A frame without a fingerprint is one of a wrong shape.

    Order must be unique within a capture; null keys make a capture like any
    other. A run is gathered in one row of as many fingerprints as the plan has
    frames; captures are never compared with each other. An empty table gives no rows.
    """
    empty = F.lit(None)
    out = [*frames.columns, "assigned", "problem", "residual"]
    fault = "no-pairs" if not pairs else "outside" if any(not 0 <= i < len(plan) for p in pairs for i in p) else "no-reference" if not {"white", "black"} <= {*plan} else None
    p = prefix(frames)
    placed = index_by_bookends(frames, by, order, plan, runs, lit).withColumnsRenamed({"assigned": f"{p}assigned", "problem": f"{p}problem"})
    if fault:
        problem = F.coalesce(f"{p}problem", F.lit(fault))
        return placed.withColumns({"assigned": empty.cast("int"), "problem": problem, "residual": empty.cast("double")}).select(*out)
    keys = [f"{p}k{i}" for i in range(len(by))]
    named = placed.withColumns({k: F.col(c) for k, c in zip(keys, by, strict=True)} | {f"{p}run": F.floor(F.col(f"{p}assigned") / len(plan)).cast("int")})
    size = F.col(blocks) * F.col(blocks)
    right = F.coalesce((F.size(values) == size) & (F.size(measured) == size), F.lit(False))
    whole = named.groupBy(*keys).agg(F.bool_and(right).alias(f"{p}right"), F.min(blocks).alias(f"{p}least"), F.max(blocks).alias(f"{p}most"))
    refused = F.when(~F.col(f"{p}right"), "shape").when(F.col(f"{p}least") < F.col(f"{p}most"), "grids").when(F.col(f"{p}least") < least_blocks, "coarse")
    whole = whole.select(*(F.col(k).alias(f"{k}w") for k in keys), refused.alias(f"{p}whole"))
    shown = F.struct((F.col(f"{p}assigned") % len(plan)).alias("at"), F.col(values).alias("values"), F.col(measured).alias("measured"))
    run = named.where(F.col(f"{p}run").isNotNull()).groupBy(*keys, f"{p}run").agg(F.array_sort(F.collect_list(shown), lambda a, b: a["at"] - b["at"]).alias(f"{p}shown"))
    frame = lambda i: F.get(f"{p}shown", F.lit(i))
    each = F.array(*(pair_residual(frame(a), frame(b), frame(plan.index("white")), frame(plan.index("black"))) for a, b in pairs))
    run = run.withColumn(f"{p}each", each)
    broken = F.get(F.filter(f"{p}each", lambda r: r > PAIR_LIMIT), F.lit(0))
    judged = F.when(broken.isNotNull(), "pair").when(F.exists(f"{p}each", lambda r: r.isNull()), "unmeasured")
    run = run.select(*(F.col(k).alias(f"{k}r") for k in keys), F.col(f"{p}run").alias(f"{p}which"), judged.alias(f"{p}judged"), broken.alias("residual"))
    on = lambda end: [F.col(k).eqNullSafe(F.col(f"{k}{end}")) for k in keys]
    both = named.join(whole, on("w"), "left") if keys else named.crossJoin(F.broadcast(whole))  # without keys one row
    both = both.join(run, [*on("r"), F.col(f"{p}run") == F.col(f"{p}which")], "left")
    problem = F.coalesce(F.col(f"{p}whole"), F.col(f"{p}problem"), F.col(f"{p}judged"))
    both = both.withColumn("problem", problem).withColumn("assigned", F.when(F.col("problem").isNull(), F.col(f"{p}assigned")))
    return both.withColumn("residual", F.when(F.col("problem") == "pair", F.col("residual"))).select(*out)
