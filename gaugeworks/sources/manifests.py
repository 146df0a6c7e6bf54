"""Capture plans as rows: what was projected, written beside the photographs and refused rather than guessed at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the format, version 1: the ranges that a plan may hold, both ends included
VERSION = 1
LIMITS = {"gray_bits": (1, 8), "phase_steps": (4, 12), "phase_period_strides": (2, 16)}
FIELDS = {"gray_bits": "$[0].plan.grayBits", "phase_steps": "$[0].plan.phaseSteps", "phase_period_strides": "$[0].plan.phasePeriodStrides", "width": "$[0].projectorRes.x", "height": "$[0].projectorRes.y", "projectors": "$[0].projectors"}
_NUMBERS = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"


def plan_text(gray_bits: Column, phase_steps: Column, phase_period_strides: Column, white_black: Column, width: Column, height: Column, projectors: Column, dwell_s: Column, written: Column) -> Column:
    """The JSON text of a capture plan; its frames for each run follow from the plan. Null numbers are left out, so such a text is refused when it is read."""
    plan = F.struct(gray_bits.alias("grayBits"), phase_steps.alias("phaseSteps"), phase_period_strides.alias("phasePeriodStrides"), white_black.alias("includeWhiteBlack"))
    return F.to_json(F.struct(
        F.lit(VERSION).alias("version"), plan.alias("plan"), F.struct(width.alias("x"), height.alias("y")).alias("projectorRes"), projectors.alias("projectors"),
        frames_per_run(gray_bits, phase_steps, white_black).alias("framesPerRun"), dwell_s.alias("dwellS"), written.alias("written"),
    ))


def frames_per_run(gray_bits: Column, phase_steps: Column, white_black: Column) -> Column:
    """White and black if there, then for both axes a plane and its inverse a bit, and the phase steps."""
    return (F.when(white_black, 2).otherwise(0) + 4 * gray_bits + 2 * phase_steps).cast("long")


def parse_plans(documents: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path``, gray_bits, phase_steps, phase_period_strides, width, height, projectors, white_black, frames_per_run, dwell_s, written, problems.

    problems is empty for a sound plan; otherwise all values are null and it
    holds either one of ``not-json`` (also null and empty texts, repeated keys),
    ``not-object``, ``version``, ``no-plan``, ``frames_per_run`` (the stated
    number isn't that of the plan), or all of the fields that are missing, no
    whole number or out of range, with ``odd`` for an odd number of strides.
    Numbers in quotes are no numbers; 4.0 is 4. dwell_s is 0 and written empty
    where they are missing, without a problem. Each document is read on its own.
    """
    # In brackets, so that a second value after the first is seen
    rows = documents.select(F.col(path).alias(path), F.try_parse_json(F.concat(F.lit("["), F.col(text), F.lit("]"))).alias("_v"))
    kind = lambda at: F.schema_of_variant(F.try_variant_get("_v", at, "variant"))
    number = lambda at: F.when(F.rlike(kind(at), F.lit(_NUMBERS)), F.try_variant_get("_v", at, "double"))
    whole = lambda at: F.when(number(at) == F.floor(number(at)), number(at))
    # A document's values are made once, as a row of their own, not once for each of their uses
    rows = rows.select(path, F.inline(F.array(F.struct(
        F.coalesce(kind("$"), F.lit("")).alias("_all"), F.coalesce(kind("$[0]"), F.lit("")).alias("_one"), kind("$[1]").isNotNull().alias("_more"), F.coalesce(kind("$[0].plan"), F.lit("")).alias("_plan"),
        number("$[0].version").alias("_version"), *(whole(at).alias(f) for f, at in FIELDS.items()), whole("$[0].framesPerRun").alias("_stated"), number("$[0].dwellS").alias("_dwell"),
        F.when(kind("$[0].plan.includeWhiteBlack") == "BOOLEAN", F.try_variant_get("_v", "$[0].plan.includeWhiteBlack", "boolean")).alias("white_black"),
        F.when(kind("$[0].written") == "STRING", F.try_variant_get("_v", "$[0].written", "string")).alias("_written"),
    ))))
    ok = lambda c: F.coalesce(c, F.lit(False))
    wrong = [F.when(~ok(F.col(f).between(*ends)), f) for f, ends in LIMITS.items()]
    wrong += [F.when(F.col("phase_period_strides").between(*LIMITS["phase_period_strides"]) & (F.col("phase_period_strides") % 2 != 0), "odd"), F.when(F.col("white_black").isNull(), "white_black")]
    wrong += [F.when(~ok((F.col("width") > 0) & (F.col("height") > 0)), "projector_res"), F.when(~ok(F.col("projectors") > 0), "projectors")]
    frames = frames_per_run(F.col("gray_bits"), F.col("phase_steps"), F.col("white_black"))
    fields = F.array_compact(F.array(*wrong))
    stopped = (
        F.when((F.col("_all") == "") | (F.col("_one") == "") | F.col("_more"), "not-json").when(~F.col("_one").startswith("OBJECT"), "not-object")
        .when(~ok(F.col("_version") == VERSION), "version").when(~F.rlike("_plan", F.lit("^(OBJECT|ARRAY)")), "no-plan")
        .when((F.size(fields) == 0) & (F.col("_stated") > 0) & (F.col("_stated") != frames), "frames_per_run")
    )
    others = [c for c in rows.columns if c != path]
    rows = rows.select(path, *others, F.explode(F.array(F.when(stopped.isNotNull(), F.array(stopped)).otherwise(fields))).alias("problems"))
    sound = lambda c: F.when(F.size("problems") == 0, c)
    return rows.select(
        path, *(sound(F.col(f)).cast("long").alias(f) for f in FIELDS), sound(F.col("white_black")).alias("white_black"), sound(frames).alias("frames_per_run"),
        sound(F.when(F.col("_dwell") > 0, F.col("_dwell")).otherwise(0.0)).alias("dwell_s"), sound(F.coalesce("_written", F.lit(""))).alias("written"), "problems",
    )


def plan_frames(plans: DataFrame, path: str = "path") -> DataFrame:
    """``path``, frame (from 0, in the order shown), kind, axis, index, seen and complement of each frame of a run; plans with problems have none.

    seen is what a photograph can tell without decoding (white, black,
    patterned); complement is the frame that shows the inverse plane, null for
    others. At most 58 frames a plan, so nothing is shuffled.
    """
    frame = lambda kind, axis, at: F.struct(F.lit(kind).alias("kind"), F.lit(axis).cast("string").alias("axis"), at.cast("int").alias("index"))
    planes = lambda axis: F.flatten(F.transform(F.sequence(F.lit(0), F.col("gray_bits") - 1), lambda j: F.array(frame("gray", axis, j), frame("grayInverse", axis, j))))
    steps = lambda axis: F.transform(F.sequence(F.lit(0), F.col("phase_steps") - 1), lambda j: frame("phase", axis, j))
    both = F.array(frame("white", None, F.lit(0)), frame("black", None, F.lit(0)))
    head = F.when(F.col("white_black"), both).otherwise(F.slice(both, 1, 0))
    rows = plans.where(F.size("problems") == 0).select(path, F.posexplode(F.concat(head, planes("u"), planes("v"), steps("u"), steps("v"))).alias("frame", "_f")).withColumn("frame", F.col("frame").cast("long"))
    seen = F.when(F.col("_f.kind").isin("white", "black"), F.col("_f.kind")).otherwise("patterned")
    other = F.when(F.col("_f.kind") == "gray", F.col("frame") + 1).when(F.col("_f.kind") == "grayInverse", F.col("frame") - 1)
    return rows.select(path, "frame", "_f.kind", "_f.axis", F.col("_f.index").cast("long").alias("index"), seen.alias("seen"), other.cast("long").alias("complement"))
