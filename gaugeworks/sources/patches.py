"""What a measured rig would change in a site's settings file, and the file with only those numbers changed."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Inches in a metre
INCHES = 1 / 0.0254
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+', re.S)
_JSON_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")


def hundredths(value: Column) -> Column:
    """Rounded to two decimals, halves upwards, as the file is written."""
    return F.floor(value * 100 + 0.5) / 100


def rig_proposals(projectors: DataFrame, path: str = "path") -> DataFrame:
    """``path``, env_name, to: the settings that a rig states, in inches.

    projectors: ``path``, id, x, y, z (a lens in metres from the body's centre)
    and centre_height (of that centre above the floor, one a rig). Ids P1, P2,
    ... give ``_DIST_INCHES`` (level distance) and ``_HEIGHT_INCHES`` (above the
    floor) under their own number, other ids under their whole id with a null
    value, as no setting can hold them. A rig whose rows differ in
    centre_height takes the greatest. Null ids and ids that repeat give rows
    like any other; values that aren't finite give null.
    """
    known = F.rlike("id", F.lit(r"^P\d+$"))
    name = F.when(known, F.concat(F.lit("P"), F.regexp_extract("id", r"\d+", 0).cast("decimal(38,0)").cast("string"))).otherwise(F.col("id"))
    sane = lambda c: F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)
    pair = F.array(
        F.struct(F.concat(name, F.lit("_DIST_INCHES")).alias("env_name"), F.when(known, sane(F.hypot("x", "y") * INCHES)).alias("to")),
        F.struct(F.concat(name, F.lit("_HEIGHT_INCHES")).alias("env_name"), F.when(known, sane((F.col("z") + F.col("centre_height")) * INCHES)).alias("to")),
    )
    height = projectors.groupBy(path).agg(F.max(sane(F.col("centre_height")) * INCHES).alias("to"))
    each = projectors.select(path, F.explode(pair).alias("_p")).select(path, "_p.env_name", "_p.to")
    return height.select(path, F.lit("SPHERE_HEIGHT_AT_EQUATOR_INCHES").alias("env_name"), "to").unionByName(each)


def settings_patch(settings: DataFrame, proposals: DataFrame, path: str = "path") -> DataFrame:
    """``path``, env_name, setting, from, to, state of each proposal.

    settings: as ``alignments.parse_settings`` gives them. state is ``missing``
    (no setting of that name, or no value to write), ``same`` (equal to two
    decimals) or ``changed``; from is null where the file has no number. Names
    are compared in capitals; of settings with one name the last by its own
    name counts, of several proposals for one name the greatest value. One
    shuffle by (path, env_name) serves both sides.
    """
    key = [path, "env_name"]
    have = settings.where("env_name IS NOT NULL").groupBy(*key).agg(F.max(F.struct("setting", "value")).alias("_s"))
    want = proposals.select(path, F.upper("env_name").alias("env_name"), F.col("to").cast("double").alias("to")).groupBy(*key).agg(F.max("to").alias("to"))
    on = want[path].eqNullSafe(have[path]) & (want["env_name"] == have["env_name"])
    rows = want.join(have, on, "left").select(want[path], want["env_name"], F.col("_s.setting").alias("setting"), F.col("_s.value").alias("from"), "to")
    state = F.when(F.col("setting").isNull() | F.col("to").isNull(), "missing").when(hundredths(F.col("from")) == hundredths(F.col("to")), "same").otherwise("changed")
    return rows.withColumn("state", state)


def value_spans(text: str) -> dict[str, tuple[int, int]]:
    """Where the number of each setting's own ``value`` stands; values inside deeper objects and in strings don't count."""
    spans: dict[str, tuple[int, int]] = {}
    keys: list[str | None] = [None, None, None]
    depth, said = 0, None
    for token in _TOKEN.finditer(text):
        mark = token[0]
        if mark in ("{", "["):
            depth += 1
            if depth < 3:
                keys[depth] = None
        elif mark in ("}", "]"):
            depth -= 1
        elif depth < 3 and mark in (":", ","):
            keys[depth] = said if mark == ":" else None
        elif mark[0] == '"':
            said = json.loads(mark, strict=False)  # sound: settings come from documents that parsed
        elif depth == 2 and keys[2] == "value" and keys[1] is not None and _JSON_NUMBER.fullmatch(mark):
            spans[keys[1]] = token.span()
    return spans


def _edit(texts: pd.Series, changes: pd.Series) -> pd.DataFrame:
    def one(text, wanted):
        if text is None or wanted is None or not len(wanted):
            return text, None
        spans = value_spans(text)
        lost = sorted(w["setting"] for w in wanted if w["setting"] not in spans)
        if lost:
            return None, "no-number: " + ", ".join(lost)
        for w in sorted(wanted, key=lambda w: -spans[w["setting"]][0]):
            start, end = spans[w["setting"]]
            text = text[:start] + repr(float(w["to"])) + text[end:]
        return text, None

    return pd.DataFrame([one(*pair) for pair in zip(texts, changes, strict=True)], columns=["text", "problem"])


def patched_documents(documents: DataFrame, patch: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path``, ``text`` with the changed numbers in place and all else as it was, problem.

    A document with a setting to change that has no number of its own isn't
    written in part: its text is null and problem names those settings. Null
    texts and documents without changes stay. A document's changes are one row,
    as many as it has settings; one Arrow pass edits the texts.
    """
    changed = patch.where("state = 'changed'").groupBy(F.col(path).alias("_path")).agg(F.collect_set(F.struct("setting", hundredths(F.col("to")).alias("to"))).alias("_c"))
    rows = documents.select(F.col(path).alias(path), F.col(text).alias("_t")).join(changed, F.col(path).eqNullSafe(F.col("_path")), "left")
    edit = F.pandas_udf(_edit, "text string, problem string")
    return rows.select(path, edit("_t", "_c").alias("_e")).select(path, F.col("_e.text").alias(text), F.col("_e.problem").alias("problem"))


def alignment_text(translate: tuple[Column, Column], scale: tuple[Column, Column], rotate: Column, vertices: Column) -> Column:
    """The text that ``alignments.parse_alignments`` reads; vertices: array of (index, x, y), written by index. Null where a part is null."""
    number = lambda c: F.format_string("%.6f", c.cast("double"))
    line = lambda word, *c: F.concat_ws(" ", F.lit(word), *map(number, c))
    point = lambda v: F.concat_ws(" ", v["index"].cast("long").cast("string"), number(v["x"]), number(v["y"]))
    whole = F.lit(True)
    for c in (*translate, *scale, rotate, vertices):
        whole = whole & c.isNotNull()
    lines = F.concat(F.array(line("translate", *translate), line("scale", *scale), line("rotate", rotate)), F.transform(F.array_sort(vertices), point))
    return F.when(whole, F.concat(F.array_join(lines, "\n"), F.lit("\n")))
