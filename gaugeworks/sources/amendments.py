"""Amendments and waivers as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WAIVERS = "gate string, amendment string, amendmentTitle string, reason string, expires string, ceiling double, ceilingBasis string, scenarios array<string>"


def parse_amendments(documents: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path``, id, title, status and line of each ``## A-01 - Title`` heading of markdown documents.

    The status is the word of the first ``**Status:**`` line below the
    heading, in capitals; UNKNOWN without one. Lines count from 1. A document
    without headings, empty or null, gives no rows. One document is one row,
    so its lines are numbered without a shuffle of the text.
    """
    lines = documents.select(path, F.posexplode(F.split(text, "\n")).alias("_i", "_line"))
    # What follows the marks of a heading: a number, a dash of any length and the title; and of a status line: a word, in bold or not.
    below = F.when(F.rlike("_line", F.lit(r"^##\s")), F.trim(F.translate(F.substring("_line", 3, 1 << 20), "\t\r", "  ")))
    number = F.regexp_extract(below, r"^A-[0-9]+", 0)
    rest = F.ltrim(F.substr(below, F.length(number) + 1))
    title = F.trim(F.substring(rest, 2, 1 << 20))
    is_heading = F.coalesce((number != "") & F.substring(rest, 1, 1).isin("\u2014", "\u2013", "-") & (title != ""), F.lit(False))
    mark = "**Status:**"
    word = F.regexp_extract(F.regexp_replace(F.ltrim(F.translate(F.substring("_line", len(mark) + 1, 1 << 20), "\t", " ")), r"^\*\*?", ""), r"^[A-Za-z]+", 0)
    status = F.when(F.startswith(F.col("_line"), F.lit(mark)) & (word != ""), word)
    seen = lines.select(path, (F.col("_i") + 1).alias("_at"), F.when(is_heading, number).alias("_id"), F.when(is_heading, title).alias("_title"), status.alias("_status"))
    found = seen.where("_id IS NOT NULL OR _status IS NOT NULL")
    own = Window.partitionBy(path).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    under = found.withColumn("_under", F.max(F.when(F.col("_id").isNotNull(), F.col("_at"))).over(own)).where("_under IS NOT NULL")
    entries = under.groupBy(path, "_under").agg(F.max("_id").alias("id"), F.max(F.when(F.col("_id").isNotNull(), F.col("_title"))).alias("title"), F.min_by("_status", F.when(F.col("_status").isNotNull(), F.col("_at"))).alias("_status"))
    return entries.select(path, "id", "title", F.coalesce(F.upper("_status"), F.lit("UNKNOWN")).alias("status"), F.col("_under").alias("line"))


def read_amendments(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, id, title, status, line) of markdown files."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return parse_amendments(files)


def parse_waivers(documents: DataFrame, schema: str, text: str = "text") -> DataFrame:
    """(waiver, gate, amendment, title, reason, expires, ceiling, scenarios) of JSON files with the given schema name.

    A file of another schema, not valid JSON, or with a waiver that lacks a
    name, an argument or a date of the form yyyy-mm-dd stops the query with an
    error: a waiver that is silently ignored protects nobody. waiver numbers
    them from 0. A null document holds none.
    """
    parsed = documents.where(F.col(text).isNotNull()).select(F.from_json(text, f"schema string, waivers array<struct<{WAIVERS.replace(' ', ':').replace(',:', ', ')}>>").alias("_f"))
    right = F.coalesce((F.col("_f.schema") == schema) & F.col("_f.waivers").isNotNull(), F.lit(False))
    checked = parsed.select(F.when(right, F.col("_f.waivers")).otherwise(F.raise_error(F.lit(f"not a waiver file of schema {schema}")).cast(f"array<struct<{WAIVERS.replace(' ', ':').replace(',:', ', ')}>>")).alias("_w"))
    rows = checked.select(F.posexplode("_w").alias("waiver", "_w")).select("waiver", "_w.*")
    whole = F.lit(True)
    for c in ("gate", "amendment", "amendmentTitle", "reason", "expires", "ceilingBasis"):
        whole = whole & F.coalesce(F.length(c) > 0, F.lit(False))
    whole = whole & F.coalesce(F.rlike("expires", F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.lit(False))
    gate = F.when(whole, F.col("gate")).otherwise(F.raise_error(F.concat(F.lit("incomplete waiver for "), F.coalesce("gate", F.lit("?")))).cast("string"))
    return rows.select("waiver", gate.alias("gate"), "amendment", F.col("amendmentTitle").alias("title"), "reason", "expires", "ceiling", "scenarios")
