"""Transcripts as JSON lines: a torn or malformed line is skipped, never fatal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENS = ("uncached", "write_1h", "write_5m", "read", "output")
#: Where the parts of a line stand
_PATHS = {
    "id": "$.message.id", "role": "$.message.role", "model": "$.message.model", "ts": "$.timestamp", "session": "$.sessionId", "branch": "$.gitBranch", "usage": "$.message.usage",
    "speed": "$.message.usage.speed", "tier": "$.message.usage.service_tier",
    "uncached": "$.message.usage.input_tokens", "write_1h": "$.message.usage.cache_creation.ephemeral_1h_input_tokens", "write_5m": "$.message.usage.cache_creation.ephemeral_5m_input_tokens",
    "read": "$.message.usage.cache_read_input_tokens", "output": "$.message.usage.output_tokens",
}
#: First match wins: the second fragment is part of the first.
BUCKETS = (("subagents/workflows/", "workflow"), ("subagents/", "subagent"))


def number_at(text: Column, path: str) -> Column:
    """The whole number at a JSON path; 0 if there is none."""
    return F.coalesce(F.get_json_object(text, path).try_cast("bigint"), F.lit(0).cast("bigint"))


def bucket_of(path: Column) -> Column:
    """workflow, subagent or main, by the folders of a transcript."""
    out = F.lit("main")
    for fragment, name in reversed(BUCKETS):
        out = F.when(F.contains(path, F.lit(fragment)), name).otherwise(out)
    return out


def find_transcripts(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """(value, path) of the lines of all files below ``root`` that match; none if the folder doesn't exist."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], "value string, path string")
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root)
    return lines.select("value", F.col("_metadata.file_path").alias("path"))


FLAT = "id string, session string, model string, ts string, role string, usage struct<input:bigint, output:bigint, cache_read:bigint, cache_write:bigint>"


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """(id, session, model, ts, path, input, output, cache_read, cache_write) of the assistant lines with usage and an id, in flat records.

    An absent or empty folder gives no rows; missing numbers are 0.
    """
    lines = find_transcripts(spark, root)
    rows = lines.select(F.from_json("value", FLAT).alias("r"), "path").where("r.role = 'assistant' AND r.id IS NOT NULL AND r.usage IS NOT NULL")
    return rows.select("r.id", "r.session", "r.model", "r.ts", "path", *(F.coalesce(F.col(f"r.usage.{c}"), F.lit(0)).alias(c) for c in ("input", "output", "cache_read", "cache_write")))


def read_transcripts(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """One row for each line of an assistant message with usage and an id: id, bucket, path, ts, session, branch, model, speed, tier and ``TOKENS``.

    speed is fast or standard, tier batch or standard, model ``unknown`` where
    it isn't told. Missing or malformed numbers are 0. An absent or empty
    folder gives no rows. ``<synthetic>`` messages aren't billed and left out.
    """
    lines = find_transcripts(spark, root, pattern).where(F.startswith("value", F.lit("{")))
    parsed = lines.select("path", F.try_parse_json("value").alias("_v")).where("_v IS NOT NULL")
    told = [F.try_variant_get("_v", _PATHS[k], "string").alias(k) for k in ("id", "role", "ts", "session", "branch", "usage", "model", "speed", "tier")]
    rows = parsed.select("path", *told, *(F.coalesce(F.try_variant_get("_v", _PATHS[k], "bigint"), F.lit(0).cast("bigint")).alias(k) for k in TOKENS))
    real = rows.where("role = 'assistant' AND id IS NOT NULL AND usage IS NOT NULL AND coalesce(model, '') <> '<synthetic>'")
    speed, tier = F.when(F.col("speed") == "fast", "fast").otherwise("standard"), F.when(F.col("tier") == "batch", "batch").otherwise("standard")
    return real.select("id", bucket_of(F.col("path")).alias("bucket"), "path", "ts", "session", "branch", F.coalesce("model", F.lit("unknown")).alias("model"), speed.alias("speed"), tier.alias("tier"), *TOKENS)


def list_projects(spark: SparkSession, base: str, pattern: str = "*.jsonl") -> DataFrame:
    """(project, files, modified) for each folder directly below ``base`` that holds transcripts, latest change first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(base)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], "project string, files long, modified timestamp")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(base).select("path", "modificationTime")
    tail = F.regexp_replace("path", "^.*?" + base.removeprefix("file://").rstrip("/").replace(".", r"\.") + "/", "")
    return files.groupBy(F.split_part(tail, F.lit("/"), F.lit(1)).alias("project")).agg(F.count("*").alias("files"), F.max("modificationTime").alias("modified")).orderBy(F.desc("modified"), "project")
