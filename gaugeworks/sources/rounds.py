"""An append-only log of rounds: JSON lines, written once a batch and read back with what was refused.

A record holds round, version, fingerprint (of what the rounds are comparable
under) and its figures. A file is written whole under the name of its batch, so
a batch that is tried again replaces its own file and no other; writers have
names of their own. Readers keep the newest version of each round, so a round that is
run again replaces its record, whoever wrote first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.names import prefix

RECORD = "round long, version long, fingerprint string, improving boolean, qualified boolean, value double"


def append_rounds(records: DataFrame, path: str, writer: str, batch: int) -> None:
    """Write the records as batch ``batch`` of ``writer``; the same batch again replaces what it wrote before.

    Spark's own commit makes the file visible only when it is whole. An empty batch writes an empty file.
    """
    records.write.mode("overwrite").json(f"{path.rstrip('/')}/writer={writer}/batch={batch:012d}")


def start_round_log(stream: DataFrame, path: str, writer: str, checkpoint: str) -> StreamingQuery:
    """Append each batch of a stream; a batch that fails is written again under its own number."""
    return stream.writeStream.foreachBatch(lambda batch, number: append_rounds(batch, path, writer, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def next_round(rounds: DataFrame) -> int:
    """One past the highest round, not the number of rounds: gaps aren't filled, so no record is replaced unasked."""
    return (rounds.agg(F.max("round")).first()[0] if rounds.columns else None) + 1 if rounds.limit(1).count() else 0


def parse_rounds(files: DataFrame, file_col: str, text_col: str, fingerprint: str) -> tuple[DataFrame, DataFrame]:
    """(records, refused) of whole files as text, a row a file.

    A line is a record if it is JSON with a round from 0, a version and a fingerprint. Refused are, by ``problem``: ``torn`` (the last line
    of a file, without a line end and not a record: a write that was cut off), ``malformed`` (any other line that is
    none) and ``foreign`` (another fingerprint: its figures don't compare). Empty lines are nothing. Of several records of a
    round the highest version counts, then the last file by name and line. An empty table gives two empty ones.
    """
    p = prefix(files)
    lines = files.select(F.col(file_col).alias("file"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line", f"{p}text"), F.size(F.split(F.col(text_col), "\n")).alias(f"{p}n"))
    lines = lines.where(F.trim(F.regexp_replace(f"{p}text", "\r$", "")) != "")
    seen = lines.withColumn(f"{p}r", F.from_json(f"{p}text", RECORD + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    r = F.col(f"{p}r")
    good = r["_bad"].isNull() & (r["round"] >= 0) & r["version"].isNotNull() & r["fingerprint"].isNotNull()
    problem = F.when(~F.coalesce(good, F.lit(False)), F.when(F.col("line") == F.col(f"{p}n") - 1, "torn").otherwise("malformed")).when(r["fingerprint"] != fingerprint, "foreign")
    judged = seen.withColumn("problem", problem)
    newest = judged.where("problem IS NULL").groupBy(r["round"].alias("round")).agg(F.max(F.struct(r["version"].alias("v"), "file", "line", r.alias("r"))).alias("best"))
    return newest.select("best.r.round", "best.r.version", "best.r.improving", "best.r.qualified", "best.r.value"), judged.where("problem IS NOT NULL").select("file", "line", "problem")


def load_rounds(spark: SparkSession, path: str, fingerprint: str) -> tuple[DataFrame, DataFrame]:
    """(records, refused) of all files that writers left at or below ``path``; a path without files gives two empty tables."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
    return parse_rounds(files.select("path", F.decode("content", "UTF-8").alias("text")), "path", "text", fingerprint)
