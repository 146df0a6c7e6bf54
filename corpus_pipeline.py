"""A corpus pipeline: five stages, each of which works on all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir). All
but the last return the columns of ``documents``; the last returns the mixture.

Nulls, empty tables and repeated rows, stage by stage. A null or empty text has
no letters, so the first stage drops it; a null ``doc_id`` or ``source`` passes
through all stages: a row without an id is never a near duplicate, neither
loses nor causes removals and stays even if contaminated, as no id names it; one
without a source is mixed as ``unknown``. Rows that repeat an id are one
document to the near-duplicate and contamination stages, which keep or drop all
of them; each counts in the mixture. An empty table gives empty tables of the same columns. Other columns
of ``documents`` are left out by the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import decontamination, language_id, mixing, near_dedup, substring_dedup
from gaugeworks.llm.common import discard, read, small_batches, stored, table_mark, tables_since

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Below this likelihood the language of a document is not known.
LEAST_SCORE = 0.5
#: Near duplicates have at least this Jaccard similarity, in hundredths.
NEAR_PERCENT = 85


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is recognised; ``lang`` becomes the recognised one."""
    small_batches(spark)
    model = language_id.fit(docs)
    found = language_id.identify(docs, model, keep=("doc_id", "text", "source", "n_chars"))
    known = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return known.withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id."""
    small_batches(spark)
    gone = near_dedup.near_dedup(docs, percent=NEAR_PERCENT).where(~F.col("kept")).select(F.col("doc_id").alias("_gone"))
    return docs.hint("merge").join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of earlier ones; those that lose nothing keep their text as it is."""
    small_batches(spark)
    cut = substring_dedup.substring_dedup(docs, keep=("text", "lang", "source"))
    text = F.when(F.col("n_removed") > 0, F.col("clean_text")).otherwise(F.col("text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    hits = decontamination.contamination(docs, read(spark, sf_dir, "benchmark"))
    return decontamination.remove_documents(docs, hits).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of what is left, to the target weights."""
    return mixing.mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: The first stage learns a model, which SQL can't express; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage stored on its way is deleted once its own result is."""
    docs, mark = read(spark, sf_dir, "documents"), table_mark()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        discard(spark, tables_since(mark, docs))
    return STAGES[-1][1](spark, docs, sf_dir)
