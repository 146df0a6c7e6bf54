"""What the two document classifiers share: the labelled sample, and scoring in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder, slices

#: Labelled documents to fit on, at most about: a hash range of the ids, the same at every run.
MOST_LABELLED = 12_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, use: Column, most: int = MOST_LABELLED) -> DataFrame:
    """(id, text, y): documents with a label among ``use``, about ``most`` of them.

    Repeated labels of an id count as 1 if any is, and an id that several rows
    of the documents have counts once, with its least text. So the sample is
    of bounded size; its ids are broadcast to the documents.
    """
    y = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & use).groupBy(F.col(id_col).alias("_key")).agg(F.max(label).cast("int").alias("y"))
    n = y.count()
    place = F.pmod(F.xxhash64("_key"), F.lit(1 << 20))
    chosen = y.where(place < int(min(1.0, most / max(1, n)) * (1 << 20)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), F.col("id") == F.col("_key")).where("text IS NOT NULL").groupBy("id", "y").agg(F.min("text").alias("text")).select("id", "text", "y")


def features_of(sample: DataFrame, features: Callable[[pa.Array], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows, labels and ids of a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = features(batch.column(1)).astype(np.float64)
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64())) if len(x) else pa.array([], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), rows], names=["id", "y", "x"])

    got = sample.mapInArrow(run, f"id {sample.schema['id'].dataType.simpleString()}, y int, x array<double>").orderBy("id").toArrow()
    x = np.array(got["x"].to_pylist(), dtype=np.float64)
    return x, got["y"].to_numpy().astype(np.float64), got["id"].to_numpy()


def scored(docs: DataFrame, score: Callable[[pa.Array], np.ndarray], id_col: str, text_col: str, held_out: int, threshold: float) -> DataFrame:
    """``id_col``, held_out (crc32 of the id modulo 5 is ``held_out``), score and predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1)).astype(np.float64))], names=["_id", "_score"])

    inputs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = inputs.mapInArrow(run, f"_id {docs.schema[id_col].dataType.simpleString()}, _score double")
    return out.select(F.col("_id").alias(id_col), F.coalesce(remainder("_id", 5) == held_out, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))
