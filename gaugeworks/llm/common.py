"""What the training-data operators share: reading tables, and cutting lineage safely."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in slices of so many rows, however large the session lets its Arrow batches be.
ARROW_ROWS = 512


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    return found.rstrip("/")


#: The tables that were stored and not yet deleted, oldest first
_TABLES: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    It cuts the lineage: lost executors cost no recomputation, since what
    reads on finds the files there. ``spent`` or ``discard`` deletes it.
    """
    path = os.path.join(shared_dir(df.sparkSession), "tables", f"{name}-{uuid.uuid4().hex}")
    _TABLES.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that no DataFrame needs any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if path in _TABLES:
            _TABLES.remove(path)


def spent(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote of these tables, as soon as all that reads them is stored itself."""
    for table in tables:
        discard(table.sparkSession, [table._stored_at])


def tables_since(mark: int, *keep: DataFrame) -> list[str]:
    """The stored tables from place ``mark`` on, without those to keep; ``len(_TABLES)`` before some work is its mark."""
    kept = {table._stored_at for table in keep}
    return [path for path in _TABLES[mark:] if path not in kept]


def table_mark() -> int:
    return len(_TABLES)


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand texts to Python in batches of at most ``ARROW_ROWS`` rows, for the rest of the session.

    For jobs, not operators: a batch of Spark's default size holds up to 64 MB
    of text in the executor and again in its Python worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``ARROW_ROWS`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ARROW_ROWS):
            yield batch.slice(at, ARROW_ROWS)


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % modulus
