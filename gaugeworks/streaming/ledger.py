"""An incremental ledger: greatest values per id, whatever is repeated or late."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ledger import max_merge


def start_max_merge(stream: DataFrame, key: Sequence[str], values: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """Append the rows that each batch changes to the table at ``path``.

    Maxima are idempotent: a batch that is written twice, or a late line,
    changes no result, so no watermark is needed. Read it with ``merged``.
    """
    changed = stream.groupBy(*key).agg(*(F.max(v).alias(v) for v in values))

    def append(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(path)

    return changed.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, path: str, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    return max_merge(spark.read.parquet(path), list(key), list(values))
