"""The folder that the driver and the executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only in local mode, where it is unset, a folder under /tmp."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` in the shared folder and read it again: its lineage ends there, and its size is known to the planner."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files that ``cut`` wrote, once what reads them is written itself."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
