"""Cutting lineage: tables written once in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the folder of spark.checkpoint.dir (or the context's checkpoint folder) and read back; a local session
    without one takes a temporary folder, a cluster's is refused."""
    spark = df.sparkSession
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-tidemark-")
        spark.sparkContext.setCheckpointDir(path)
    path = f"{path}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Has the driver collect what nothing refers to any more; Spark then removes the shuffle files of such tables."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
