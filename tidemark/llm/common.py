"""Helpers that the corpus operators share: reading tables, and cutting lineage in the shared folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable
from contextlib import suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir or set as the context's checkpoint folder; without one there is no folder that all
    machines share, and nothing is written."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if spark.sparkContext.master.startswith("local"):  # one machine: its own folder is shared
        path = tempfile.mkdtemp(prefix="spark-tidemark-")
        spark.sparkContext.setCheckpointDir(path)
        return path
    raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: later stages survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of tables from materialize() that nothing reads any more. The driver is asked for a garbage collection: it
    lets Spark delete the shuffle files of the jobs that are done with them."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(df.sparkSession, folder)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """DataFrame.checkpoint() with the shared folder set; for small intermediate results of loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def lean(run: Callable) -> Callable:
    """run, a function over record batches; after its last batch the worker gives free memory back, since the next task, of whatever
    stage, may run in the same process."""

    @wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return inner


def text_hash(column: str = "text"):
    """128 bits that stand for a text (null: its own value)."""
    return F.coalesce(F.md5(F.col(column)), F.lit("null"))


def unused(name: str, columns: list[str]) -> str:
    """name, with underscores added until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


#: Rows that a table may have to be sent whole to every task.
SMALL_ROWS = 10_000


def small(df: DataFrame, name: str) -> DataFrame:
    """df, computed once; marked for broadcast if its count is small, joined by shuffle if not."""
    out = materialize(df, name)
    return F.broadcast(out) if out.count() <= SMALL_ROWS else out
