"""Signals from tables: one row per signal (or channel), samples as an array of doubles."""

from __future__ import annotations

from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ranks import numbered

ROLES = ("real", "synthetic")


def _doubles(column: str):
    return F.transform(F.col(column), lambda v: v.cast("double"))


def _by_parity(column: str):
    return F.when(F.pmod(F.col(column), F.lit(2)) == 0, "real").otherwise("synthetic")


def short(spark: SparkSession, sf_dir: str, role: str = "parity") -> DataFrame:
    """(signal_id, role, label, x): every embedding is a signal; role by parity of the id, or by label ("label")."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    roles = _by_parity("vec_id") if role == "parity" else F.when(F.col("label") < 5, "real").otherwise("synthetic")
    return rows.select(F.col("vec_id").alias("signal_id"), roles.alias("role"), "label", _doubles("embedding").alias("x"))


def indexed(signals: DataFrame) -> DataFrame:
    """signals with idx, from 0 on in the order of signal_id within each role; it stands for the order of rows."""
    return numbered(signals, ["role"], "signal_id", "idx")


#: The declared sampling rate of the long view, and the embeddings joined to one of its signals.
FS, JOINED = 128.0, 8


def long_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(signal_id, role, x): eight consecutive embeddings in a row, at 128 Hz; an incomplete group ends in zeros."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", _doubles("embedding").alias("x"))
    joined = rows.groupBy(F.expr(f"vec_id div {JOINED}").alias("signal_id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "x"))).alias("parts"))
    x = F.flatten(F.transform("parts", lambda p: p["x"]))
    rest = F.array_repeat(F.lit(0.0), (JOINED - F.size("parts")) * F.size(F.get("parts", F.lit(0))["x"]))
    return joined.select("signal_id", _by_parity("signal_id").alias("role"), F.concat(x, rest).alias("x"))


CHANNELS = 4


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, role, channel, x): four consecutive embeddings are the channels of a sample."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    sample = F.expr(f"vec_id div {CHANNELS}")
    return rows.select(sample.alias("sample_id"), F.pmod("vec_id", F.lit(CHANNELS)).cast("int").alias("channel"), _doubles("embedding").alias("x")).select("sample_id", _by_parity("sample_id").alias("role"), "channel", "x")


def samples(signals: DataFrame, *keys: str) -> DataFrame:
    """(keys, t, v): a row per sample; t from 0 on."""
    return signals.select(*(keys or ("signal_id", "role")), F.posexplode("x").alias("t", "v"))


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, signal_id, x) from .npy files of one or two dimensions; object arrays are refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                rows = np.atleast_2d(np.load(BytesIO(content.as_py()), allow_pickle=False)).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(rows)), pa.array(range(len(rows)), pa.int64()), pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["path", "signal_id", "x"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, signal_id long, x array<double>")


def validate_channels(samples_df: DataFrame, expected_channels: int | None = None, expected_length: int | None = None) -> DataFrame:
    """(sample_id, n_channels, min_length, max_length, valid): two or more channels of one length each, and as expected."""
    by = samples_df.groupBy("sample_id").agg(F.count_distinct("channel").alias("n_channels"), F.min(F.size("x")).alias("min_length"), F.max(F.size("x")).alias("max_length"))
    good = (F.col("n_channels") >= 2) & (F.col("min_length") == F.col("max_length"))
    if expected_channels is not None:
        good &= F.col("n_channels") == expected_channels
    if expected_length is not None:
        good &= F.col("min_length") == expected_length
    return by.withColumn("valid", good)
