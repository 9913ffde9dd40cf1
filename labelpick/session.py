"""Scratch tables and size limits shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest model (centroids, weights, selected rows) that may be held by the driver and shipped to executors.
MODEL_BYTES_LIMIT = 512 * 1024 * 1024
# Most rows of a small table whose row count has a known bound that may be broadcast in a join.
BROADCAST_ROWS_LIMIT = 1_000_000


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own, which goes when the program ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="labelpick-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


RUN = uuid.uuid4().hex


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the part of the scratch folder that belongs to this driver."""
    return f"{scratch_root(spark)}/labelpick/{RUN}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> None:
    target, files = _at(spark, path)
    files.delete(target, True)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    target, files = _at(spark, path)
    return [f.getPath().getName() for f in files.listStatus(target)] if files.exists(target) else []


def drop_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this driver. Results that still read one must be stored before."""
    delete_path(spark, f"{scratch_root(spark)}/labelpick/{RUN}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the scratch folder and read it back, which also cuts lineage."""
    return _write(df, scratch_path(df.sparkSession, name))


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_tables(spark: SparkSession):
    """Give a function that materializes tables and drops them at the end. For results that no longer read them."""
    paths: list[str] = []

    def write(df: DataFrame, name: str) -> DataFrame:
        paths.append(scratch_path(spark, name))
        return _write(df, paths[-1])

    try:
        yield write
    finally:
        for path in paths:
            delete_path(spark, path)


def small_side(df: DataFrame, row_bound: int) -> DataFrame:
    """Broadcast ``df`` in a join if its proven row bound is small, else leave the join to Spark."""
    return F.broadcast(df) if row_bound <= BROADCAST_ROWS_LIMIT else df


def check_model_size(n_values: int, what: str) -> None:
    if 8 * n_values > MODEL_BYTES_LIMIT:
        raise ValueError(f"{what} needs {8 * n_values} bytes, more than the limit of {MODEL_BYTES_LIMIT}")


def ship(spark: SparkSession, value, what: str = "model") -> Broadcast:
    """Broadcast arrays once per executor, after checking their size."""
    arrays = value if isinstance(value, (list, tuple)) else [value]
    check_model_size(sum(np.asarray(a).size for a in arrays if a is not None), what)
    return spark.sparkContext.broadcast(value)
