"""Stored selections: one Parquet table for all runs, partitioned by method.

A selection that is made anew is appended under the next version; the newest one counts, older ones stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run_id string, row_id long, cluster int, rank int, score double, version int, method string"


def save_selection(selected: DataFrame, path: str, run_id: str, method: str, version: int = 0) -> None:
    """Append ``selected`` (row_id, and cluster, rank, score where present)."""
    def or_null(name, kind):
        return (F.col(name) if name in selected.columns else F.lit(None)).cast(kind).alias(name)

    (selected.select(F.lit(run_id).alias("run_id"), F.col("row_id").cast("long"), or_null("cluster", "int"),
                     or_null("rank", "int"), or_null("score", "double"), F.lit(version).alias("version"),
                     F.lit(method).alias("method"))
     .write.mode("append").partitionBy("method").parquet(path))


def _versions(spark: SparkSession, path: str, run_id: str, method: str) -> DataFrame:
    named = (spark.read.schema(SCHEMA).parquet(path)
             .filter((F.col("method") == method) & (F.col("run_id") == run_id)))
    return named.withColumn("version", F.coalesce("version", F.lit(0)))


def load_selection(spark: SparkSession, path: str, run_id: str, method: str) -> DataFrame:
    """The newest version of a selection; no rows if there is none."""
    named = _versions(spark, path, run_id, method)
    newest = named.agg(F.max("version").alias("version"))
    return named.join(newest, "version", "left_semi").drop("version")


def newest_version(spark: SparkSession, path: str, run_id: str, method: str) -> int | None:
    try:
        return _versions(spark, path, run_id, method).agg(F.max("version")).first()[0]
    except AnalysisException:  # no table yet
        return None


def select_or_load(spark: SparkSession, path: str, run_id: str, method: str, compute: Callable[[], DataFrame],
                   recalculate: bool = False) -> DataFrame:
    """Use the stored selection of this run unless there is none or a new one is asked for."""
    version = newest_version(spark, path, run_id, method)
    if version is None or recalculate:
        save_selection(compute(), path, run_id, method, 0 if version is None else version + 1)
    return load_selection(spark, path, run_id, method)
