"""Fixed-size batches in a seeded random order, without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelpick.functions.random import uniform

BUCKETS = 65_536
SHUFFLE_DRAW = 900_001


def batches(rows: DataFrame, size: int = 64, seed: int = 0, first: int | None = None,
            buckets: int = BUCKETS) -> DataFrame:
    """Add ``batch`` and ``pos``: rows ordered by a uniform number of their id, cut into batches of ``size``.

    The uniform number also cuts the rows into even buckets, so each bucket is numbered on its own and only the small
    table of bucket counts is added up in order. ``first`` keeps the first batches alone, for training that reads no
    more of them; the buckets behind them are dropped before the shuffle.
    """
    keyed = rows.withColumn("_u", uniform(F.col("row_id"), 0, SHUFFLE_DRAW, seed))
    keyed = keyed.withColumn("_bucket", F.floor(F.col("_u") * buckets).cast("int"))
    counts = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    # at most ``buckets`` rows, so one ordered window and a broadcast are safe
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    if first is not None:
        starts = starts.filter(F.col("_start") < first * size)
    within = Window.partitionBy("_bucket").orderBy("_u", "row_id")
    numbered = (keyed.join(F.broadcast(starts), "_bucket")
                .withColumn("_at", F.col("_start") + F.row_number().over(within) - 1)
                .withColumn("batch", F.floor(F.col("_at") / size).cast("long"))
                .withColumn("pos", F.pmod(F.col("_at"), F.lit(size)).cast("int")))
    if first is not None:
        numbered = numbered.filter(F.col("batch") < first)
    return numbered.drop("_u", "_bucket", "_start", "_at")


def pair_batches(spark: SparkSession, n_labeled: int, n_unlabeled: int, epochs: int = 1) -> DataFrame:
    """(epoch, batch, labeled_batch, unlabeled_batch): each labeled batch with the next unlabeled batch.

    The unlabeled batches are used one after the other over all epochs and start again when they run out.
    """
    step = F.col("id")
    return spark.range(epochs * n_labeled).select(
        F.floor(step / n_labeled).cast("long").alias("epoch"),
        step.alias("batch"),
        F.pmod(step, F.lit(n_labeled)).alias("labeled_batch"),
        F.pmod(step, F.lit(n_unlabeled)).alias("unlabeled_batch"),
    )
