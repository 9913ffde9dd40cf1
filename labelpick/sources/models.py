"""Stored model weights: (model, saved_at, layer, shape, values), one row per weight array."""

from __future__ import annotations

from datetime import datetime, timezone

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelpick.session import check_model_size

SCHEMA = "model string, saved_at timestamp, layer int, shape array<int>, values array<double>"


def save_model(spark: SparkSession, arrays: list[np.ndarray], path: str, model: str,
               saved_at: datetime | None = None) -> datetime:
    """Append the weights under a new timestamp; earlier versions stay."""
    check_model_size(sum(a.size for a in arrays), "model")
    saved_at = saved_at or datetime.now(timezone.utc)
    rows = [(model, saved_at, i, [int(s) for s in a.shape], a.ravel().tolist()) for i, a in enumerate(arrays)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return saved_at


def latest_weights(weights: DataFrame, model: str) -> DataFrame:
    """Rows of the newest version with exactly this name."""
    named = weights.filter(F.col("model") == model)
    newest = named.agg(F.max("saved_at").alias("saved_at"))
    return named.join(newest, "saved_at", "left_semi")


def load_model(spark: SparkSession, path: str, model: str) -> list[np.ndarray]:
    try:
        rows = latest_weights(spark.read.schema(SCHEMA).parquet(path), model).orderBy("layer").collect()
    except AnalysisException as missing:
        raise FileNotFoundError(f"no model table at {path}") from missing
    if not rows:
        raise FileNotFoundError(f"no model named {model} in {path}")
    return [np.array(r["values"]).reshape(r["shape"]) for r in rows]
