"""Per-dimension scaling of embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from labelpick.functions import kernels as K
from labelpick.operators.partials import collect_sums
from labelpick.session import ship


def _first_vector(points: DataFrame) -> np.ndarray:
    row = points.select("embedding").first()
    if row is None or row["embedding"] is None:
        raise ValueError("no embedding in the first row")
    return np.array(row["embedding"], dtype=float)


def moments(points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population standard deviation per dimension, in one pass of sums around a data row."""
    origin = _first_vector(points)
    shared, dim = ship(points.sparkSession, origin), origin.size

    def fold(acc, batch):
        x = K.to_matrix(batch.column(0))
        K.check_dim(x, dim)
        x = x - shared.value
        acc["n"] += len(x)
        acc["sum"] += x.sum(axis=0)
        acc["square"] += np.einsum("ij,ij->j", x, x)

    got = collect_sums(points.select("embedding"), {"n": (1,), "sum": (dim,), "square": (dim,)}, fold)
    offset = got["sum"] / got["n"]
    return origin + offset, np.sqrt(np.maximum(got["square"] / got["n"] - offset * offset, 0.0))


def value_range(points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum per dimension."""
    dim = _first_vector(points).size

    def fold(acc, batch):
        x = K.to_matrix(batch.column(0))
        K.check_dim(x, dim)
        acc["low"] = np.minimum(acc["low"], x.min(axis=0))
        acc["negated_high"] = np.minimum(acc["negated_high"], -x.max(axis=0))

    got = collect_sums(points.select("embedding"), {"low": (dim,), "negated_high": (dim,)}, fold, how="min")
    return got["low"], -got["negated_high"]


def rescale(points: DataFrame, shift: np.ndarray, width: np.ndarray) -> DataFrame:
    """Replace ``embedding`` by (embedding - shift) / width; entries of width 0 become null."""
    shared = ship(points.sparkSession, [shift, width])

    @arrow_udf("array<double>")
    def apply(vec: pa.Array) -> pa.Array:
        x = K.to_matrix(vec)
        if not len(x):
            return pa.array([], pa.list_(pa.float64()))
        low, span = shared.value
        K.check_dim(x, low.size)
        flat = span == 0.0
        scaled = (x - low) / np.where(flat, 1.0, span)
        values = pa.array(scaled.ravel(), mask=np.tile(flat, len(x)))
        offsets = np.arange(0, scaled.size + 1, scaled.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), values)

    return points.withColumn("embedding", apply("embedding"))


def standardize(points: DataFrame) -> DataFrame:
    return rescale(points, *moments(points))


def min_max_scale(points: DataFrame) -> DataFrame:
    low, high = value_range(points)
    return rescale(points, low, high - low)


def center(points: DataFrame) -> DataFrame:
    mean, _ = moments(points)
    return rescale(points, mean, np.ones_like(mean))
