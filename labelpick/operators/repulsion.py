"""Repulsion between selected rows and its moving average over the selection rounds."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from labelpick.functions import kernels as K
from labelpick.operators.tiles import center_tiles
from labelpick.session import ship


@dataclass
class Anchors:
    """Selected rows as arrays: at most one per cluster."""
    cluster: np.ndarray
    row_id: np.ndarray
    vector: np.ndarray


def repulsion_terms(x: np.ndarray, cluster: np.ndarray, anchors: Anchors, alpha: float, epsilon: float,
                    exclude: str = "cluster") -> np.ndarray:
    """(rows, anchors) terms 1 / (distance^alpha + epsilon), 0 where the anchor does not count for the row."""
    d = np.sqrt(K.squared_distances(x, anchors.vector))
    other = {"cluster": anchors.cluster, "row_vs_cluster": anchors.row_id}[exclude]
    return np.where(other[None, :] == cluster[:, None], 0.0, 1.0 / (d ** alpha + epsilon))


def anchor_tiles(anchors: Anchors | DataFrame):
    """Anchors some at a time: cut from arrays, or from a table (k, row_id, embedding) of one row per cluster."""
    if isinstance(anchors, DataFrame):
        for cluster, vector, (row_id,) in center_tiles(anchors, "embedding", "row_id"):
            yield Anchors(cluster, row_id.astype(np.int64), vector)
        return
    for at, part, _ in center_tiles(anchors.vector):
        yield Anchors(anchors.cluster[at], anchors.row_id[at], part)


def repulsion(rows: DataFrame, anchors: Anchors | DataFrame, alpha: float = 0.75, epsilon: float = 1e-5,
              exclude: str = "cluster") -> DataFrame:
    """(k, row_id, repulsion) for rows (k, row_id, embedding).

    ``exclude="cluster"`` leaves out the anchor of the row's own cluster. ``"row_vs_cluster"`` compares the anchor's row
    id with the row's cluster number instead, as one variant does, and so usually keeps the row itself. Rows meet one tile
    of anchors per pass; with several tiles the sums are added up by row.
    """
    def of_tile(tile: Anchors) -> DataFrame:
        shared = ship(rows.sparkSession, [tile.cluster, tile.row_id, tile.vector], "selected rows")

        @arrow_udf("double")
        def push(vec: pa.Array, k: pa.Array) -> pa.Array:
            if not len(vec):
                return pa.array([], pa.float64())
            terms = repulsion_terms(K.to_matrix(vec), K.ints(k), Anchors(*shared.value), alpha, epsilon, exclude)
            return pa.array(terms.sum(axis=1))

        return rows.select("k", "row_id", push("embedding", "k").alias("repulsion"))

    found = [of_tile(tile) for tile in anchor_tiles(anchors)]
    if len(found) == 1:
        return found[0]
    return reduce(DataFrame.unionByName, found).groupBy("k", "row_id").agg(F.sum("repulsion").alias("repulsion"))


def ema_factor(m_reg: float, rounds: int) -> float:
    """Share of a constant repulsion that its moving average reaches: the first round does not update it."""
    return 1.0 - m_reg ** max(rounds - 1, 0)


def with_utility(picks: DataFrame, lambda_: float) -> DataFrame:
    return picks.withColumn("utility", F.col("density") - F.lit(lambda_) * F.col("reg"))
