"""Centers cut into tiles of a fixed size, so that what a task holds does not grow with their number.

Each tile is shipped on its own and meets every point in a pass of its own; what the passes find is merged by row or by
center. Centers may be an array, or a table (k, c) of which the driver sees one tile at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE_BYTES = 32 * 1024 * 1024

Centers = np.ndarray | DataFrame


def tile_rows(dim: int) -> int:
    return max(1, TILE_BYTES // (8 * max(dim, 1)))


def center_tiles(centers: Centers, column: str = "c", *more: str) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(numbers, matrix, more columns) of one tile after the other, in the order of the numbers.

    A table must have distinct numbers ``k``, which need not be dense; other columns named in ``more`` come along.
    """
    if not isinstance(centers, DataFrame):
        matrix = np.asarray(centers, float)
        step = tile_rows(matrix.shape[1])
        for at in range(0, len(matrix), step):
            part = matrix[at:at + step]
            yield np.arange(at, at + len(part)), part, []
        return
    shape = centers.agg(F.min("k").alias("low"), F.max("k").alias("high"), F.max(F.size(column)).alias("dim")).first()
    if shape["high"] is None:
        raise ValueError("there are no centers")
    step = tile_rows(shape["dim"])
    for at in range(shape["low"], shape["high"] + 1, step):
        rows = centers.where(F.col("k").between(at, at + step - 1)).select("k", column, *more).orderBy("k").collect()
        if rows:
            yield (np.array([r["k"] for r in rows]), np.array([r[column] for r in rows], float),
                   [np.array([r[m] for r in rows]) for m in more])
