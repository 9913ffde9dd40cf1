"""Two-dimensional view of a labeled table with its selected rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from labelpick.functions import kernels as K
from labelpick.operators.scale import moments, rescale
from labelpick.operators.sets import with_label_code
from labelpick.session import materialize, ship


def principal_axes(points: DataFrame, k: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Mean and (dim, k) principal axes; the entry of largest size is positive in every axis."""
    mean, _ = moments(points)
    centered = rescale(points.select("row_id", "embedding"), mean, np.ones_like(mean))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(centered.select(array_to_vector("embedding").alias("v")))
    axes = model.pc.toArray()
    sign = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    return mean, axes * np.where(sign == 0, 1.0, sign)


def project_2d(points: DataFrame, selected: DataFrame) -> DataFrame:
    """(row_id, x, y, label, code, selected): principal components, class number and whether the row was picked."""
    mean, axes = principal_axes(points)
    shared = ship(points.sparkSession, [mean, axes])

    @arrow_udf("struct<x:double,y:double>")
    def place(vec: pa.Array) -> pa.Array:
        m = K.to_matrix(vec)
        if not len(m):
            return pa.array([], pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        center, ax = shared.value
        xy = (m - center) @ ax
        return pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], names=["x", "y"])

    picked = materialize(selected.select("row_id").distinct(), "selected_ids").withColumn("_hit", F.lit(1))
    flagged = points.join(picked, "row_id", "left")
    rows = flagged.select("row_id", "label", place("embedding").alias("_p"), F.col("_hit").isNotNull().alias("selected"))
    return with_label_code(rows).select("row_id", "_p.x", "_p.y", "label", "code", "selected")
