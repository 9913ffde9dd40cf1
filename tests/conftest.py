import pathlib
import sys

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

SMALLEST = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "3")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_points(spark):
    def make(x, labels=None, ids=None, partitions=3):
        x = np.asarray(x, float)
        ids = range(len(x)) if ids is None else ids
        if labels is None:
            rows = [(int(i), v.tolist()) for i, v in zip(ids, x)]
            return spark.createDataFrame(rows, "row_id long, embedding array<double>").repartition(partitions)
        kind = "array<int>" if isinstance(labels[0], (list, np.ndarray)) else "int"
        rows = [(int(i), v.tolist(), np.asarray(y).tolist()) for i, v, y in zip(ids, x, labels)]
        return spark.createDataFrame(rows, f"row_id long, embedding array<double>, label {kind}").repartition(partitions)
    return make


@pytest.fixture(scope="session")
def blobs():
    """Three clusters of different size in four dimensions; about a third of the rows are copies of one vector."""
    rng = np.random.default_rng(3)
    centers = np.array([[0, 0, 0, 0], [6, 0, 0, 1], [0, 7, 2, 0]], float)
    which = np.repeat([0, 1, 2], [60, 25, 15])
    x = centers[which] + rng.normal(0, 1, (100, 4))
    x[10:43] = x[10]
    order = rng.permutation(100)
    return x[order], which[order]
