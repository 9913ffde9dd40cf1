import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelpick.functions import kernels as K
from labelpick.functions import vectors as V
from labelpick.functions.random import normal_array, uniform, uniform_array

finite = st.floats(-50, 50, allow_nan=False)


def _one(spark, expr, **cols):
    schema = ", ".join(f"{n} array<double>" for n in cols)
    return spark.createDataFrame([tuple(cols.values())], schema).select(expr.alias("v")).first()["v"]


@given(st.lists(finite, min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_softmax_kernel_sums_to_one_and_sharpen_keeps_the_winner(z):
    z = np.array([z])
    p = K.softmax(z)
    assert math.isclose(p.sum(), 1.0, rel_tol=1e-12)
    assert np.allclose(np.log(np.maximum(p, 1e-300)), np.maximum(K.log_softmax(z), math.log(1e-300)), atol=1e-9)
    assert K.sharpen(p, 0.5).argmax() == p.argmax()


def test_expressions_match_kernels(spark):
    z, y = [1.5, -2.0, 0.25], [1.0, 0.0, 1.0]
    assert np.allclose(_one(spark, V.softmax(F.col("z")), z=z), K.softmax(np.array([z]))[0])
    assert np.allclose(_one(spark, V.log_softmax(F.col("z")), z=z), K.log_softmax(np.array([z]))[0])
    assert np.allclose(_one(spark, V.sigmoid(F.col("z")), z=z), K.sigmoid(np.array(z)))
    assert np.allclose(_one(spark, V.sharpen(V.softmax(F.col("z")), 0.5), z=z), K.sharpen(K.softmax(np.array([z])), 0.5)[0])
    naive = -sum(t * math.log(s) + (1 - t) * math.log(1 - s) for t, s in zip(y, K.sigmoid(np.array(z))))
    assert math.isclose(_one(spark, V.bce_rows(F.col("z"), F.col("y")), z=z, y=y), naive, rel_tol=1e-12)
    weighted = -sum(3.0 * t * math.log(s) + (1 - t) * math.log(1 - s) for t, s in zip(y, K.sigmoid(np.array(z))))
    got = _one(spark, V.bce_rows(F.col("z"), F.col("y"), V.array_of([3.0] * 3)), z=z, y=y)
    assert math.isclose(got, weighted, rel_tol=1e-12)


def test_large_logits_do_not_overflow(spark):
    z, y = [800.0, -800.0], [0.0, 1.0]
    assert _one(spark, V.softmax(F.col("z")), z=z) == [1.0, 0.0]
    assert _one(spark, V.bce_rows(F.col("z"), F.col("y")), z=z, y=y) == 1600.0


def test_kl_ignores_zero_targets(spark):
    z, t = [2.0, 1.0, 0.0], [1.0, 0.0, 0.0]
    assert math.isclose(_one(spark, V.kl_rows(F.col("z"), F.col("t")), z=z, t=t), -K.log_softmax(np.array([z]))[0][0])


def test_argmax_takes_the_first_and_threshold_is_strict(spark):
    assert _one(spark, V.argmax(F.col("z")), z=[0.0, 0.0]) == 0
    assert _one(spark, V.argmax(F.col("z")), z=[1.0, 3.0, 3.0]) == 1
    assert _one(spark, V.over_threshold(F.col("z")), z=[0.5, 0.5000001]) == [0, 1]


def test_uniform_column_equals_numpy_for_any_id(spark):
    ids = [0, 1, 2147483646, 2147483647, 8_000_000_001, 2**60 + 12345, -5]
    df = spark.createDataFrame([(i,) for i in ids], "row_id long")
    got = [r["u"] for r in df.select(uniform(F.col("row_id"), 9, 4, 2).alias("u")).collect()]
    assert sorted(got) == sorted(uniform_array(np.array(ids), np.array([9]), 4, 2)[:, 0].tolist())


def test_random_numbers_look_random():
    u = uniform_array(np.arange(20_000), np.arange(4))
    assert abs(u.mean() - 0.5) < 0.01 and abs(u.var() - 1 / 12) < 0.002
    assert np.abs(np.corrcoef(u.T) - np.eye(4)).max() < 0.03
    g = normal_array(np.arange(20_000), 3, 1)
    assert abs(g.mean()) < 0.02 and abs(g.std() - 1) < 0.02


@given(st.integers(1, 30), st.integers(1, 6), st.integers(0, 2**31))
@settings(max_examples=60, deadline=None)
def test_nearest_equals_brute_force(n, k, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-2, 3, (n, 3)).astype(float) + 1e4  # many exact ties far from the origin
    centers = x[rng.integers(0, n, k)]
    exact = ((x[:, None] - centers[None]) ** 2).sum(-1)
    got, d = K.nearest(x, centers)
    assert (got == exact.argmin(1)).all() and np.allclose(d, np.sqrt(exact.min(1)))
