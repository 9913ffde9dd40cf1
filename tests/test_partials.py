import numpy as np
import pytest
from pyspark.sql import functions as F

from labelpick.operators import partials


def counting():
    def fold(acc, batch):
        ids = batch.column(0).to_numpy()
        acc["n"][0] += len(ids)
        np.add.at(acc["by"], ids % acc["by"].size, ids.astype(float))
    return fold


def test_sums_of_arrays_longer_than_a_chunk(spark):
    width, n = 3 * partials.CHUNK + 17, 50_000
    got = partials.collect_sums(spark.range(n, numPartitions=13), {"n": (1,), "by": (width,)}, counting())
    want = np.bincount(np.arange(n) % width, np.arange(n), width)
    assert got["n"][0] == n and np.array_equal(got["by"], want)


@pytest.mark.parametrize("per_core", [1, 40])
def test_one_and_two_merges_agree(spark, monkeypatch, per_core):
    monkeypatch.setattr(partials, "TASKS_PER_CORE", per_core)
    df, width = spark.range(2_000, numPartitions=100), 2 * partials.CHUNK
    plan = partials.partial_sums(df, {"n": (1,), "by": (width,)}, counting())._jdf.queryExecution().toString()
    tasks = per_core * spark.sparkContext.defaultParallelism
    assert plan.split("Optimized Logical Plan")[1].split("Physical Plan")[0].count("RepartitionByExpression") == (
        2 if tasks >= 81 else 1)
    got = partials.collect_sums(df, {"n": (1,), "by": (width,)}, counting())
    want = np.zeros(width)
    want[:2_000] = np.arange(2_000)
    assert got["n"][0] == 2_000 and np.array_equal(got["by"], want)


def test_a_pass_sends_chunks_of_few_tasks(spark, monkeypatch):
    """Rows in the shuffle are tasks x chunks, whatever the number of input partitions."""
    monkeypatch.setattr(partials, "TASKS_PER_CORE", 1)
    monkeypatch.setattr(partials, "CHUNK", 64)
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(20_000, numPartitions=50 * cores)
    table = partials.partial_sums(df, {"n": (1,), "by": (1_000,)}, counting())
    table.collect()
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert f"Coalesce {cores}" in plan
    sent = table._jdf.queryExecution().executedPlan()
    assert "hashpartitioning(chunk" in sent.toString() and "hashpartitioning(pos" not in plan


def test_minima_maxima_and_empty_input(spark):
    def fold(acc, batch):
        acc["v"][0] = min(acc["v"][0], batch.column(0).to_numpy().min())

    def fold_max(acc, batch):
        acc["v"][0] = max(acc["v"][0], batch.column(0).to_numpy().max())

    df = spark.range(5, 500, numPartitions=4).select(F.col("id").cast("double"))
    assert partials.collect_sums(df, {"v": (2,)}, fold, "min")["v"].tolist() == [5.0, np.inf]
    assert partials.collect_sums(df, {"v": (2,)}, fold_max, "max")["v"].tolist() == [499.0, -np.inf]
    assert partials.collect_sums(df.limit(0), {"v": (2,)}, fold)["v"].tolist() == [0.0, 0.0]
