import math

import numpy as np
import pytest
from llm.helpers import empty

from labelpick.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score double, query long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0.0, 1) for i, v in rows], SCHEMA).repartition(4)


def brute(rows, k, every):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in usable:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i)
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("annulus, bytes_", [(1024, 32 << 20), (7, 32 << 20), (50, 2_000)])
def test_equals_brute_force(spark, monkeypatch, annulus, bytes_):
    monkeypatch.setattr(topk, "ANNULUS", annulus)
    monkeypatch.setattr(topk, "QUERY_BYTES", bytes_)
    rng = np.random.default_rng(annulus)
    x = rng.normal(0, 1, (300, 8)).astype(np.float32)
    x[100:200] = x[100]  # a common vector, so that many scores tie
    x[200:210] *= 50
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(400, None), (None, [1.0] * 8), (450, [1.0, None] + [0.0] * 6), (500, [float("nan")] + [0.0] * 7),
             (550, [float("inf")] + [0.0] * 7), (600, []), (650, [0.5, 0.25])]
    got = topk.top_k(table(spark, rows), k=5, every=50, pivots=8).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 5, 50)


def test_few_rows_repeated_ids_and_empty_tables(spark):
    got = topk.top_k(table(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0])]), k=5).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 1, 256 * 128), (0, 2, 2, 256 * 128)]
    twice = topk.top_k(table(spark, [(0, [1.0]), (0, [2.0]), (3, [1.0])]), k=5).collect()
    assert sorted(tuple(r) for r in twice) == [(0, 1, 3, 256 * 256), (0, 1, 3, 512 * 256)]
    assert topk.top_k(empty(spark, SCHEMA)).count() == 0
    assert topk.top_k(table(spark, [(0, None)])).count() == 0


def test_bounds_hold_and_annuli_are_skipped():
    rng = np.random.default_rng(3)
    centers = np.array([[0.0, 0.0], [1000.0, 0.0]])
    q = rng.integers(-50, 50, (20, 2))
    search = topk.Search(np.arange(20), q, np.full(20, 400_000.0), 5, centers)
    v = rng.integers(-60, 60, (200, 2))
    d = topk.distances(v.astype(float), centers)
    near = d.argmin(1)
    for p in (0, 1):
        mine = v[near == p]
        if len(mine):
            a = {"pivot": p, "low": d[near == p, p].min(), "high": d[near == p, p].max(),
                 "norm": np.sqrt((mine ** 2).sum(1)).max()}
            assert (search.bound(a)[:, None] >= topk.inner(q, mine)).all()
            assert (search.bound(a) < search.least).all()


def test_large_components_stay_exact():
    big = np.array([[2 ** 40, -3]]), np.array([[2 ** 40, 5], [1, 1]])
    assert topk.inner(*big).tolist() == [[2 ** 80 - 15, 2 ** 40 - 3]]
