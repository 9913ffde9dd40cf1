import numpy as np
import pytest
from pyspark.sql import functions as F

from labelpick import select_density, select_rows
from labelpick.functions import kernels as K
from labelpick.operators import cluster, select
from labelpick.operators.repulsion import ema_factor


def _rounds(x, a, dens, n, m_reg, lam, eps, alpha, rounds=10):
    """Plain numpy rounds with a density per row."""
    reg, chosen = np.zeros(len(x)), None
    for i in range(rounds):
        if i:
            push = np.zeros(len(x))
            for c, s in chosen.items():
                d = np.sqrt(((x - x[s]) ** 2).sum(1))
                push += np.where(a == c, 0, 1 / (d ** alpha + eps))
            reg = m_reg * reg + (1 - m_reg) * push
        utility = dens - lam * reg
        chosen = {c: int(np.flatnonzero(a == c)[utility[a == c].argmax()]) for c in range(n) if (a == c).any()}
    return chosen, reg


def test_first_member_takes_smallest_id_per_cluster(make_points, blobs):
    x, _ = blobs
    r = select_density(make_points(x), 4, init="first", max_iter=3)
    a = K.nearest(x, r.centroids)[0]
    want = sorted(int(np.flatnonzero(a == c)[0]) for c in range(4) if (a == c).any())
    assert sorted(row["row_id"] for row in r.selected.collect()) == want
    assert r.assignment.count() == 100 and r.nearest.count() == 4


def test_closed_form_of_the_moving_average_equals_ten_rounds(make_points, blobs):
    x, _ = blobs
    r = select_density(make_points(x), 3, init="first", max_iter=3)
    rows = r.selected.orderBy("cluster").collect()
    picks = x[[row["row_id"] for row in rows]]
    for i, row in enumerate(rows):
        d = np.sqrt(((picks - picks[i]) ** 2).sum(1))
        push = sum(1 / (d[j] ** 0.75 + 1e-5) for j in range(3) if j != i)
        reg = 0.0
        for _ in range(9):
            reg = 0.9 * reg + 0.1 * push
        assert np.isclose(row["reg"], reg) and np.isclose(row["score"], row["density"] - 0.5 * reg)
    assert np.isclose(ema_factor(0.9, 10), 0.612579511)


@pytest.mark.parametrize("block_rows", [7, 20_000])
def test_per_point_equals_numpy_rounds(make_points, blobs, block_rows):
    x, _ = blobs
    r = select_density(make_points(x), 3, init="first", max_iter=3, mode="per_point", k=5, block_rows=block_rows)
    a = K.nearest(x, r.centroids)[0]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    dens = []
    for i in range(len(x)):
        near = np.sort(d[i, np.flatnonzero((a == a[i]) & (np.arange(len(x)) != i))])[:5]
        dens.append(1 / ((near.mean() if len(near) else 0) + 1e-5))
    chosen, reg = _rounds(x, a, np.array(dens), 3, 0.9, 0.5, 1e-5, 0.75)
    got = {row["cluster"]: row for row in r.selected.collect()}
    assert {c: row["row_id"] for c, row in got.items()} == chosen
    for c, i in chosen.items():
        assert np.isclose(got[c]["reg"], reg[i])


def test_one_cluster_has_no_repulsion(make_points, blobs):
    rows = select_density(make_points(blobs[0]), 1, init="first", max_iter=2).selected.collect()
    assert len(rows) == 1 and rows[0]["row_id"] == 0 and rows[0]["reg"] == 0.0


def test_as_many_clusters_as_rows_selects_all(make_points):
    x = np.array([[0.0, 0], [5, 0], [0, 5]])
    rows = select_density(make_points(x), 3, init="first", max_iter=2).selected.collect()
    assert sorted(r["row_id"] for r in rows) == [0, 1, 2]
    assert all(np.isclose(r["density"], 1e5) for r in rows)


def test_empty_cluster_gives_fewer_rows(make_points):
    x = np.array([[0.0, 0], [1, 1], [2, 2]])
    init = np.array([[1.0, 1], [90, 90]])
    assert select_density(make_points(x), 2, init=init, max_iter=1).selected.count() == 1


def test_row_against_cluster_exclusion_keeps_the_row_itself(make_points):
    x = np.array([[0.0, 0], [10, 0], [0.1, 0], [10.1, 0]])
    options = dict(init=x[[0, 1]], max_iter=1, tol=0.0, exclude="row_vs_cluster")
    rows = {r["cluster"]: r for r in select_density(make_points(x, ids=[5, 6, 7, 8]), 2, **options).selected.collect()}
    assert rows[0]["reg"] > 1e4  # distance 0 to itself adds 1 / epsilon
    same = select_density(make_points(x, ids=[0, 1, 2, 3]), 2, **options).selected.collect()
    assert all(r["reg"] < 1 for r in same)  # row id and cluster number agree by chance


def test_small_random_example(make_points):
    x = np.random.default_rng(0).random((10, 10))
    assert select_rows(make_points(x), "density", 2).count() == 2


def test_dispatch_checks_its_arguments(make_points):
    p = make_points([[0.0, 1], [1, 0]])
    with pytest.raises(ValueError, match="n_clusters is required"):
        select_rows(p)
    with pytest.raises(ValueError, match="unknown method"):
        select_rows(p, "other", 1)
    with pytest.raises(ValueError, match="unknown mode"):
        select_density(p, 1, mode="other")


@pytest.mark.parametrize("clustering", ["fuzzy", "minibatch", "mllib"])
def test_other_clusterings(make_points, blobs, clustering):
    r = select_density(make_points(blobs[0]), 3, n_init=1, clustering=clustering, max_iter=5)
    assert 1 <= r.selected.count() <= 3


def test_lookup_of_picked_rows(spark, make_points, blobs):
    picks = spark.createDataFrame([(0, 3), (1, 9)], "k int, row_id long")
    found = select.with_embedding(picks, make_points(blobs[0])).collect()
    assert sorted((r["k"], r["row_id"]) for r in found) == [(0, 3), (1, 9)]
    assert all(len(r["embedding"]) == 4 for r in found)
