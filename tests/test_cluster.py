import numpy as np
import pytest

from labelpick.functions import kernels as K
from labelpick.operators import cluster, density


def _lloyd(x, c, steps):
    for _ in range(steps):
        a = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        c = np.array([x[a == k].mean(0) if (a == k).any() else c[k] for k in range(len(c))])
    return c


def test_lloyd_equals_numpy_and_inertia_falls(make_points, blobs):
    x, _ = blobs
    p, costs = make_points(x), []
    for steps in (1, 2, 4):
        fit = cluster.lloyd(p, cluster.first_rows(p, 5), steps)
        assert np.allclose(fit.centroids, _lloyd(x, x[:5].copy(), steps))
        costs.append(fit.cost)
    assert costs == sorted(costs, reverse=True)


def test_empty_cluster_keeps_its_center(make_points):
    x = np.array([[0.0, 0], [1, 0], [0, 1]])
    init = np.array([[0.0, 0], [100, 100]])
    fit = cluster.lloyd(make_points(x), init, 3)
    assert np.allclose(fit.centroids[1], [100, 100])


def test_equal_centers_lowest_index_wins(make_points):
    p = make_points([[1.0, 1], [2, 2]])
    rows = cluster.assign_nearest(p, np.array([[2.0, 2], [1, 1], [1, 1]])).orderBy("row_id").collect()
    assert [(r["k"], r["d"]) for r in rows] == [(1, 0.0), (0, 0.0)]


def test_nearest_to_center_takes_smallest_id_and_any_row(make_points):
    p = make_points([[0.0, 0], [1, 0], [1, 0], [5, 5]], ids=[7, 9, 8, 3])
    rows = cluster.nearest_to_center(p, np.array([[1.0, 0], [9, 9]])).orderBy("k").collect()
    assert [r["row_id"] for r in rows] == [8, 3]


def test_restarts_find_the_best_set(make_points, blobs):
    x, _ = blobs
    p = make_points(x)
    starts = cluster.random_rows(p, 3, 4, seed=1)
    assert starts.shape == (4, 3, 4)
    best = min(cluster.lloyd(p, s, 10).cost for s in starts)
    assert cluster.lloyd(p, starts, 11).cost <= best + 1e-9


def test_random_rows_when_restarts_need_more_rows_than_there_are(make_points):
    starts = cluster.random_rows(make_points(np.arange(8).reshape(4, 2)), 3, 5)
    assert starts.shape == (5, 3, 2)
    assert all(len({tuple(c) for c in s}) == 3 for s in starts)


def test_too_many_clusters_null_and_ragged_rows_are_errors(spark, make_points):
    with pytest.raises(ValueError, match="only 2 rows"):
        cluster.first_rows(make_points([[1.0], [2.0]]), 3)
    bad = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "row_id long, embedding array<double>")
    with pytest.raises(Exception, match="embedding is null"):
        cluster.assign_nearest(bad, np.zeros((1, 2))).collect()
    ragged = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "row_id long, embedding array<double>").coalesce(1)
    with pytest.raises(Exception, match="embedding lengths differ"):
        cluster.assign_nearest(ragged, np.zeros((1, 2))).collect()
    with pytest.raises(Exception, match="expected 3"):
        cluster.assign_nearest(make_points([[1.0, 2.0]]), np.zeros((1, 3))).collect()


def test_fuzzy_membership_at_a_center_is_one():
    u = cluster.memberships(np.array([[0.0, 0], [1, 0]]), np.array([[0.0, 0], [3, 0]]))
    assert np.allclose(u[0], [1, 0]) and np.allclose(u[1], [0.8, 0.2])
    both = cluster.memberships(np.array([[0.0, 0]]), np.array([[0.0, 0], [0, 0], [1, 1]]))
    assert np.allclose(both, [[0.5, 0.5, 0]])


def test_fuzzy_stops_when_centers_rest(make_points, blobs):
    x, _ = blobs
    p = make_points(x)
    fit = cluster.fuzzy_cmeans(p, x[[0, 30, 60]], 200, tol=1e-6)
    assert fit.n_iter < 200
    u = cluster.memberships(x, fit.centroids) ** 2
    assert np.allclose(fit.centroids, (u.T @ x) / u.sum(0)[:, None], atol=1e-5)


def test_minibatch_walks_through_all_rows(make_points, blobs):
    x, _ = blobs
    fit = cluster.minibatch_kmeans(make_points(x), x[:3], batch_size=10, max_passes=3, tol=0.0)
    assert fit.n_iter == 3 and np.isfinite(fit.centroids).all() and not fit.converged
    whole = cluster.minibatch_kmeans(make_points(x), x[:1], batch_size=7, max_passes=1, tol=0.0)
    assert np.allclose(whole.centroids[0], x.mean(0))  # one center: the mean of every row, so none was left out


def test_fits_say_whether_they_converged(make_points, blobs):
    p, x = make_points(blobs[0]), blobs[0]
    short, full = cluster.lloyd(p, x[:3], 1, 1e-9), cluster.lloyd(p, x[:3], tol=1e-9)
    assert full.converged and full.cost <= short.cost
    again = cluster.lloyd(p, full.centroids, 1, 1e-9)
    assert again.converged and np.allclose(again.centroids, full.centroids)
    assert cluster.fit_clusters(p, 3, "fuzzy").converged
    near = ((x[:, None] - full.centroids) ** 2).sum(2).min(1)
    assert np.isclose(full.cost, near.sum())  # the cost is that of the returned centers


def test_mllib_path(make_points, blobs):
    x, _ = blobs
    fit = cluster.fit_clusters(make_points(x), 3, "mllib", n_init=2, max_iter=5)
    assert fit.centroids.shape == (3, 4)


def test_result_does_not_depend_on_partitions(make_points, blobs):
    x, _ = blobs
    fits = [cluster.lloyd(make_points(x, partitions=n), x[:4], 3).centroids for n in (1, 2, 7)]
    assert np.allclose(fits[0], fits[1]) and np.allclose(fits[0], fits[2])


def _brute_density(x, a, k, eps):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        others = np.flatnonzero((a == a[i]) & (np.arange(len(x)) != i))
        near = np.sort(d[i, others])[:k]
        out.append(1 / ((near.mean() if len(near) else 0.0) + eps))
    return np.array(out)


@pytest.mark.parametrize("block_rows,k", [(4, 1), (4, 40), (9, 5), (20_000, 5)])
def test_row_density_is_exact_for_any_block_size(make_points, blobs, block_rows, k):
    x, _ = blobs
    x = np.vstack([x, [[50.0, 50, 50, 50]]])  # alone in its cluster
    centers = np.vstack([x[:2], x[-1:]])
    a = K.nearest(x, centers)[0]
    want = _brute_density(x, a, k, 1e-5)
    assigned = cluster.assign_nearest(make_points(x), centers, keep=("embedding",))
    rows = density.row_density(assigned, k, 1e-5, block_rows).collect()
    assert len(rows) == len({(int(c), tuple(v)) for c, v in zip(a, x)})  # one row per distinct vector
    for r in rows:
        assert np.isclose(r["density"], want[r["row_id"]], rtol=1e-9)


def test_cluster_density_uses_all_members_of_small_clusters(spark):
    rows = spark.createDataFrame([(1, 0, 2.0), (2, 0, 4.0), (3, 1, 0.0)], "row_id long, k int, d double")
    got = {r["k"]: r["density"] for r in density.cluster_density(rows, 10, 0.5).collect()}
    assert np.isclose(got[0], 1 / 3.5) and np.isclose(got[1], 2.0)


@pytest.mark.parametrize("block_rows", [6, 17, 1000])
def test_rows_leave_waves_early_and_pairs_are_reported(make_points, block_rows):
    rng = np.random.default_rng(8)
    centers = rng.normal(0, 6, (12, 5))
    x = np.concatenate([c + rng.normal(0, 0.4, (15, 5)) for c in centers])
    x[:40] = x[0]  # copies
    p = make_points(x)
    seen, states = [], []

    def write(df, name):
        from labelpick.session import materialize
        stored = materialize(df, name)
        if name in ("own_block", "wave"):
            states.append(stored)
        return stored

    assigned = cluster.assign_nearest(p, x.mean(0)[None], keep=("embedding",))
    rows = density.row_density(assigned, 4, 1e-5, block_rows, write, seen).collect()
    want = _brute_density(x, np.zeros(len(x), int), 4, 1e-5)
    assert len(rows) == len(np.unique(x, axis=0))
    assert all(np.isclose(r["density"], want[r["row_id"]], rtol=1e-9) for r in rows)
    total = seen[0].all_pairs
    if block_rows == 1000:
        assert len(seen) == 1 and seen[0].pairs == total
    else:
        assert len(seen) > 1 and sum(v.pairs for v in seen) < 0.6 * total
        assert all(a.rows >= 1 for a in seen)
        for state in states:  # at most k distances per row are handed on
            assert max(len(r["top"]) for r in state.collect()) <= 4


@pytest.mark.parametrize("task_rows", [5, 4_096])
def test_small_blocks_ask_each_cell_once(make_points, monkeypatch, task_rows):
    """Groups that are compared depend on the rows of a task, not on the blocks; the densities depend on neither."""
    monkeypatch.setattr(density, "TASK_ROWS", task_rows)
    x = np.random.default_rng(5).normal(size=(120, 8))
    groups = []

    def write(df, name):
        from labelpick.session import materialize
        stored = materialize(df, name)
        if name == "visits":
            groups.extend(r["chunks"] * r["teams"] for r in stored.collect())
        return stored

    assigned = cluster.assign_nearest(make_points(x), x.mean(0)[None], keep=("embedding",))
    rows = density.row_density(assigned, 3, 1e-5, 4, write).collect()
    want = _brute_density(x, np.zeros(len(x), int), 3, 1e-5)
    assert len(rows) == 120 and all(np.isclose(r["density"], want[r["row_id"]], rtol=1e-9) for r in rows)
    assert groups and (max(groups) == 1) == (task_rows == 4_096)


def test_lower_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6))
    pivots = x[:9]
    dp = np.sqrt(((x[:, None] - pivots[None]) ** 2).sum(-1))
    cell = dp.argmin(1)
    lo = np.array([dp[cell == c].min(0) for c in range(9)])
    hi = np.array([dp[cell == c].max(0) for c in range(9)])
    between = np.sqrt(((pivots[:, None] - pivots[None]) ** 2).sum(-1))
    bound = density.lower_bounds(dp, lo, hi, between)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for c in range(9):
        assert (bound[:, c] <= d[:, cell == c].min(1)).all()
    assert (bound > 0).any()


@pytest.mark.parametrize("k", [1, 7, 1500])
def test_cluster_density_for_any_k_sorts_no_cluster(spark, monkeypatch, k):
    rng = np.random.default_rng(4)
    cl, d = rng.choice([0, 0, 0, 0, 5, 9], 5000), rng.random(5000).round(3)
    rows = spark.createDataFrame([(i, int(c), float(v)) for i, (c, v) in enumerate(zip(cl, d))],
                                 "row_id long, k int, d double").repartition(20)
    for per_core in (1, 40):
        monkeypatch.setattr(density, "TASKS_PER_CORE", per_core)
        table = density.cluster_density(rows, k, 0.1)
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "MapInArrow" in plan
        got = {r["k"]: r["density"] for r in table.collect()}
        assert all(np.isclose(got[c], 1 / (np.sort(d[cl == c])[:k].mean() + 0.1)) for c in (0, 5, 9)) and len(got) == 3


def test_minibatch_restarts_share_the_table_and_starved_centers_are_drawn_anew(make_points, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(m, 0.3, (60, 2)) for m in (0, 8, 16)])
    p, dealt = make_points(x), []
    whole = cluster.lay_out
    monkeypatch.setattr(cluster, "lay_out", lambda *a: dealt.append(1) or whole(*a))
    far = np.array([[0.0, 0], [500, 500], [600, 600]])  # two centers that never draw a row
    starts = np.stack([far, x[[0, 60, 120]]])
    kept = cluster.minibatch_kmeans(p, far, 45, max_passes=6, tol=0.0, reassign=0.0)
    anew = cluster.minibatch_kmeans(p, far, 45, max_passes=6, tol=0.0)
    both = cluster.minibatch_kmeans(p, starts, 45, max_passes=6, tol=0.0)
    assert np.allclose(kept.centroids[1], [500, 500]) and anew.cost < 0.2 * kept.cost
    assert both.cost <= cluster.minibatch_kmeans(p, starts[1], 45, max_passes=6, tol=0.0).cost + 1e-9
    assert len(dealt) == 4  # once per fit, not per start


def test_default_start_is_spread(make_points, blobs, monkeypatch):
    calls = []
    whole = cluster.seed_parallel
    monkeypatch.setattr(cluster, "seed_parallel", lambda *a, **b: calls.append(1) or whole(*a, **b))
    x, _ = blobs
    for kind in ("lloyd", "fuzzy", "minibatch"):
        cluster.fit_clusters(make_points(x), 3, kind, max_iter=2)
    assert len(calls) == 3
    with pytest.raises(ValueError, match="unknown clustering"):
        cluster.fit_clusters(make_points(x), 3, "other")
