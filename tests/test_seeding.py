import numpy as np
import pytest

from labelpick.functions.random import PRIME, uniform_array
from labelpick.operators import cluster, seeding


def plain(x, ids, n, start, rounds, factor, seed):
    """The same draws, one row at a time."""
    u = uniform_array(ids, [start], seeding.FIRST_DRAW, seed)[:, 0]
    chosen = [int(np.lexsort((ids, u))[0])]
    number = 0
    while number < rounds or len({x[i].tobytes() for i in chosen}) < n:
        d2 = np.array([min(((row - x[c]) ** 2).sum() for c in chosen) for row in x])
        if d2.sum() == 0:
            break
        u = uniform_array(ids, [start * seeding.ROUND_STEP + number], seeding.ROUND_DRAW, seed)[:, 0]
        t = np.where(d2 > 0, u / np.where(d2 > 0, d2, 1), np.inf)
        drawn = [i for i in range(len(x)) if t[i] < factor * n / d2.sum() or t[i] == t.min()]
        for i in sorted(drawn, key=lambda i: ids[i]):
            if not any((x[i] == x[c]).all() for c in chosen):
                chosen.append(i)
        number += 1
    near = np.array([np.argmin([((row - x[c]) ** 2).sum() for c in chosen]) for row in x])
    weight, out = np.bincount(near, minlength=len(chosen)).astype(float), []
    for j in range(min(n, len(chosen))):
        rate = weight * np.array([min([((x[c] - x[o]) ** 2).sum() for o in out] or [1.0]) for c in chosen])
        u = uniform_array(ids[chosen], [start * n + j], seeding.PICK_DRAW, seed)[:, 0]
        with np.errstate(divide="ignore"):
            time = np.where(rate > 0, -np.log(np.maximum(u, 1 / PRIME)) / rate, np.inf)
        out.append(chosen[int(np.lexsort((ids[chosen], time))[0])])
    return x[out]


@pytest.mark.parametrize("n, rounds, factor", [(4, 3, 2.0), (7, 1, 0.5), (5, 0, 1.0), (1, 0, 2.0)])
def test_equals_plain_draws(make_points, blobs, n, rounds, factor):
    x, _ = blobs
    ids = np.arange(len(x)) * 3 + 5
    got = seeding.seed_parallel(make_points(x, ids=ids), n, 3, rounds, factor, seed=4)
    for start in range(3):
        assert np.allclose(got[start], plain(x, ids, n, start, rounds, factor, 4))


def test_layout_does_not_matter(make_points, blobs):
    x, _ = blobs
    a, b = (seeding.seed_parallel(make_points(x, partitions=n), 6, 2) for n in (1, 9))
    assert np.array_equal(a, b)


def test_spread_start_beats_the_first_rows(make_points):
    rng = np.random.default_rng(0)
    centers = rng.normal(0, 20, (12, 3))
    x = np.concatenate([c + rng.normal(0, 0.2, (20, 3)) for c in centers])  # sorted by cluster: first rows are all alike
    p = make_points(x)
    spread, first = (cluster.fit_clusters(p, 12, init=init, max_iter=20).cost for init in ("spread", "first"))
    assert spread < 0.2 * first and spread < 12 * 20 * 3 * 0.2 ** 2 * 1.5


def test_copies_fill_up_where_vectors_are_few(make_points):
    x = np.repeat([[0.0, 0], [1, 1], [-0.0, 0]], [5, 5, 2], axis=0)
    got = seeding.seed_parallel(make_points(x), 4, 2)
    assert got.shape == (2, 4, 2)
    assert all({tuple(c) for c in s + 0.0} == {(0.0, 0.0), (1.0, 1.0)} for s in got)


def test_wrong_input(spark, make_points):
    with pytest.raises(ValueError, match="only 2 rows"):
        seeding.seed_parallel(make_points([[0.0], [1.0]]), 3)
    with pytest.raises(ValueError):
        seeding.seed_parallel(make_points([[0.0]]), 0)
    with pytest.raises(ValueError, match="null"):
        seeding.seed_parallel(spark.createDataFrame([(1, None)], "row_id long, embedding array<double>"), 1)
    with pytest.raises(Exception, match="null"):
        seeding.seed_parallel(spark.createDataFrame([(1, None), (2, [1.0]), (3, [2.0])], "row_id long, embedding array<double>"), 2)
