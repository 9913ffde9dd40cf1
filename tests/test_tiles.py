import numpy as np
import pytest

from labelpick.operators import cluster, repulsion, tiles
from labelpick.session import ship


@pytest.fixture
def small_tiles(monkeypatch):
    """Tiles of at most 4 kB; remembers how many bytes each broadcast held."""
    monkeypatch.setattr(tiles, "TILE_BYTES", 4096)
    sent = []

    def recording(spark, value, what="model"):
        sent.append(max(np.asarray(a).nbytes for a in value))
        return ship(spark, value, what)

    monkeypatch.setattr(cluster, "ship", recording)
    monkeypatch.setattr(repulsion, "ship", recording)
    return sent


def data(n=300, k=1000, dim=4):
    rng = np.random.default_rng(2)
    x, c = rng.normal(size=(n, dim)), rng.normal(size=(k, dim))
    c[700] = c[5]  # a tie across tiles
    x[3] = c[5]
    return x, c, np.sqrt(((x[:, None] - c[None]) ** 2).sum(-1))


@pytest.mark.parametrize("as_table", [False, True])
def test_nearest_center_over_tiles(spark, make_points, small_tiles, as_table):
    x, c, d = data()
    centers = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(c)], "k int, c array<double>") if as_table else c
    got = cluster.assign_nearest(make_points(x, labels=list(range(300))), centers, keep=("label",)).collect()
    assert len(got) == 300 and len(small_tiles) == 8 and max(small_tiles) <= 4096
    for r in got:
        assert r.k == d[r.row_id].argmin() and np.isclose(r.d, d[r.row_id].min()) and r.label == r.row_id


def test_distances_and_nearest_rows_over_tiles(make_points, small_tiles):
    x, c, d = data(40)
    p = make_points(x)
    long = cluster.center_distances(p, c).collect()
    assert len(long) == 40 * 1000 and all(np.isclose(r.d, d[r.row_id, r.k]) for r in long)
    near = {r.k: r.row_id for r in cluster.nearest_to_center(p, c).collect()}
    assert near == {k: int(d[:, k].argmin()) for k in range(1000)}
    assert max(small_tiles) <= 4096


def test_center_numbers_may_have_gaps(spark, make_points, small_tiles):
    x, c, d = data(20)
    numbers = np.arange(200) * 3 + 7
    table = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(numbers, c[:200])], "k int, c array<double>")
    p = make_points(x)
    assert {r.row_id: r.k for r in cluster.assign_nearest(p, table).collect()} == {
        i: int(numbers[d[i, :200].argmin()]) for i in range(20)}
    assert {(r.row_id, r.k) for r in cluster.center_distances(p, table).collect()} == {
        (i, int(k)) for i in range(20) for k in numbers}


@pytest.mark.parametrize("exclude", ["cluster", "row_vs_cluster"])
def test_repulsion_over_tiles(spark, small_tiles, exclude):
    x, _, _ = data(400, 801)
    picks = spark.createDataFrame([(k, k + 2, v.tolist()) for k, v in enumerate(x)],
                                  "k int, row_id long, embedding array<double>")
    got = {r.k: r.repulsion for r in repulsion.repulsion(picks, picks, exclude=exclude).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    terms = 1 / (d ** 0.75 + 1e-5)
    other = np.arange(400) if exclude == "cluster" else np.arange(400) + 2
    terms[other[None, :] == np.arange(400)[:, None]] = 0
    assert len(small_tiles) > 1 and max(small_tiles) <= 4096
    assert all(np.isclose(got[k], terms[k].sum()) for k in range(400))


def test_many_centers_within_the_bytes_of_a_tile(spark, make_points, monkeypatch):
    """100,000 centers: no broadcast is larger than a tile, however small the limit for models is."""
    from labelpick import session

    rng = np.random.default_rng(0)
    centers = rng.normal(size=(100_000, 8))
    x = centers[::25_000] + 1e-6
    monkeypatch.setattr(tiles, "TILE_BYTES", 1 << 20)
    monkeypatch.setattr(session, "MODEL_BYTES_LIMIT", 2 << 20)
    rows = cluster.assign_nearest(make_points(x), centers).collect()
    assert sorted(r.k for r in rows) == [0, 25_000, 50_000, 75_000]
    with pytest.raises(ValueError, match="limit"):
        session.ship(spark, centers)
