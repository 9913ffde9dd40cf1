"""Clustering of embeddings against a small set of centers that every task holds; the points never shuffle."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from labelpick.functions import kernels as K
from labelpick.functions.random import uniform, uniform_array
from labelpick.functions.vectors import doubles
from labelpick.operators.partials import TASKS_PER_CORE, collect_sums
from labelpick.operators.seeding import seed_parallel
from labelpick.operators.steps import BatchLayout, lay_out
from labelpick.operators.tiles import Centers, center_tiles
from labelpick.session import check_model_size, scratch_tables, ship
from labelpick.sources.tables import dimension

INIT_DRAW, REDRAW = 900_002, 900_100
MAX_PASSES = 300


@dataclass
class ClusterFit:
    """``cost`` is that of the returned centers; ``converged`` is false if the limit of passes ended the fit."""
    centroids: np.ndarray
    cost: float
    n_iter: int
    converged: bool = False


def centroid_table(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    """(k, c): the centers as a small table."""
    check_model_size(centroids.size, "centroids")
    return spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "k int, c array<double>")


def _matrix(rows) -> np.ndarray:
    if any(r["embedding"] is None or None in r["embedding"] for r in rows):
        raise ValueError("embedding is null")
    if len({len(r["embedding"]) for r in rows}) > 1:
        raise ValueError("embedding lengths differ")
    return np.array([r["embedding"] for r in rows], dtype=float)


def _first_by(points: DataFrame, n: int, *order) -> np.ndarray:
    if n < 1:
        raise ValueError("n_clusters must be at least 1")
    check_model_size(n * dimension(points), "initial centroids")
    rows = points.orderBy(*order).select("embedding").limit(n).collect()
    if len(rows) < n:
        raise ValueError(f"n_clusters asks for {n} centers but there are only {len(rows)} rows")
    return _matrix(rows)


def first_rows(points: DataFrame, n: int) -> np.ndarray:
    """The rows with the n smallest ids as initial centers."""
    return _first_by(points, n, "row_id")


def random_rows(points: DataFrame, n: int, restarts: int = 1, seed: int = 0) -> np.ndarray:
    """(restarts, n, dim) initial centers: seeded random rows, drawn in one pass for all restarts."""
    u = uniform(F.col("row_id"), 0, INIT_DRAW, seed)
    n_rows = points.count()
    if n_rows >= n * restarts:
        return _first_by(points, n * restarts, u, "row_id").reshape(restarts, n, -1)
    return np.stack([_first_by(points, n, uniform(F.col("row_id"), r, INIT_DRAW, seed), "row_id")
                     for r in range(restarts)])


def assign_nearest(points: DataFrame, centroids: Centers, keep: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, k, d, *keep): nearest center of every row and its Euclidean distance; lowest k on ties.

    Points meet one tile of centers per pass. With several tiles, the nearest of each are merged by row id.
    """
    found = [_nearest_of_tile(points, numbers, tile, keep, n == 0)
             for n, (numbers, tile, _) in enumerate(center_tiles(centroids))]
    if len(found) == 1:
        return found[0]
    best = reduce(DataFrame.unionByName, found).groupBy("row_id").agg(
        F.min(F.struct("d", "k")).alias("m"), *[F.first(c, ignorenulls=True).alias(c) for c in keep])
    return best.select("row_id", "m.k", "m.d", *keep)


def _nearest_of_tile(points: DataFrame, numbers: np.ndarray, tile: np.ndarray, keep: tuple[str, ...],
                     carry: bool) -> DataFrame:
    """``carry``: whether the columns in ``keep`` come along or are null."""
    shared = ship(points.sparkSession, [numbers, tile], "centroids")

    @arrow_udf("struct<k:int,d:double>")
    def near(vec: pa.Array) -> pa.Array:
        names, centers = shared.value
        k, d = K.nearest(K.to_matrix(vec), centers)
        return pa.StructArray.from_arrays([pa.array(names[k].astype(np.int32)), pa.array(d)], names=["k", "d"])

    kept = [F.col(c) if carry else F.lit(None).cast(points.schema[c].dataType).alias(c) for c in keep]
    found = points.select("row_id", near("embedding").alias("_near"), *kept)
    return found.select("row_id", F.col("_near.k").alias("k"), F.col("_near.d").alias("d"), *keep)


def center_distances(points: DataFrame, centroids: Centers) -> DataFrame:
    """(row_id, k, d): every row against every center, in long form; a task holds one tile of centers."""
    def of_tile(numbers, tile):
        shared = ship(points.sparkSession, [numbers, tile], "centroids")

        @arrow_udf("array<double>")
        def far(vec: pa.Array) -> pa.Array:
            x, centers = K.to_matrix(vec), shared.value[1]
            if not len(x):
                return pa.array([], pa.list_(pa.float64()))
            K.check_dim(x, centers.shape[1])
            return K.to_lists(np.sqrt(K.squared_distances(x, centers)))

        pairs = points.select("row_id", F.posexplode(far("embedding")).alias("k", "d"))
        first = int(numbers[0])
        if len(numbers) == int(numbers[-1]) - first + 1:  # no gaps
            return pairs.withColumn("k", F.col("k") + first) if first else pairs
        names = F.array(*[F.lit(int(n)) for n in numbers])
        return pairs.withColumn("k", F.get(names, "k"))

    return reduce(DataFrame.unionByName, [of_tile(numbers, tile) for numbers, tile, _ in center_tiles(centroids)])


def nearest_to_center(points: DataFrame, centroids: Centers) -> DataFrame:
    """(k, row_id, d): the row closest to each center, members or not; smallest row id on ties."""
    def of_tile(numbers, tile):
        shared = ship(points.sparkSession, [numbers, tile], "centroids")

        def run(found):
            names, centers = shared.value
            best_d = np.full(len(centers), np.inf)
            best_id = np.zeros(len(centers), np.int64)
            for batch in found:
                if not batch.num_rows:
                    continue
                x, ids = K.to_matrix(batch.column("embedding")), K.ints(batch.column("row_id"))
                K.check_dim(x, centers.shape[1])
                step = max(1, K.TILE_VALUES // len(centers))
                for at in range(0, len(x), step):
                    _closer(x[at:at + step], ids[at:at + step], centers, best_d, best_id)
            ok = np.flatnonzero(np.isfinite(best_d))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[ok].astype(np.int32)), pa.array(best_d[ok]), pa.array(best_id[ok])],
                names=["k", "d", "row_id"])

        few = points.select("row_id", "embedding").coalesce(TASKS_PER_CORE * points.sparkSession.sparkContext.defaultParallelism)
        return few.mapInArrow(run, "k int, d double, row_id long")

    per_task = reduce(DataFrame.unionByName, [of_tile(numbers, tile) for numbers, tile, _ in center_tiles(centroids)])
    return (per_task.groupBy("k").agg(F.min(F.struct("d", "row_id")).alias("m"))
            .select("k", F.col("m.row_id").alias("row_id"), F.col("m.d").alias("d")))


def _closer(x: np.ndarray, ids: np.ndarray, centers: np.ndarray, best_d: np.ndarray, best_id: np.ndarray) -> None:
    """Take rows that are closer to a center than the best so far."""
    approx, slack = K.product_distances(x, centers)
    limit = (approx + 2 * slack[:, None]).min(axis=0)
    rows, ks = np.nonzero(approx <= limit[None, :] + 2 * slack[:, None])
    diff = x[rows] - centers[ks]
    d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    order = np.lexsort((ids[rows], d, ks))
    lead, at = np.unique(ks[order], return_index=True)
    d, row = d[order][at], ids[rows][order][at]
    better = (d < best_d[lead]) | ((d == best_d[lead]) & (row < best_id[lead]))
    best_d[lead[better]], best_id[lead[better]] = d[better], row[better]


def means_by_key(rows: DataFrame, n_keys: int, key: str = "label") -> np.ndarray:
    """(n_keys, dim) mean embedding per integer key 0..n_keys-1; zeros for keys without rows."""
    dim = dimension(rows)

    def fold(acc, batch):
        sums, counts = K.group_sums(K.to_matrix(batch.column(1)), K.ints(batch.column(0)), n_keys)
        acc["sum"] += sums
        acc["n"] += counts

    got = collect_sums(rows.select(F.col(key).cast("int"), "embedding"), {"sum": (n_keys, dim), "n": (n_keys,)}, fold)
    return got["sum"] / np.maximum(got["n"], 1.0)[:, None]


def lloyd(points: DataFrame, init: np.ndarray, max_iter: int = MAX_PASSES, tol: float = 0.0) -> ClusterFit:
    """Lloyd's algorithm from fixed centers. An empty cluster keeps its center.

    ``init`` may hold several sets of centers (restarts, K, dim): all restarts advance in the same pass over the data
    and the one with the lowest cost wins. Stops when the squared shift falls to ``tol`` times the mean variance.
    """
    init = np.asarray(init, float)
    centers = init[None] if init.ndim == 2 else init.copy()
    n_sets, k, dim = centers.shape
    spark, vectors = points.sparkSession, points.select("embedding")
    shapes = {"sum": (n_sets, k, dim), "n": (n_sets, k), "cost": (n_sets,), "square": (1,)}

    def one_pass(current):
        shared = ship(spark, current, "centroids")

        def fold(acc, batch):
            x = K.to_matrix(batch.column(0))
            acc["square"] += (x * x).sum()
            for s, c in enumerate(shared.value):
                near, d = K.nearest(x, c)
                sums, counts = K.group_sums(x, near, k)
                acc["sum"][s] += sums
                acc["n"][s] += counts
                acc["cost"][s] += (d * d).sum()

        got = collect_sums(vectors, shapes, fold)
        shared.destroy()
        return got

    done, shift, converged = 0, np.inf, False
    for done in range(1, max_iter + 1):
        got = one_pass(centers)
        counts = got["n"][:, :, None]
        moved = np.where(counts > 0, got["sum"] / np.maximum(counts, 1.0), centers)
        shift = ((moved - centers) ** 2).sum(axis=(1, 2)).max()
        n_rows = got["n"][0].sum()
        mean = got["sum"][0].sum(axis=0) / max(n_rows, 1.0)
        variance = max(got["square"][0] / max(n_rows, 1.0) - (mean * mean).sum(), 0.0) / dim
        centers = moved
        converged = bool(tol > 0 and shift <= tol * variance or shift == 0.0)
        if converged:
            break
    # centers that no longer move have the cost of the last pass
    cost = got["cost"] if shift == 0.0 else one_pass(centers)["cost"]
    best = int(cost.argmin())
    return ClusterFit(centers[best], float(cost[best]), done, converged)


def kmeans_mllib(points: DataFrame, n_clusters: int, n_init: int = 1, max_iter: int = MAX_PASSES, tol: float = 1e-4,
                 seed: int = 0) -> ClusterFit:
    """MLlib K-means with its parallel seeding, ``n_init`` times; the run with the lowest cost is kept."""
    data = points.select(array_to_vector(doubles("embedding")).alias("features")).persist()
    best = None
    for i in range(n_init):
        model = KMeans(k=n_clusters, maxIter=max_iter, tol=tol, seed=seed + i).fit(data)
        fit = ClusterFit(np.array(model.clusterCenters()), model.summary.trainingCost, model.summary.numIter,
                         model.summary.numIter < max_iter)
        best = fit if best is None or fit.cost < best.cost else best
    data.unpersist()
    return best


def memberships(x: np.ndarray, centers: np.ndarray, fuzzifier: float = 2.0) -> np.ndarray:
    """Fuzzy memberships of one batch; a point lying on centers belongs to those alone."""
    d2 = K.squared_distances(x, centers)
    low = d2.min(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = (low / d2) ** (1.0 / (fuzzifier - 1.0))
    weight = np.where(low == 0.0, (d2 == 0.0).astype(float), weight)
    return weight / weight.sum(axis=1, keepdims=True)


def fuzzy_cmeans(points: DataFrame, init: np.ndarray, max_iter: int = MAX_PASSES, tol: float = 0.0,
                 fuzzifier: float = 2.0) -> ClusterFit:
    """Bezdek's fuzzy C-means from fixed centers; stops when no center entry moves by more than ``tol``."""
    centers = np.array(init, float)
    k, dim = centers.shape
    vectors, done, converged = points.select("embedding"), 0, False

    def one_pass(centers):
        shared = ship(points.sparkSession, centers, "centroids")

        def fold(acc, batch, shared=shared):
            for x in K.row_tiles(K.to_matrix(batch.column(0)), k):
                K.check_dim(x, dim)
                weight = memberships(x, shared.value, fuzzifier) ** fuzzifier
                acc["sum"] += weight.T @ x
                acc["weight"] += weight.sum(axis=0)
                acc["cost"] += (weight * K.squared_distances(x, shared.value)).sum()

        got = collect_sums(vectors, {"sum": (k, dim), "weight": (k,), "cost": (1,)}, fold)
        shared.destroy()
        return got

    for done in range(1, max_iter + 1):
        got = one_pass(centers)
        weight = got["weight"][:, None]
        moved = np.where(weight > 0, got["sum"] / np.where(weight > 0, weight, 1.0), centers)
        shift, centers = np.abs(moved - centers).max(), moved
        converged = bool(shift <= tol)
        if converged:
            break
    return ClusterFit(centers, float(one_pass(centers)["cost"][0]), done, converged)


def minibatch_kmeans(points: DataFrame, init: np.ndarray, batch_size: int | None = None, max_passes: int = 100,
                     tol: float = 0.001, seed: int = 42, reassign: float = 0.01) -> ClusterFit:
    """Mini-batch K-means: each step moves the centers by one seeded random batch, weighted by running counts.

    ``init`` may hold several sets of centers (restarts, K, dim): all advance in the same steps over one dealt table, and
    the one with the lowest cost wins. All rows are dealt into batches once and kept in a scratch table, so a step reads
    only its own batch, and a pass visits every row. By default a batch is a hundredth of the table, 10,000 rows at least,
    so the number of steps does not grow with the table. Between passes, centers that have drawn fewer rows than
    ``reassign`` times the most drawn one of their set are drawn anew (0 leaves them). A set stops when its squared shift
    over a whole pass, without new draws, falls to ``tol`` times the mean variance.
    """
    init = np.asarray(init, float)
    n_rows = points.count()
    size = batch_size or max(10_000, -(-n_rows // 100))
    with scratch_tables(points.sparkSession) as write:
        layout = lay_out(points.select("row_id", "embedding"), size, 1, seed, write)
        return _minibatch_passes(layout, init[None] if init.ndim == 2 else init.copy(), max_passes, tol, seed, reassign)


def _starved(seen: np.ndarray, share: float) -> np.ndarray:
    """(set, center) pairs that drew less than ``share`` of the most drawn center of their set."""
    return np.argwhere(seen < share * seen.max(axis=1, keepdims=True))


def _drawn_anew(rows: DataFrame, pairs: np.ndarray, n_centers: int, number: int, seed: int) -> np.ndarray:
    """One row for each pair: the first one by a uniform number of row, pair and pass."""
    shared = [int(s) * n_centers + int(k) for s, k in pairs]

    def run(batches):
        best: dict[int, tuple] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = K.ints(batch.column("row_id"))
            u = uniform_array(ids, np.array(shared), REDRAW + number, seed)
            for at, column in enumerate(u.T):
                i = int(np.lexsort((ids, column))[0])
                if at not in best or (column[i], ids[i]) < best[at][:2]:
                    best[at] = (column[i], int(ids[i]), batch.column("embedding")[i].as_py())
        names, kinds = ["pair", "u", "row_id", "embedding"], [pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64())]
        found = [(at, *rest) for at, rest in best.items()]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], names)

    per_task = rows.select("row_id", "embedding").mapInArrow(run, "pair int, u double, row_id long, embedding array<double>")
    first = per_task.groupBy("pair").agg(F.min_by("embedding", F.struct("u", "row_id")).alias("x")).orderBy("pair").collect()
    return np.array([r["x"] for r in first])  # one row per pair


def _minibatch_passes(layout: BatchLayout, centers: np.ndarray, max_passes: int, tol: float, seed: int,
                      reassign: float) -> ClusterFit:
    n_sets, k, dim = centers.shape
    seen, done = np.zeros((n_sets, k)), 0
    settled = np.zeros(n_sets, bool)
    shapes = {"sum": (n_sets, k, dim), "n": (n_sets, k), "cost": (n_sets,), "square": (1,)}

    def one_pass(rows, current):
        shared = ship(layout.rows.sparkSession, current, "centroids")

        def fold(acc, batch):
            x = K.to_matrix(batch.column(0))
            acc["square"] += (x * x).sum()
            for s, c in enumerate(shared.value):
                near, d = K.nearest(x, c)
                sums, counts = K.group_sums(x, near, k)
                acc["sum"][s] += sums
                acc["n"][s] += counts
                acc["cost"][s] += (d * d).sum()

        got = collect_sums(rows.select("embedding"), shapes, fold)
        shared.destroy()
        return got

    for done in range(1, max_passes + 1):
        before, total, square = centers, np.zeros(dim), 0.0
        for rows in layout.steps(0):
            got = one_pass(rows, centers)
            new = np.where(settled[:, None], 0.0, got["n"])
            counts = seen + new
            moved = (centers * seen[:, :, None] + got["sum"]) / np.maximum(counts, 1.0)[:, :, None]
            centers = np.where(new[:, :, None] > 0, moved, centers)
            seen, total, square = counts, total + got["sum"][0].sum(axis=0), square + got["square"][0]
        variance = max(square / layout.n_rows - ((total / layout.n_rows) ** 2).sum(), 0.0) / dim
        starved = _starved(seen, reassign) if done < max_passes else np.empty((0, 2), int)
        starved = starved[~settled[starved[:, 0]]]
        settled |= (((centers - before) ** 2).sum(axis=(1, 2)) <= tol * variance) & ~np.isin(np.arange(n_sets), starved[:, 0])
        if len(starved):
            centers[starved[:, 0], starved[:, 1]] = _drawn_anew(layout.rows, starved, k, done, seed)
            low = np.where(seen >= reassign * seen.max(axis=1, keepdims=True), seen, np.inf).min(axis=1)
            seen[starved[:, 0], starved[:, 1]] = low[starved[:, 0]]  # as much weight as the least drawn of the others
        if settled.all():
            break
    cost = one_pass(layout.rows, centers)["cost"]
    best = int(cost.argmin())
    return ClusterFit(centers[best], float(cost[best]), done, bool(settled[best]))


def fit_clusters(points: DataFrame, n_clusters: int, clustering: str = "lloyd", init="spread", n_init: int = 1,
                 max_iter: int = MAX_PASSES, tol: float = 1e-4, seed: int = 0) -> ClusterFit:
    """One entry point for all clusterings: ``lloyd``, ``fuzzy``, ``minibatch`` or ``mllib``.

    ``init`` is ``spread`` (parallel seeding), ``random`` or ``first`` rows, or the centers themselves. ``max_iter`` limits
    the passes over the table; mini-batches make 100 at most. Fuzzy clustering is fitted once.
    """
    if clustering == "fuzzy":
        n_init = 1
    if clustering == "mllib":
        return kmeans_mllib(points, n_clusters, n_init, max_iter, tol, seed)
    if isinstance(init, str):
        starts = {"spread": lambda: seed_parallel(points, n_clusters, n_init, seed=seed),
                  "first": lambda: first_rows(points, n_clusters),
                  "random": lambda: random_rows(points, n_clusters, n_init, seed)}[init]()
    else:
        starts = np.asarray(init, float)
    if clustering == "lloyd":
        return lloyd(points, starts, max_iter, tol)
    if clustering == "minibatch":
        return minibatch_kmeans(points, starts, max_passes=min(max_iter, 100), tol=tol, seed=seed)
    if clustering != "fuzzy":
        raise ValueError(f"unknown clustering {clustering}")
    return fuzzy_cmeans(points, starts[0] if starts.ndim == 3 else starts, max_iter, tol)
