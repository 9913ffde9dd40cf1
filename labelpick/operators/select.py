"""Choosing the rows to label."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelpick.functions import kernels as K
from labelpick.operators import cluster, density
from labelpick.operators.repulsion import Anchors, ema_factor, repulsion, repulsion_terms, with_utility
from labelpick.session import materialize, scratch_tables, ship


@dataclass
class SelectionResult:
    """``selected``: (cluster, row_id, density, reg, score, rank); ``nearest``: (k, row_id, d);
    ``assignment``: (row_id, k, d)."""
    selected: DataFrame
    nearest: DataFrame
    assignment: DataFrame
    centroids: np.ndarray


def first_members(assigned: DataFrame) -> DataFrame:
    """(k, row_id, members): the smallest row id of every cluster that has rows."""
    return assigned.groupBy("k").agg(F.min("row_id").alias("row_id"), F.count("*").alias("members"))


def with_embedding(picks: DataFrame, points: DataFrame) -> DataFrame:
    """Look up the embeddings of picked rows. They are stored first, so Spark knows how few they are."""
    return materialize(picks, "picked_ids").join(points.select("row_id", "embedding"), "row_id")


def select_first_member(points: DataFrame, assigned: DataFrame, n_clusters: int, *, k: int = 10, m_reg: float = 0.9,
                        lambda_: float = 0.5, epsilon: float = 1e-5, alpha: float = 0.75, rounds: int = 10,
                        exclude: str = "cluster") -> DataFrame:
    """(k, row_id, density, reg, utility), one row per non-empty cluster.

    The density is one number per cluster, so every round picks the member with the smallest row id and the moving
    average of the repulsion has a closed form. One pass replaces the rounds.
    """
    firsts = first_members(assigned)
    picks = materialize(with_embedding(firsts.select("k", "row_id"), points), "picks")
    pushed = repulsion(picks, picks, alpha, epsilon, exclude)
    dense = density.cluster_density(assigned, k, epsilon)
    share = ema_factor(m_reg, rounds)
    return with_utility(pushed.join(dense, "k").select(
        "k", "row_id", "density", (F.lit(share) * F.col("repulsion")).alias("reg")), lambda_)


def _best_per_cluster(dense: DataFrame, kind, anchors: Anchors | None, weights: np.ndarray | None,
                      lambda_: float, alpha: float, epsilon: float) -> DataFrame:
    """(k, row_id, embedding, density, reg, utility) of the best row per cluster.

    Each task returns its best row per cluster. ``anchors`` are the rows selected in earlier rounds, with the weight
    their rounds still have in the moving average.
    """
    spark = dense.sparkSession
    shared = None if anchors is None else ship(
        spark, [anchors.cluster, anchors.row_id, anchors.vector, weights], "selected rows")

    def run(found):
        best: dict[int, tuple] = {}
        for batch in found:
            if not batch.num_rows:
                continue
            cl, ids = K.ints(batch.column("k")), K.ints(batch.column("row_id"))
            dens = batch.column("density").to_numpy(zero_copy_only=False)
            reg = np.zeros(len(ids))
            if shared is not None:
                *parts, weight = shared.value
                x = density.unpack(batch.column("vec"), kind)
                reg = repulsion_terms(x, cl, Anchors(*parts), alpha, epsilon) @ weight
            utility = dens - lambda_ * reg
            order = np.lexsort((ids, -utility, cl))
            lead, at = np.unique(cl[order], return_index=True)
            for c, i in zip(lead.tolist(), order[at].tolist()):
                seen = best.get(c)
                if seen is None or (-utility[i], ids[i]) < (-seen[2], seen[1]):
                    best[c] = (c, int(ids[i]), float(utility[i]), float(dens[i]), float(reg[i]),
                               batch.column("vec")[i].as_py())
        rows = list(best.values())
        names = ["k", "row_id", "utility", "density", "reg", "vec"]
        kinds = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    per_task = dense.select("k", "row_id", "vec", "density").mapInArrow(
        run, "k int, row_id long, utility double, density double, reg double, vec binary")
    best = per_task.groupBy("k").agg(F.max_by(
        F.struct("row_id", "utility", "density", "reg", "vec"), F.struct("utility", -F.col("row_id"))).alias("b"))
    return best.select("k", "b.*")


def select_per_point(assigned: DataFrame, *, k: int = 10, m_reg: float = 0.9, lambda_: float = 0.5,
                     epsilon: float = 1e-5, alpha: float = 0.75, rounds: int = 10,
                     block_rows: int = density.BLOCK_ROWS) -> DataFrame:
    """(k, row_id, density, reg, utility) with a density of its own for every row (``assigned`` carries embedding).

    The moving average of a row after some rounds is a weighted sum over the rows selected so far, so a round needs no
    state per row: it reads the stored densities once and returns one row per cluster.
    """
    wide = assigned.schema["embedding"].dataType.elementType.simpleString() != "float"
    kind = np.float64 if wide else np.float32
    with scratch_tables(assigned.sparkSession) as write:
        dense = write(density.row_density(assigned, k, epsilon, block_rows, write), "row_density")
        rows = _rounds(dense, kind, m_reg, lambda_, epsilon, alpha, rounds)
    return assigned.sparkSession.createDataFrame(
        [(r["k"], r["row_id"], r["density"], r["reg"], r["utility"]) for r in rows],
        "k int, row_id long, density double, reg double, utility double")


def _rounds(dense: DataFrame, kind, m_reg: float, lambda_: float, epsilon: float, alpha: float, rounds: int) -> list:
    """Best row per cluster after all rounds."""
    history: dict[tuple[int, int], tuple[np.ndarray, float]] = {}
    rows = []
    for _ in range(max(rounds, 1)):
        anchors = weights = None
        if history:
            keys = list(history)
            anchors = Anchors(np.array([c for c, _ in keys]), np.array([r for _, r in keys], np.int64),
                              np.stack([history[key][0] for key in keys]))
            weights = np.array([history[key][1] for key in keys])
        rows = _best_per_cluster(dense, kind, anchors, weights, lambda_, alpha, epsilon).collect()
        history = {key: (vec, m_reg * weight) for key, (vec, weight) in history.items()}
        for r in rows:
            vec, weight = history.get((r["k"], r["row_id"]), (np.frombuffer(r["vec"], kind).astype(float), 0.0))
            history[(r["k"], r["row_id"])] = (vec, weight + 1.0 - m_reg)
    return rows


def select_density(points: DataFrame, n_clusters: int, n_init: int = 10, m_reg: float = 0.9, k: int = 10,
                   lambda_: float = 0.5, epsilon: float = 1e-5, alpha: float = 0.75, *, mode: str = "first_member",
                   clustering: str = "lloyd", init="spread", max_iter: int = cluster.MAX_PASSES, tol: float = 1e-4, seed: int = 0,
                   rounds: int = 10, exclude: str = "cluster", block_rows: int = density.BLOCK_ROWS) -> SelectionResult:
    """Cluster the points and pick one dense, well separated row per cluster.

    ``mode="first_member"`` uses one density per cluster, ``"per_point"`` one per row. Clusters without rows give no
    pick.
    """
    if mode not in ("first_member", "per_point"):
        raise ValueError(f"unknown mode {mode}")
    fit = cluster.fit_clusters(points, n_clusters, clustering, init, n_init, max_iter, tol, seed)
    options = dict(k=k, m_reg=m_reg, lambda_=lambda_, epsilon=epsilon, alpha=alpha, rounds=rounds)
    assigned = materialize(cluster.assign_nearest(points, fit.centroids), "assignment")
    if mode == "first_member":
        picks = select_first_member(points, assigned, n_clusters, exclude=exclude, **options)
    else:
        carried = cluster.assign_nearest(points, fit.centroids, keep=("embedding",))
        picks = select_per_point(carried, block_rows=block_rows, **options)
    rank = F.row_number().over(Window.orderBy("k"))  # one row per cluster
    selected = picks.select(F.col("k").alias("cluster"), "row_id", "density", "reg", F.col("utility").alias("score"),
                            rank.alias("rank"))
    return SelectionResult(selected, cluster.nearest_to_center(points, fit.centroids), assigned, fit.centroids)


def select_rows(points: DataFrame, method: str = "density", n_clusters: int | None = None, **options) -> DataFrame:
    """Rows worth labeling, as (row_id, cluster, rank, score). ``method`` is ``density`` or ``heads``."""
    if n_clusters is None:
        raise ValueError("n_clusters is required: it is the number of rows to label")
    if method == "density":
        return select_density(points, n_clusters, **options).selected.select("row_id", "cluster", "rank", "score")
    if method == "heads":
        from labelpick.operators.heads import select_heads

        return select_heads(points, n_clusters, **options)
    raise ValueError(f"unknown method {method}")
