"""Exact top-k inner products through a pivot-distance index.

Every vector is keyed by its nearest pivot and the distance to it. Sorted by that key, vectors are cut into annuli: at
most ANNULUS vectors of one pivot with distances in [low, high]. For a query at distance d from the pivot, the triangle
inequality keeps every vector of an annulus at least gap = max(0, d - high, low - d) away, so with the largest norm M in
it no inner product exceeds (|q|^2 + M^2 - gap^2) / 2, nor |q| M, nor q.pivot + |q| high.

A query first sees the annuli of its own pivot, which gives it a k-th score to beat. Then annuli are visited in the
order of their bounds, and a query stops at those whose bound is below its k-th score so far. Nothing is approximated;
the pivots come from a bounded sample and only decide how much is skipped.

Queries are shipped in tiles of bounded size, annuli stay where they are stored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelpick.llm.common import materialize

PIVOTS, PIVOT_SAMPLE = 64, 4096
ANNULUS = 1024
QUERY_BYTES = 32 << 20


def scaled(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> tuple[DataFrame, int]:
    """(vec_id, v): floor(scale * x) of vectors that take part, and the longest length."""
    x = F.col(vec_col).cast("array<double>")
    usable = F.col(vec_col).isNotNull() & F.forall(
        vec_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias(vec_col)).where(
        F.col("vec_id").isNotNull() & usable).select("vec_id", F.transform(x, lambda c: F.floor(c * scale)).alias("v"))
    return rows, rows.agg(F.max(F.size("v"))).first()[0] or 0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    out = np.zeros((len(column), dim), np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(flat):
        row = np.repeat(np.arange(len(column)), sizes)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[row, at] = flat
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of a with all rows of b."""
    if not (a.size and b.size):
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T if most < 2 ** 63 else a.astype(object) @ b.astype(object).T


def choose_pivots(rows: DataFrame, dim: int, pivots: int, sample: int, rounds: int = 5) -> np.ndarray:
    """A few rounds of Lloyd on the first ``sample`` rows by a hash of their id."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
    x = np.zeros((len(some), dim))
    for i, r in enumerate(some):
        x[i, :len(r.v)] = r.v
    centers = np.unique(x, axis=0)
    centers = centers[:: max(1, len(centers) // pivots)][:pivots]
    for _ in range(rounds if len(centers) else 0):
        near = distances(x, centers).argmin(1)
        for p in range(len(centers)):
            if (near == p).any():
                centers[p] = x[near == p].mean(0)
    return centers if len(centers) else np.zeros((1, dim))


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    d = (x ** 2).sum(1)[:, None] - 2 * x @ centers.T + (centers ** 2).sum(1)
    return np.sqrt(np.maximum(d, 0))


def build_index(rows: DataFrame, dim: int, centers: np.ndarray) -> DataFrame:
    """Store annuli: (pivot, low, high, norm, ids, vectors), ids ascending."""
    shipped = rows.sparkSession.sparkContext.broadcast(centers)

    def key(batches):
        for batch in batches:
            x = matrix(batch.column("v"), dim).astype(np.float64)
            d = distances(x, shipped.value)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(near.astype(np.int32)),
                 pa.array(d[np.arange(len(x)), near])], ["vec_id", "v", "pivot", "distance"])

    keyed = rows.mapInArrow(key, "vec_id long, v array<long>, pivot int, distance double")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    laid = keyed.repartitionByRange(parts, "pivot", "distance", "vec_id").sortWithinPartitions(
        "pivot", "distance", "vec_id")

    def cut(batches):
        held: list[tuple] = []

        def annulus():
            held.sort(key=lambda row: row[0])
            ids, v, pivot, d = zip(*held)
            x = np.zeros((len(v), dim), np.int64)
            for i, row in enumerate(v):
                x[i, :len(row)] = row
            norm = float(np.sqrt((x.astype(np.float64) ** 2).sum(1)).max())
            return pa.RecordBatch.from_arrays(
                [pa.array([pivot[0]], pa.int32()), pa.array([min(d)]), pa.array([max(d)]), pa.array([norm]),
                 pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())],
                ["pivot", "low", "high", "norm", "ids", "vectors"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "v", "pivot", "distance"))):
                if held and (row[2] != held[0][2] or len(held) == ANNULUS):
                    yield annulus()
                    held = []
                held.append(row)
        if held:
            yield annulus()

    return materialize(laid.mapInArrow(cut, "pivot int, low double, high double, norm double, ids binary, vectors binary"),
                       "annuli")


class Search:
    """State of a task's search for one tile of queries."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int, centers: np.ndarray):
        self.ids, self.q, self.k, self.centers = ids, q, k, centers
        x = q.astype(np.float64)
        self.far, self.dot, self.norm = distances(x, centers), x @ centers.T, np.sqrt((x ** 2).sum(1))
        self.home = self.far.argmin(1)
        self.least = least.copy()  # k-th score so far; -inf if there are fewer
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]

    def bound(self, a: dict) -> np.ndarray:
        d = self.far[:, a["pivot"]]
        gap = np.maximum(0, np.maximum(d - a["high"], a["low"] - d))
        most = np.minimum((self.norm ** 2 + a["norm"] ** 2 - gap ** 2) / 2, self.norm * a["norm"])
        most = np.minimum(most, self.dot[:, a["pivot"]] + self.norm * a["high"])
        return most + 1e-6 * (1 + np.abs(most) + self.norm ** 2 + a["norm"] ** 2)  # for rounding

    def visit(self, a: dict, some: np.ndarray) -> None:
        ids = np.frombuffer(a["ids"], np.int64)
        vectors = np.frombuffer(a["vectors"], np.int64).reshape(len(ids), -1)
        for start in range(0, len(some), 512):
            rows = some[start:start + 512]
            scores = inner(self.q[rows], vectors)
            for r, line in zip(rows.tolist(), scores):
                line_ok = np.flatnonzero((line >= self.least[r]) & (ids != self.ids[r]))
                if not len(line_ok):
                    continue
                # ids ascend, so a stable order by score puts smaller ids first among ties
                best = line_ok[np.argsort(-line[line_ok], kind="stable")[:self.k]]
                mine = self.found[r] + list(zip((-line[best]).tolist(), ids[best].tolist()))
                mine.sort()
                self.found[r] = mine[:self.k]
                if len(self.found[r]) == self.k:
                    self.least[r] = max(self.least[r], -self.found[r][-1][0])


ANSWER = "query long, score long, vec_id long"


def _wave(index: DataFrame, tile, least, k: int, centers, own: bool) -> DataFrame:
    """Best candidates of each task: of the queries' own pivots, or of all other annuli that can hold any."""

    def search(batches):
        number, ids, q = tile.value
        state = Search(ids, q, least.value, k, centers.value)
        for batch in batches:
            annuli = batch.to_pylist()
            bounds = [state.bound(a) for a in annuli]
            for at in sorted(range(len(annuli)), key=lambda i: -float((bounds[i] - state.norm ** 2).max())):
                a = annuli[at]
                here = state.home == a["pivot"]
                some = np.flatnonzero((here if own else ~here) & (bounds[at] >= state.least))
                if len(some):
                    state.visit(a, some)
        rows = [(int(number[i]), -s, v) for i, found in enumerate(state.found) for s, v in found]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "score", "vec_id"])

    return index.mapInArrow(search, ANSWER)


def _best(rows: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id",
          vec_col: str = "embedding", pivots: int = PIVOTS, pivot_sample: int = PIVOT_SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best candidates of every row whose id is divisible by ``every``.

    Components are floor(scale * x). Vectors that are null or hold null or non-finite components, and rows without id,
    take no part. A query's candidates are all rows with another id; all are returned if there are fewer than k. Ties go
    to smaller ids. Of vectors of different lengths the shorter count as filled up with zeros. Rows that repeat an id are
    candidates, and queries, each on its own. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows, dim = scaled(vectors, id_col, vec_col, scale)
    rows = materialize(rows, "scaled")
    centers_ = choose_pivots(rows, dim, pivots, pivot_sample)
    index = build_index(rows, dim, centers_)
    centers = spark.sparkContext.broadcast(centers_)

    def number(batches):
        task, n = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(task + n, task + n + batch.num_rows)), *batch.columns], ["query", *batch.schema.names])
            n += batch.num_rows

    asked = materialize(rows.where(F.pmod("vec_id", F.lit(every)) == 0)
                        .mapInArrow(number, "query long, vec_id long, v array<long>"), "queries")
    tiles = max(-(-asked.count() * (max(dim, 1) * 8 + 64) // QUERY_BYTES), 1)
    done = None
    for t in range(tiles):
        part = asked.where(F.pmod(F.xxhash64("query"), F.lit(tiles)) == t).collect()  # about QUERY_BYTES
        part.sort(key=lambda r: r["query"])
        q = np.zeros((len(part), dim), np.int64)
        for i, r in enumerate(part):
            q[i, :len(r.v)] = r.v
        numbers, ids = np.array([r["query"] for r in part], np.int64), np.array([r.vec_id for r in part], np.int64)
        tile = spark.sparkContext.broadcast((numbers, ids, q))
        least = np.full(len(part), -np.inf)
        near = materialize(_best(_wave(index, tile, spark.sparkContext.broadcast(least), k, centers, True), k)
                           .select("query", "score", "vec_id", "rank"), "near")
        place = {n: i for i, n in enumerate(numbers.tolist())}
        for r in near.where(F.col("rank") == k).select("query", "score").collect():
            least[place[r["query"]]] = r.score
        rest = _wave(index, tile, spark.sparkContext.broadcast(least), k, centers, False)
        best = _best(near.drop("rank").unionAll(rest), k)
        best = materialize(best, "best") if tiles > 1 else best
        done = best if done is None else done.unionAll(best)
    return done.join(asked.select("query", F.col("vec_id").alias("query_id")), "query").select(
        "query_id", "rank", "vec_id", "score")
