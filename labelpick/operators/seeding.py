"""Spread-out starting centers, by parallel oversampling and a weighted reduction of the candidates.

A first row is drawn for each start. Then, in a few rounds, every row is drawn with a probability proportional to its
squared distance to the candidates so far, ``oversampling * n`` rows in the mean. Last, candidates are weighted by the
rows nearest to them, and ``n`` of them are drawn one by one, again by weighted squared distance.

A round is one pass: rows never shuffle and keep no state. A task knows only its own part of the total cost, which is a
lower bound, so it returns a few rows too many, with the numbers they were drawn by; the total then decides. All starts
advance in the same pass. Draws are functions of the row id, so a repeated task draws the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelpick.functions import kernels as K
from labelpick.functions.random import PRIME, uniform, uniform_array
from labelpick.operators.partials import TASKS_PER_CORE, collect_sums
from labelpick.session import check_model_size, materialize, ship
from labelpick.sources.tables import dimension

FIRST_DRAW, ROUND_DRAW, PICK_DRAW = 900_011, 900_012, 900_013
ROUNDS, OVERSAMPLING = 3, 2.0
ROUND_STEP = 100_000  # between the draw positions of two starts; more rounds than that never happen
_SCHEMA = "start int, cost double, row_id long, t double, embedding array<double>"


@dataclass
class _Candidates:
    """Distinct vectors in the order they were drawn: by round, then by row id."""
    ids: list[int] = field(default_factory=list)
    vectors: list[np.ndarray] = field(default_factory=list)
    seen: set[bytes] = field(default_factory=set)

    def add(self, rows: list[tuple[int, np.ndarray]]) -> None:
        for row_id, vector in sorted(rows, key=lambda r: r[0]):
            key = (vector + 0.0).tobytes()  # -0.0 equals 0.0
            if key not in self.seen:
                self.seen.add(key)
                self.ids.append(row_id)
                self.vectors.append(vector)


def _vector(values, row_id) -> np.ndarray:
    if values is None or None in values:
        raise ValueError(f"embedding of row {row_id} is null or has a null entry")
    return np.array(values, float)


def _first(rows: DataFrame, n: int, restarts: int, seed: int) -> list[_Candidates]:
    """One row for each start: that with the smallest uniform number."""
    draws = [F.min_by(F.struct("row_id", "embedding"), F.struct(uniform(F.col("row_id"), s, FIRST_DRAW, seed), "row_id"))
             .alias(f"c{s}") for s in range(restarts)]
    got = rows.agg(F.count("*").alias("n"), *draws).first()
    if got["n"] < n:
        raise ValueError(f"n_clusters asks for {n} centers but there are only {got['n']} rows")
    starts = [_Candidates() for _ in range(restarts)]
    for s, start in enumerate(starts):
        start.add([(got[f"c{s}"]["row_id"], _vector(got[f"c{s}"]["embedding"], got[f"c{s}"]["row_id"]))])
    return starts


def _round(rows: DataFrame, starts: dict[int, _Candidates], number: int, wanted: float, seed: int) -> dict[int, float]:
    """Add the rows drawn in one round to the candidates of the given starts; returns their costs before.

    A row is drawn if u < wanted * d^2 / cost, that is if t = u / d^2 is below wanted / cost. The row with the smallest t
    is always drawn, so each round makes progress while there is any cost.
    """
    spark = rows.sparkSession
    shared = ship(spark, [np.stack(c.vectors) for c in starts.values()], "candidates")
    numbers = np.array(list(starts), np.int64)

    def run(batches):
        centers = shared.value
        cost = np.zeros(len(centers))
        held = [(np.empty(0), np.empty(0, np.int64), None) for _ in centers]
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = K.to_matrix(batch.column("embedding")), K.ints(batch.column("row_id"))
            u = uniform_array(ids, numbers * ROUND_STEP + number, ROUND_DRAW, seed)
            for s, c in enumerate(centers):
                d2 = K.nearest(x, c)[1] ** 2
                cost[s] += d2.sum()
                t = np.divide(u[:, s], d2, out=np.full(len(d2), np.inf), where=d2 > 0)
                old_t, old_ids, old_x = held[s]
                t, all_ids = np.concatenate([old_t, t]), np.concatenate([old_ids, ids])
                keep = np.flatnonzero(t < (wanted / cost[s] if cost[s] else 0.0))
                if len(t) and np.isfinite(t.min()):
                    keep = np.union1d(keep, np.flatnonzero(t == t.min()))
                both = x if old_x is None else np.concatenate([old_x, x])
                held[s] = (t[keep], all_ids[keep], both[keep])
        for s, (t, ids, x) in enumerate(held):
            start = int(numbers[s])
            yield pa.RecordBatch.from_arrays(
                [pa.array([start], pa.int32()), pa.array([cost[s]]), pa.array([None], pa.int64()),
                 pa.array([None], pa.float64()), pa.array([None], pa.list_(pa.float64()))],
                ["start", "cost", "row_id", "t", "embedding"])
            if len(t):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(t), start, np.int32)), pa.array(np.zeros(len(t))), pa.array(ids), pa.array(t),
                     K.to_lists(x)], ["start", "cost", "row_id", "t", "embedding"])

    few = rows.coalesce(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    found = materialize(few.mapInArrow(run, _SCHEMA), "drawn")
    totals = {r["start"]: r for r in found.groupBy("start").agg(F.sum("cost").alias("cost"), F.min("t").alias("least")).collect()}
    limits = [(s, wanted / r["cost"] if r["cost"] else 0.0, r["least"]) for s, r in totals.items()]
    bound = spark.createDataFrame(limits, "start int, bound double, least double")  # one row per start
    drawn = (found.where("row_id is not null").join(F.broadcast(bound), "start").where("t < bound or t = least")
             .select("start", "row_id", "embedding").collect())  # about ``wanted`` rows per start
    shared.destroy()
    for s, start in starts.items():
        start.add([(r["row_id"], np.array(r["embedding"])) for r in drawn if r["start"] == s])
    return {s: r["cost"] for s, r in totals.items()}


def _weights(rows: DataFrame, starts: list[_Candidates]) -> list[np.ndarray]:
    """How many rows are nearest to each candidate."""
    width = max(len(s.ids) for s in starts)
    shared = ship(rows.sparkSession, [np.stack(s.vectors) for s in starts], "candidates")

    def fold(acc, batch):
        x = K.to_matrix(batch.column(0))
        for s, c in enumerate(shared.value):
            acc["n"][s] += np.bincount(K.nearest(x, c)[0], minlength=width)

    counts = collect_sums(rows.select("embedding"), {"n": (len(starts), width)}, fold)["n"]
    shared.destroy()
    return [counts[s, :len(start.ids)] for s, start in enumerate(starts)]


def _pick(start: _Candidates, weights: np.ndarray, n: int, first: int, seed: int) -> list[int]:
    """Candidate numbers drawn one by one: a race in which the rate is weight x squared distance to those drawn before."""
    ids, x = np.array(start.ids, np.int64), np.stack(start.vectors)
    clock = -np.log(np.maximum(uniform_array(ids, first + np.arange(n), PICK_DRAW, seed), 1.0 / PRIME))
    rate, nearest, out = weights.astype(float), np.full(len(ids), np.inf), []
    for j in range(min(n, len(ids))):
        with np.errstate(divide="ignore"):
            time = np.where(rate > 0, clock[:, j] / rate, np.inf)
        best = np.flatnonzero(time == time.min())
        out.append(int(best[ids[best].argmin()]))
        nearest = np.minimum(nearest, ((x - x[out[-1]]) ** 2).sum(axis=1))
        rate = weights * nearest
    return out


def seed_parallel(points: DataFrame, n: int, restarts: int = 1, rounds: int = ROUNDS,
                  oversampling: float = OVERSAMPLING, seed: int = 0) -> np.ndarray:
    """(restarts, n, dim) starting centers, all of them rows of the table.

    Takes ``rounds`` + 2 passes; more only if the rounds leave fewer than ``n`` candidates. Where the table has fewer
    than ``n`` distinct vectors, copies fill the rest.
    """
    if n < 1 or restarts < 1 or rounds < 0 or oversampling <= 0:
        raise ValueError("n_clusters, restarts and oversampling must be positive, rounds not negative")
    rows = points.select("row_id", "embedding")
    check_model_size(int(restarts * n * (1 + rounds * oversampling)) * dimension(rows), "candidates for centers")
    starts = _first(rows, n, restarts, seed)
    number = 0
    growing = dict(enumerate(starts)) if rounds > 0 or n > 1 else {}
    while growing:
        costs = _round(rows, growing, number, oversampling * n, seed)
        number += 1
        growing = {s: c for s, c in growing.items() if costs[s] > 0 and (number < rounds or len(c.ids) < n)}
    weights, out = _weights(rows, starts), []
    for s, start in enumerate(starts):
        chosen = _pick(start, weights[s], n, s * n, seed)
        vectors = [start.vectors[i] for i in chosen]
        if len(chosen) < n:
            taken = rows.sparkSession.createDataFrame([(start.ids[i],) for i in chosen], "row_id long")
            rest = rows.join(taken, "row_id", "left_anti").orderBy(uniform(F.col("row_id"), s, FIRST_DRAW, seed), "row_id")
            vectors += [np.array(r["embedding"], float) for r in rest.limit(n - len(chosen)).collect()]
        out.append(np.stack(vectors))
    return np.stack(out)
