"""Density of clusters and of single rows."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from labelpick.functions import kernels as K
from labelpick.functions.random import uniform
from labelpick.operators.partials import TASKS_PER_CORE
from labelpick.session import materialize

BLOCK_ROWS = 20_000
TASK_ROWS = 4_096  # rows of a cell, or of those that visit it, that are compared together at least
TILE_ROWS = 256
MAX_PIVOTS = 64
PIVOT_DRAW = 900_031


def nearest_members(assigned: DataFrame, k: int) -> DataFrame:
    """(k, near): the k smallest member distances of every cluster, as an ascending array.

    Every task keeps the k smallest of its own rows per cluster, so no cluster is ever sorted or gathered as a whole. The
    arrays are merged by teams of tasks first: no merging row holds more than k distances of each task of a team.
    """
    tasks = TASKS_PER_CORE * assigned.sparkSession.sparkContext.defaultParallelism
    teams = math.isqrt(tasks)

    def run(batches):
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            cl, d = K.ints(batch.column("k")), batch.column("d").to_numpy(zero_copy_only=False)
            order = np.lexsort((d, cl))
            lead, at = np.unique(cl[order], return_index=True)
            for c, part in zip(lead.tolist(), np.split(d[order], at[1:])):
                both = part[:k] if c not in best else np.sort(np.concatenate([best[c], part[:k]]))[:k]
                best[c] = both
        team = TaskContext.get().partitionId() % teams
        names = list(best)
        for at in range(0, len(names), 64):
            some = names[at:at + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([team] * len(some), pa.int32()),
                 pa.array([best.pop(c).tolist() for c in some], pa.list_(pa.float64()))], ["k", "team", "near"])

    def merged(parts: DataFrame, *keys: str) -> DataFrame:
        every = F.array_sort(F.flatten(F.collect_list("near")))
        return parts.groupBy(*keys).agg(F.slice(every, 1, k).alias("near"))

    parts = assigned.select("k", "d").coalesce(tasks).mapInArrow(run, "k int, team int, near array<double>")
    return merged(merged(parts, "k", "team"), "k")


def cluster_density(assigned: DataFrame, k: int = 10, epsilon: float = 1e-5) -> DataFrame:
    """(k, density): 1 / (mean of the k smallest member distances + epsilon), all members if fewer; any k."""
    if k < 1:
        raise ValueError("k must be at least 1")
    total = F.aggregate("near", F.lit(0.0), lambda a, d: a + d)
    return nearest_members(assigned, k).select("k", (1.0 / (total / F.size("near") + epsilon)).alias("density"))


def pack_vectors(assigned: DataFrame) -> DataFrame:
    """(k, vec, d, row_id, copies): equal vectors of a cluster folded into one row with their smallest row id.

    ``vec`` holds the entries as bytes, which is a cheap grouping key; copies are counted on the map side first.
    """
    wide = assigned.schema["embedding"].dataType.elementType.simpleString() != "float"
    kind = np.float64 if wide else np.float32

    @arrow_udf("binary")
    def pack(vec: pa.Array) -> pa.Array:
        x = np.ascontiguousarray(K.to_matrix(vec, kind) + kind(0.0))  # -0.0 equals 0.0
        return pa.array([row.tobytes() for row in x], pa.binary())

    packed = assigned.select("k", "d", "row_id", pack("embedding").alias("vec"))
    return packed.groupBy("k", "vec").agg(F.min("row_id").alias("row_id"), F.count("*").alias("copies"),
                                          F.min("d").alias("d"))


def unpack(column: pa.Array, kind) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind).reshape(len(column), -1).astype(np.float64)


def _closest(q: np.ndarray, base: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, base row, distance) of at least the k closest base rows of every query, distances computed directly."""
    found = []
    for start in range(0, len(q), TILE_ROWS):
        tile = q[start:start + TILE_ROWS]
        approx, slack = K.product_distances(tile, base)
        reach = min(k, base.shape[0]) - 1
        limit = np.partition(approx, reach, axis=1)[:, reach] + 2 * slack
        rows, cols = np.nonzero(approx <= limit[:, None] + 2 * slack[:, None])
        diff = tile[rows] - base[cols]
        found.append((rows + start, cols, np.sqrt(np.einsum("ij,ij->i", diff, diff))))
    return tuple(np.concatenate(part) for part in zip(*found))


def _top_lists(n_query: int, query: np.ndarray, d: np.ndarray, copies: np.ndarray, k: int) -> list[np.ndarray]:
    """The k smallest distances per query, each repeated by its number of copies."""
    times = np.minimum(copies, k)
    query, d = np.repeat(query, times), np.repeat(d, times)
    order = np.lexsort((d, query))
    query, d = query[order], d[order]
    starts = np.searchsorted(query, np.arange(n_query + 1))
    return [d[starts[i]:min(starts[i + 1], starts[i] + k)] for i in range(n_query)]


@dataclass
class Visit:
    """What one wave did: rows that asked, pairs of rows whose distance was computed, pairs of all rows of the clusters."""
    wave: int
    rows: int
    pairs: int
    all_pairs: int


def _pivots(packed: DataFrame, block_rows: int, write) -> tuple[DataFrame, DataFrame]:
    """(k, n, n_pivots, n_parts) of the clusters and (k, p, vec) of their pivots: rows drawn by a hash of their id.

    A cluster has one pivot per block it fills, MAX_PIVOTS at most. Parts are what a task takes of a cluster.
    """
    blocks, parts = F.ceil(F.col("n") / block_rows), F.ceil(F.col("n") / max(block_rows, TASK_ROWS))
    sizes = write(packed.groupBy("k").agg(F.count("*").alias("n")).select(
        "k", "n", F.least(F.lit(MAX_PIVOTS), blocks).cast("int").alias("n_pivots"), parts.alias("n_parts")), "cluster_sizes")
    drawn = Window.partitionBy("k").orderBy(uniform(F.col("row_id"), 0, PIVOT_DRAW), "row_id")
    few = packed.select("k", "row_id", "vec").withColumn("p", F.row_number().over(drawn)).filter(F.col("p") <= MAX_PIVOTS)
    pivots = few.join(sizes, "k").filter(F.col("p") <= F.col("n_pivots")).select("k", (F.col("p") - 1).alias("p"), "vec")
    return sizes, write(pivots, "pivots")


def _sorted_pivots(table: pa.Table, kind) -> np.ndarray:
    return unpack(table.sort_by("p").column("vec"), kind)


def _cells(packed: DataFrame, sizes: DataFrame, pivots: DataFrame, kind, write) -> DataFrame:
    """(k, cell, row_id, vec, copies, dp): rows with their distances to all pivots of their cluster; the nearest is the cell.

    Rows of a cluster are dealt by hash, so a task sees at most about TASK_ROWS of them, or a block if that is more.
    """
    of = sizes.select("k", "n_parts")
    rows = (packed.select("k", "row_id", "vec", "copies").join(of, "k")
            .withColumn("part", F.pmod(F.xxhash64("vec"), F.col("n_parts"))).drop("n_parts"))
    each = pivots.join(of, "k").select("k", "p", "vec", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1)).alias("part"))

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        if not left.num_rows:
            return pa.table({"k": left.column("k"), "cell": pa.array([], pa.int32()), "row_id": left.column("row_id"),
                             "vec": left.column("vec"), "copies": left.column("copies"),
                             "dp": pa.array([], pa.list_(pa.float64()))})
        d = np.sqrt(K.squared_distances(unpack(left.column("vec"), kind), _sorted_pivots(right, kind)))
        return pa.table({"k": left.column("k"), "cell": pa.array(d.argmin(axis=1).astype(np.int32)),
                         "row_id": left.column("row_id"), "vec": left.column("vec"), "copies": left.column("copies"),
                         "dp": K.to_lists(d)})

    by = ("k", "part")
    return write(rows.groupBy(*by).cogroup(each.groupBy(*by)).applyInArrow(
        place, "k int, cell int, row_id long, vec binary, copies long, dp array<double>"), "cells")


def _atlas(cells: DataFrame, pivots: DataFrame) -> DataFrame:
    """(k, ranges, pivots): for each cell and pivot of a cluster the range of distances, at most MAX_PIVOTS squared."""
    ranges = (cells.select("k", "cell", F.posexplode("dp").alias("p", "d")).groupBy("k", "cell", "p")
              .agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
              .groupBy("k").agg(F.collect_list(F.struct("cell", "p", "lo", "hi")).alias("ranges")))
    return ranges.join(pivots.groupBy("k").agg(F.collect_list(F.struct("p", "vec")).alias("pivots")), "k")


def lower_bounds(dp: np.ndarray, lo: np.ndarray, hi: np.ndarray, between: np.ndarray) -> np.ndarray:
    """(rows, cells): no row of a cell is closer than this. ``between`` are the distances of pivots to each other.

    Triangle inequality along every pivot, and the hyperplanes that part the cell from the cells of other pivots.
    """
    out = np.zeros((len(dp), len(lo)))
    square = dp * dp
    for cell in range(len(lo)):
        along = np.maximum(lo[cell] - dp, dp - hi[cell]).max(axis=1)
        apart = between[cell] > 0
        if apart.any():
            side = (square[:, cell, None] - square[:, apart]) / (2 * between[cell, apart])
            along = np.maximum(along, side.max(axis=1))
        out[:, cell] = along
    # the margin keeps what only fails by rounding
    return np.maximum(out, 0.0) - 1e-9 * (1 + dp.max(axis=1, initial=0.0))[:, None]


def _renewed(df: DataFrame) -> DataFrame:
    """The same columns under identities of their own, for the second side of a cogroup that shares an input."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _own_blocks(blocked: DataFrame, chunks: DataFrame, atlas: DataFrame, kind, k: int, write) -> DataFrame:
    """Rows with the k smallest distances in their own block, and the cells worth a visit, nearest bound first."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        if not left.num_rows:
            return nothing
        x, copies = unpack(left.column("vec"), kind), K.ints(left.column("copies"))
        query, base, d = _closest(x, x, k + 1)
        tops = _top_lists(len(x), query, d, np.where(query == base, copies[base] - 1, copies[base]), k)
        reach = np.array([t[-1] if len(t) == k else np.inf for t in tops])
        found = right.to_pylist()[0]
        points = unpack(pa.array([p["vec"] for p in sorted(found["pivots"], key=lambda p: p["p"])], pa.binary()), kind)
        m = len(points)
        lo, hi = np.full((m, m), np.inf), np.full((m, m), -np.inf)
        for r in found["ranges"]:
            lo[r["cell"], r["p"]], hi[r["cell"], r["p"]] = r["lo"], r["hi"]
        bound = lower_bounds(K.to_matrix(left.column("dp").combine_chunks()), lo, hi, np.sqrt(K.squared_distances(points, points)))
        bound[:, np.isinf(lo[:, 0])] = np.inf  # cells without rows
        if found["chunks"] == 1:
            bound[:, left.column("cell")[0].as_py()] = np.inf  # seen already
        order = np.argsort(bound, axis=1, kind="stable")
        cells, bounds = [], []
        for row, at, limit in zip(bound, order, reach):
            at = at[(row[at] <= limit) & np.isfinite(row[at])]
            cells.append(at.astype(np.int32).tolist())
            bounds.append(row[at].tolist())
        out = left.select(["k", "cell", "chunk", "row_id", "vec"])
        for name, values in (("top", [t.tolist() for t in tops]), ("bounds", bounds)):
            out = out.append_column(name, pa.array(values, pa.list_(pa.float64())))
        return out.append_column("cells", pa.array(cells, pa.list_(pa.int32())))

    by = ("k", "cell", "chunk")
    nothing = pa.schema([("k", pa.int32()), ("cell", pa.int32()), ("chunk", pa.int64()), ("row_id", pa.int64()),
                         ("vec", pa.binary()), ("top", pa.list_(pa.float64())), ("bounds", pa.list_(pa.float64())),
                         ("cells", pa.list_(pa.int32()))]).empty_table()
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    each = _renewed(chunks.select("k", "cell", "chunks", numbers.alias("chunk")).join(atlas, "k"))
    found = blocked.groupBy(*by).cogroup(each.groupBy(*by)).applyInArrow(search, _STATE)
    return write(_marked(found, k), "own_block")


_STATE = "k int, cell int, chunk long, row_id long, vec binary, top array<double>, bounds array<double>, cells array<int>"


def _marked(state: DataFrame, k: int) -> DataFrame:
    """Add ``reach``, beyond which a row needs no more neighbors, and ``open``: whether some cell is within it."""
    reach = F.when(F.size("top") >= k, F.element_at("top", k)).otherwise(F.lit(float("inf")))
    return state.withColumn("reach", reach).withColumn(
        "open", F.coalesce(F.get("bounds", F.lit(0)) <= F.col("reach"), F.lit(False)))


def _wave(state: DataFrame, blocked: DataFrame, chunks: DataFrame, kind, k: int, step: int, task_rows: int,
          write) -> tuple[DataFrame, DataFrame]:
    """Open rows visit their next ``step`` cells: the new state of those rows, and (k, t_cell, rows) that were asked."""
    open_rows = state.where("open")
    nearest = F.explode(F.slice(F.arrays_zip(F.col("cells").alias("t_cell"), F.col("bounds").alias("bound")), 1, step))
    ask = (open_rows.select("k", "cell", "chunk", "row_id", "vec", "reach", nearest.alias("v"))
           .where(F.col("v.bound") <= F.col("reach")).select("k", F.col("v.t_cell").alias("t_cell"), "cell", "chunk", "row_id", "vec"))
    asked = write(ask.groupBy("k", "t_cell").agg(F.count("*").alias("rows")), "asked")
    target = chunks.select("k", F.col("cell").alias("t_cell"), "chunks")
    teams = F.ceil(F.col("rows") / task_rows)
    visits = write(asked.join(target, ["k", "t_cell"]).select("k", "t_cell", "chunks", teams.alias("teams")), "visits")
    pair = ["k", "t_cell", "t_chunk", "team"]
    first = F.lit(0).cast("long")
    asking = (ask.join(visits, ["k", "t_cell"]).withColumn("t_chunk", F.explode(F.sequence(first, F.col("chunks") - 1)))
              .where((F.col("cell") != F.col("t_cell")) | (F.col("chunk") != F.col("t_chunk")))
              .withColumn("team", F.pmod(F.xxhash64("row_id"), F.col("teams"))).select(*pair, "row_id", "vec"))
    answering = (blocked.select("k", F.col("cell").alias("t_cell"), F.col("chunk").alias("t_chunk"), "vec", "copies")
                 .join(visits.select("k", "t_cell", "teams"), ["k", "t_cell"])
                 .withColumn("team", F.explode(F.sequence(first, F.col("teams") - 1))).select(*pair, "vec", "copies"))

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"row_id": pa.array([], pa.int64()), "near": pa.array([], pa.list_(pa.float64()))})
        q, base = unpack(left.column("vec"), kind), unpack(right.column("vec"), kind)
        query, at, d = _closest(q, base, k)
        tops = _top_lists(len(q), query, d, K.ints(right.column("copies"))[at], k)
        return pa.table({"row_id": left.column("row_id"),
                         "near": pa.array([t.tolist() for t in tops], pa.list_(pa.float64()))})

    near = asking.groupBy(*pair).cogroup(_renewed(answering).groupBy(*pair)).applyInArrow(visit, "row_id long, near array<double>")
    more = near.groupBy("row_id").agg(F.flatten(F.collect_list("near")).alias("more"))
    both = F.concat("top", F.coalesce("more", F.array().cast("array<double>")))
    moved = open_rows.join(more, "row_id", "left").select(
        "k", "cell", "chunk", "row_id", "vec", F.slice(F.array_sort(both), 1, k).alias("top"),
        F.slice("bounds", step + 1, MAX_PIVOTS).alias("bounds"), F.slice("cells", step + 1, MAX_PIVOTS).alias("cells"))
    return write(_marked(moved, k), "wave"), asked


def row_density(assigned: DataFrame, k: int = 10, epsilon: float = 1e-5, block_rows: int = BLOCK_ROWS,
                write=materialize, report: list[Visit] | None = None) -> DataFrame:
    """(k, row_id, vec, density) per distinct vector: 1 / (mean distance to its k nearest co-members + epsilon).

    ``assigned`` holds row_id, k, d, embedding. Exact, without comparing all pairs of a cluster: rows belong to the cell
    of the nearest of several pivots. A row first searches its own block, which bounds its k-th distance. Then it visits
    other cells in waves, those with the smallest lower bound first, in steps that double; a row leaves as soon as its
    k-th distance is below the next bound. ``block_rows`` sets the number of pivots, one per so many rows. What is compared
    together does not get smaller with it: a task holds two parts of about TASK_ROWS rows, or of ``block_rows`` if that is
    more, whatever the size of a cluster or a cell, so an asking row is sent once per cell and not once per block. A wave
    hands on at most k distances per row. Copies of a vector are counted with their
    multiplicity. ``report`` receives one ``Visit`` per wave.
    """
    wide = assigned.schema["embedding"].dataType.elementType.simpleString() != "float"
    kind = np.float64 if wide else np.float32
    task_rows = max(block_rows, TASK_ROWS)
    packed = write(pack_vectors(assigned), "members")
    sizes, pivots = _pivots(packed, block_rows, write)
    cells = _cells(packed, sizes, pivots, kind, write)
    chunks = write(cells.groupBy("k", "cell").agg(F.count("*").alias("n")).select(
        "k", "cell", "n", F.ceil(F.col("n") / task_rows).alias("chunks")), "cell_sizes")
    blocked = cells.join(chunks.select("k", "cell", "chunks"), ["k", "cell"]).withColumn(
        "chunk", F.pmod(F.xxhash64("vec", F.lit(1)), F.col("chunks")))
    state = _own_blocks(blocked, chunks, write(_atlas(cells, pivots), "atlas"), kind, k, write)
    done, step, wave = [state.where("not open")], 1, 0
    if report is not None:
        total = int(sizes.agg(F.sum(F.col("n") * (F.col("n") - 1))).first()[0] or 0)
        own = blocked.groupBy("k", "cell", "chunk").agg(F.count("*").alias("n")).agg(
            F.sum("n").alias("rows"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs")).first()
        report.append(Visit(0, int(own["rows"] or 0), int(own["pairs"] or 0), total))
    while not state.where("open").isEmpty():
        wave += 1
        state, asked = _wave(state, blocked, chunks, kind, k, step, task_rows, write)
        done.append(state.where("not open"))
        if report is not None:
            seen = asked.join(chunks.withColumnRenamed("cell", "t_cell"), ["k", "t_cell"]).agg(
                F.sum("rows").alias("rows"), F.sum(F.col("rows") * F.col("n")).alias("pairs")).first()
            report.append(Visit(wave, int(seen["rows"]), int(seen["pairs"]), total))
        step *= 2
    found = reduce(DataFrame.unionByName, done)
    mean = F.when(F.size("top") > 0, F.aggregate("top", F.lit(0.0), lambda a, d: a + d) / F.size("top")).otherwise(0.0)
    return found.select("k", "row_id", "vec", (1.0 / (mean + epsilon)).alias("density"))
