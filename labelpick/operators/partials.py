"""Distributed sums (or minima, maxima) of dense arrays.

Each task folds its Arrow batches into arrays of a fixed shape and emits them in chunks of ``CHUNK`` doubles, so a pass
sends tasks x entries / CHUNK rows. Input partitions are first taken together into eight tasks per core: what a pass sends
then depends on the cluster and on the shapes, not on the number of files. Chunks are merged twice: those of a group of
tasks, then those of all groups. Merging is a shuffle of chunks and an aggregation of their entries behind it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelpick.functions.kernels import to_lists
from labelpick.session import check_model_size

Fold = Callable[[dict[str, np.ndarray], pa.RecordBatch], None]
CHUNK = 1024
TASKS_PER_CORE = 8
_ROWS_PER_BATCH = 256  # chunks
_SCHEMA = "chunk int, team int, v array<double>"

_START = {"sum": 0.0, "min": np.inf, "max": -np.inf}
_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def add_chunks(parts: DataFrame, keys: list[str], how: str) -> DataFrame:
    """(keys, pos, v): chunks are shuffled as they are; their entries are added up where they arrive."""
    return (parts.repartition(*keys).select(*keys, F.posexplode("v").alias("pos", "v"))
            .groupBy(*keys, "pos").agg(_MERGE[how]("v").alias("v")))


def partial_sums(df: DataFrame, shapes: dict[str, tuple[int, ...]], fold: Fold, how: str = "sum") -> DataFrame:
    """(chunk, pos, v): the summed arrays, laid out one after the other in the order of ``shapes`` and cut into chunks."""
    start = _START[how]
    tasks = TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    teams = math.isqrt(tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = {name: np.full(shape, start) for name, shape in shapes.items()}
        for batch in batches:
            if batch.num_rows:
                fold(acc, batch)
        flat = np.concatenate([a.ravel() for a in acc.values()])
        del acc
        flat = np.pad(flat, (0, -flat.size % CHUNK), constant_values=start).reshape(-1, CHUNK)
        used, team = np.flatnonzero((flat != start).any(axis=1)), TaskContext.get().partitionId() % teams
        for at in range(0, used.size, _ROWS_PER_BATCH):
            part = used[at:at + _ROWS_PER_BATCH]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array([team] * len(part), pa.int32()), to_lists(flat[part])],
                ["chunk", "team", "v"])

    parts = df.coalesce(tasks).mapInArrow(run, _SCHEMA)
    if teams > 8:  # up to 64 tasks, one merge adds no more parts than each of two would
        entries = F.array_sort(F.collect_list(F.struct("pos", "v")))
        parts = add_chunks(parts, ["chunk", "team"], how).groupBy("chunk", "team").agg(entries["v"].alias("v"))
    return add_chunks(parts, ["chunk"], how)


def collect_sums(df: DataFrame, shapes: dict[str, tuple[int, ...]], fold: Fold,
                 how: str = "sum") -> dict[str, np.ndarray]:
    """The summed arrays on the driver; their size is fixed by ``shapes`` and checked, not by the data."""
    sizes = {name: int(np.prod(shape)) for name, shape in shapes.items()}
    entries = sum(sizes.values())
    check_model_size(entries, "sum of partial arrays")
    flat = np.full(-(-entries // CHUNK) * CHUNK, _START[how])
    table = partial_sums(df, shapes, fold, how).toArrow()
    flat[table["chunk"].to_numpy().astype(np.int64) * CHUNK + table["pos"].to_numpy()] = table["v"].to_numpy()
    out, start = {}, 0
    for name, size in sizes.items():
        out[name] = flat[start:start + size].reshape(shapes[name])
        start += size
    return out
