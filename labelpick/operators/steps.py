"""Optimizer steps over batches of a stored table, in another order every epoch, without moving the rows again.

Rows are put in a random order once, by one shuffle into ranges, and stored as they lie. Their places are numbers:
consecutive places make a block, and a block is what a step reads, or several steps read in turn. For every epoch two
permutations of numbers, x -> (a * x + c) mod size, rearrange the blocks and the places inside them, so batches hold other
rows every time. A step reads only the parts of the ranges that its block covers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelpick.functions.kernels import to_lists
from labelpick.functions.random import uniform, uniform_array
from labelpick.operators.batches import SHUFFLE_DRAW
from labelpick.operators.partials import CHUNK
from labelpick.operators.ranks import sorted_ranges
from labelpick.session import materialize, ship

TURN_DRAW = 900_021
BLOCK_BATCHES = 64  # at least; more where one step takes more
BLOCKS, PLACES = 0, 1
RUN_BYTES = 32 << 20  # rows of a run, as arrays of doubles; a larger block is left to steps of their own
RUN_BLOCKS = 16  # most blocks of a run, as each is a condition in its plan


def turn(size: int, epoch: int, what: int, seed: int = 0) -> tuple[int, int]:
    """(a, c) of the permutation x -> (a * x + c) mod size; the first epoch keeps the order."""
    if epoch == 0 or size < 2:
        return 1, 0
    u = uniform_array(np.array([epoch]), np.array([2 * what, 2 * what + 1]), TURN_DRAW, seed)[0]
    factor = 1 + math.floor(u[0] * (size - 1))
    while math.gcd(factor, size) > 1:
        factor += 1
    return factor, math.floor(u[1] * size)


@dataclass
class BatchLayout:
    """``rows`` as stored, with their range ``_part`` and their place in it ``_row``; ``ranges`` are (part, start, n)."""
    rows: DataFrame
    columns: list[str]
    ranges: list[tuple[int, int, int]]
    size: int
    step_batches: int
    seed: int

    @property
    def n_rows(self) -> int:
        return sum(n for _, _, n in self.ranges)

    @property
    def n_batches(self) -> int:
        return -(-self.n_rows // self.size)

    @property
    def block_rows(self) -> int:
        return self.size * self.step_batches * -(-BLOCK_BATCHES // self.step_batches)

    def _places(self, first: int, last: int) -> tuple[Column, Column]:
        """Which rows have places from ``first`` up to ``last``, and their places counted from ``first``."""
        here = [(p, s, n) for p, s, n in self.ranges if s < last and first < s + n]
        wanted, place = F.lit(False), F.lit(None).cast("long")
        for part, start, n in here:
            mine = F.col("_part") == part
            inside = F.col("_row").between(max(first - start, 0), min(last - start, n) - 1)
            wanted = wanted | (mine & inside)
            place = F.when(mine, F.col("_row") + (start - first)).otherwise(place)
        return wanted, place

    def _blocks(self, epoch: int) -> Iterator[tuple[Column, Column, int]]:
        """One block after the other: which rows it has, their places in it in this epoch, and how many there are."""
        total, width = self.n_rows, self.block_rows
        n_blocks = -(-total // width)
        a, c = turn(n_blocks, epoch, BLOCKS, self.seed)
        for number in range(n_blocks):
            block = (a * number + c) % n_blocks
            n = min(width, total - block * width)
            b, d = turn(n, epoch, PLACES, self.seed)
            wanted, place = self._places(block * width, block * width + n)
            yield wanted, F.pmod(place * b + d, F.lit(n)), n

    def steps(self, epoch: int) -> Iterator[DataFrame]:
        """The rows of one step after the other, with ``batch`` (counted from 0 in its step) and ``pos``."""
        step = self.size * self.step_batches
        for wanted, place, n in self._blocks(epoch):
            rows = self.rows.where(wanted).withColumn("place", place)
            for first in range(0, n, step):
                mine = rows if step >= n else rows.where(F.col("place").between(first, first + step - 1))
                at = F.col("place") - first
                yield mine.select(*self.columns, F.floor(at / self.size).cast("int").alias("batch"),
                                  F.pmod(at, F.lit(self.size)).cast("int").alias("pos"))

    def runs(self, epoch: int, most_rows: int) -> Iterator[DataFrame]:
        """The rows of one run of steps after the other, with ``step`` (counted from 0 in the epoch) and ``place`` in
        its block. A run has whole blocks, of ``most_rows`` rows together or one."""
        step, first, held, run = self.size * self.step_batches, 0, 0, []
        for wanted, place, n in self._blocks(epoch):
            if run and (held + n > most_rows or len(run) == RUN_BLOCKS):
                yield self._run(run)
                held, run = 0, []
            run.append((wanted, place, F.floor(place / step) + first))
            held, first = held + n, first + -(-n // step)
        yield self._run(run)

    def _run(self, blocks: list[tuple[Column, Column, Column]]) -> DataFrame:
        of_any, place, number = F.lit(False), F.lit(None).cast("long"), F.lit(None).cast("long")
        for wanted, at, step in blocks:
            of_any, place, number = (of_any | wanted, F.when(wanted, at).otherwise(place),
                                     F.when(wanted, step).otherwise(number))
        return self.rows.where(of_any).select(*self.columns, number.alias("step"), place.alias("place"))


Step = Callable[[list[np.ndarray], list[np.ndarray], int], tuple[list[np.ndarray], float]]


def most_rows_of_run(layout: BatchLayout, row_values: int) -> int:
    """How many rows of so many doubles a run may have; 0 if not even one block fits."""
    most = RUN_BYTES // (8 * max(row_values, 1))
    return most if min(layout.block_rows, layout.n_rows) <= most else 0


def take_steps(layout: BatchLayout, epoch: int, most_rows: int, state: list[np.ndarray],
               read: Callable[[pa.Table], list[np.ndarray]], step: Step) -> tuple[list[np.ndarray], list[float]]:
    """All steps of an epoch in runs: the state after the last one, and the loss of each.

    ``read`` turns rows into arrays; ``step(state, arrays, number)`` gets those of one step and returns the new state, of
    the same shapes, and its loss. A run is one job, whose last task holds the rows of the run and no others.
    """
    losses: list[float] = []
    for rows in layout.runs(epoch, most_rows):
        shared = ship(layout.rows.sparkSession, state, "state of a training")

        def run(batches):
            table = pa.Table.from_batches(list(batches)).sort_by([("step", "ascending"), ("place", "ascending")])
            arrays, numbers = read(table.combine_chunks()), table["step"].to_numpy()
            now, found = shared.value, []
            for a, b in pairwise([0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]):
                now, loss = step(now, [x[a:b] for x in arrays], int(numbers[a]))
                found.append(loss)
            flat = np.concatenate([np.ravel(x) for x in (found, *now)])
            flat = np.pad(flat, (0, -flat.size % CHUNK)).reshape(-1, CHUNK)
            for at in range(0, len(flat), 256):
                part = flat[at:at + 256]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part)), pa.int32()), to_lists(part),
                                                  pa.array([len(found)] * len(part), pa.int32())], ["chunk", "v", "steps"])

        got = rows.repartition(1).mapInArrow(run, "chunk int, v array<double>, steps int").toArrow().sort_by("chunk")
        flat, at = got["v"].combine_chunks().flatten().to_numpy(), got["steps"][0].as_py()
        losses += flat[:at].tolist()
        new = []
        for old in state:
            new.append(flat[at:at + old.size].reshape(old.shape).copy())
            at += old.size
        state = new
        shared.destroy()
    return state, losses


def lay_out(rows: DataFrame, size: int, step_batches: int = 1, seed: int = 0, write=materialize) -> BatchLayout:
    """Deal rows (with a row_id) into batches of ``size``, taken ``step_batches`` at a time."""
    if size < 1 or step_batches < 1:
        raise ValueError("batch_size and batches_per_step must be at least 1")
    keyed = rows.withColumn("_u", uniform(F.col("row_id"), 0, SHUFFLE_DRAW, seed))
    stored = write(sorted_ranges(keyed, "_u", "row_id").drop("_u"), "batch_layout")
    ranges, start = [], 0
    for r in stored.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # one row per range
        ranges.append((r["_part"], start, r["n"]))
        start += r["n"]
    if not ranges:
        raise ValueError("no rows to train on")
    return BatchLayout(stored, rows.columns, ranges, size, step_batches, seed)
