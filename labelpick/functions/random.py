"""Random numbers that depend only on (row id, position, draw, seed).

A task that is run again on another executor draws the same numbers. Everything is integer arithmetic below 2^63, so
the column form, the numpy form and plain SQL agree exactly.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647
ID_STEP, HIGH_STEP, POS_STEP, DRAW_STEP = 1103515245, 69621, 7919, 104729
ROUND_FACTOR, ROUND_STEP, ROUNDS = 7, 12345, 3


def uniform(row_id: Column, position, draw: int = 0, seed: int = 0) -> Column:
    """Uniform number in [0, 1) for a bigint row id."""
    row_id = row_id.cast("long")
    position = F.lit(position) if isinstance(position, int) else position
    prime = F.lit(PRIME).cast("long")
    low = F.pmod(row_id, prime)
    high = F.pmod(F.call_function("div", row_id - low, prime), prime)
    x = F.pmod(
        low * F.lit(ID_STEP).cast("long") + high * F.lit(HIGH_STEP).cast("long")
        + position.cast("long") * F.lit(POS_STEP).cast("long") + F.lit(draw * DRAW_STEP + seed).cast("long"),
        prime,
    )
    for _ in range(ROUNDS):
        x = F.pmod(x * (x + F.lit(ROUND_FACTOR)) + F.lit(ROUND_STEP), prime)
    return x / F.lit(float(PRIME))


def uniform_array(row_id: np.ndarray, position: np.ndarray, draw: int = 0, seed: int = 0) -> np.ndarray:
    """The same numbers for a whole batch: shape (rows, positions)."""
    row_id = np.asarray(row_id, np.int64)
    low, high = row_id % PRIME, (row_id // PRIME) % PRIME
    x = (low * ID_STEP + high * HIGH_STEP)[:, None] + np.asarray(position, np.int64)[None, :] * POS_STEP
    x = (x + draw * DRAW_STEP + seed) % PRIME
    for _ in range(ROUNDS):
        x = (x * (x + ROUND_FACTOR) + ROUND_STEP) % PRIME
    return x / float(PRIME)


def normal_array(row_id: np.ndarray, dim: int, draw: int = 0, seed: int = 0) -> np.ndarray:
    """Standard normal numbers by Box-Muller, shape (rows, dim)."""
    u = uniform_array(row_id, np.arange(2 * dim), draw, seed)
    radius = np.sqrt(-2.0 * np.log(np.maximum(u[:, :dim], 1.0 / PRIME)))
    return radius * np.cos(2.0 * math.pi * u[:, dim:])
