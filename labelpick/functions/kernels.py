"""Numpy helpers that run on one Arrow batch inside a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

TILE_VALUES = 1 << 22


def to_matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """List column -> (rows, dim) matrix. Null or ragged vectors are an error, never skipped."""
    if column.null_count:
        raise ValueError("embedding is null")
    if len(column) == 0:
        return np.empty((0, 0), dtype)
    values = column.flatten()
    if values.null_count:
        raise ValueError("embedding has a null entry")
    if not pa.types.is_fixed_size_list(column.type):
        lengths = np.diff(column.offsets.to_numpy(zero_copy_only=False))
        if lengths.min() != lengths.max():
            raise ValueError(f"embedding lengths differ: {lengths.min()} and {lengths.max()}")
    return values.to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


def check_dim(x: np.ndarray, dim: int) -> None:
    if x.shape[0] and x.shape[1] != dim:
        raise ValueError(f"embedding has {x.shape[1]} entries, expected {dim}")


def to_lists(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    offsets = np.arange(0, (rows + 1) * width, width, dtype=np.int32) if width else np.zeros(rows + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.ascontiguousarray(matrix).ravel()))


def ints(column: pa.Array) -> np.ndarray:
    if column.null_count:
        raise ValueError("key column is null")
    return column.to_numpy(zero_copy_only=False)


def squared_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Direct differences: exact zeros and exact ties stay exact."""
    out = np.empty((x.shape[0], centers.shape[0]))
    for k, center in enumerate(centers):
        diff = x - center
        out[:, k] = np.einsum("ij,ij->i", diff, diff)
    return out


def product_distances(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, with a bound on their rounding error per row."""
    xx = np.einsum("ij,ij->i", x, x)
    cc = np.einsum("ij,ij->i", centers, centers)
    approx = x @ centers.T
    approx *= -2.0
    approx += xx[:, None]
    approx += cc[None, :]
    slack = 1e-12 * x.shape[1] * (xx + cc.max(initial=0.0)) + 1e-300
    return approx, slack


def row_tiles(x: np.ndarray, width: int):
    """Rows of a batch in parts whose (rows, width) result stays small."""
    step = max(1, TILE_VALUES // max(width, 1))
    for start in range(0, len(x), step):
        yield x[start:start + step]


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and distance to the nearest center; the lowest index wins ties.

    The matrix product finds the candidates, rows with more than one are settled by exact distances.
    """
    if x.shape[0] == 0:
        return np.empty(0, np.int64), np.empty(0)
    check_dim(x, centers.shape[1])
    parts = [_nearest(part, centers) for part in row_tiles(x, len(centers))]
    return np.concatenate([k for k, _ in parts]), np.concatenate([d for _, d in parts])


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    approx, slack = product_distances(x, centers)
    best = approx.argmin(axis=1)
    low = approx[np.arange(len(x)), best]
    unclear = np.flatnonzero((approx <= (low + 2 * slack)[:, None]).sum(axis=1) > 1)
    if unclear.size:
        best[unclear] = squared_distances(x[unclear], centers).argmin(axis=1)
    diff = x - centers[best]
    return best, np.sqrt(np.einsum("ij,ij->i", diff, diff))


def group_sums(x: np.ndarray, key: np.ndarray, n_keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of rows and row count per key."""
    counts = np.bincount(key, minlength=n_keys).astype(float)
    order = np.argsort(key, kind="stable")
    present = np.flatnonzero(counts)
    starts = np.concatenate([[0], np.cumsum(counts[present])[:-1]]).astype(int)
    sums = np.zeros((n_keys, x.shape[1]))
    if present.size:
        sums[present] = np.add.reduceat(x[order], starts, axis=0)
    return sums, counts


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def log_softmax(z: np.ndarray) -> np.ndarray:
    shifted = z - z.max(axis=-1, keepdims=True)
    return shifted - np.log(np.exp(shifted).sum(axis=-1, keepdims=True))


def sharpen(p: np.ndarray, temperature: float) -> np.ndarray:
    q = p ** (1.0 / temperature)
    return q / q.sum(axis=-1, keepdims=True)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))
