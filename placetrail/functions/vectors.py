"""Vectors in Arrow columns: readable rows, unit length, cross-polytope hashes."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa


def readable_vectors(column: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The readable vectors of a list column as a float64 matrix, and their row numbers.

    Readable: not null, of the given width, all elements finite (so none null) and not all zero.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offset = column.offsets.to_numpy()
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (np.diff(offset) == width))
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    x = values[offset[rows][:, None] + np.arange(width)] if len(rows) else np.zeros((0, width))
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return x[good], rows[good]


def unit(x: np.ndarray) -> np.ndarray:
    """Each row divided by its L2 norm; rows are scaled first, so that no norm overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@functools.lru_cache(maxsize=8)
def rotation(width: int, seed: int) -> np.ndarray:
    """A random rotation in double precision, the same in every process."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))[0]


@functools.lru_cache(maxsize=8)
def _rotations(width: int, count: int, seed: int) -> np.ndarray:
    """``count`` random rotations side by side, the same in every process."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.standard_normal((width, width)))[0] for _ in range(count)], axis=1).astype(np.float32)


def polytope_hashes(x: np.ndarray, tables: int, parts: int, seed: int) -> np.ndarray:
    """Cross-polytope hashes of unit vectors (rows x tables, int64): near vectors often share one.

    A part is the axis, with its sign, that a rotated vector lies nearest to; a hash is ``parts`` of them.
    """
    width = x.shape[1]
    turned = (x.astype(np.float32) @ _rotations(width, tables * parts, seed)).reshape(len(x), tables, parts, width)
    axis = np.abs(turned).argmax(axis=3)
    sign = np.take_along_axis(turned, axis[..., None], axis=3)[..., 0] < 0
    code = (axis * 2 + sign).astype(np.int64)
    out = np.zeros((len(x), tables), np.int64)
    for p in range(parts):
        out = out * (2 * width) + code[:, :, p]
    return out
