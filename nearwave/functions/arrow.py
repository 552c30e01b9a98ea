"""Arrow list columns as flat numpy arrays (used inside ``mapInArrow`` kernels)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def flat_lists(column: pa.Array, dtype=np.float64) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column; list ``i`` is ``flat[offs[i]:offs[i + 1]]``."""
    offsets = np.asarray(column.offsets, dtype=np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat, offsets - offsets[0]


def list_column(flat: np.ndarray | pa.Array, offsets: np.ndarray) -> pa.Array:
    values = flat if isinstance(flat, pa.Array) else pa.array(flat)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def row_of_value(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def at_positions(flat: np.ndarray, offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Matrix (position, row) of the wanted positions; NaN where a row is too short."""
    rows = len(offsets) - 1
    lengths = np.diff(offsets)
    if rows and lengths.min() == lengths.max() and lengths[0] > positions.max():
        return np.ascontiguousarray(flat.reshape(rows, lengths[0])[:, positions].T)
    index = offsets[:-1][None, :] + positions[:, None]
    inside = index < offsets[1:][None, :]
    out = np.full(index.shape, np.nan)
    out[inside] = flat[index[inside]]
    return out
