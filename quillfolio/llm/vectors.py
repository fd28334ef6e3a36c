"""Vectors of Arrow list columns as numpy matrices of whole numbers."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Whole numbers are held within this distance of 0.
FAR = 2**62
#: Rows of a batch are taken in slices of about this many components.
_SLICE = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, cut so that a slice's vectors hold about _SLICE components (a longer vector is a slice of its own)."""
    for batch in batches:
        upto, at = np.cumsum(_lengths(batch.column(column)).clip(1)), 0
        while at < len(upto):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _SLICE, "right")))
            yield batch.slice(at, to - at)
            at = to


def _lengths(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def whole(column: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vector that occurs: row numbers, and floor(scale * component) of each component, in doubles, as long integers.

    Left out: null vectors, and those with a null or non-finite component.  A component
    beyond 2**62 is held there.
    """
    lengths = _lengths(column)
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths.clip(0)) - lengths.clip(0)
    for n in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero(lengths == n)
        x = flat[starts[rows][:, None] + np.arange(n)]
        fine = np.isfinite(x).all(1)
        with np.errstate(over="ignore"):
            yield rows[fine], np.clip(np.floor(x[fine] * scale), -float(FAR), float(FAR)).astype(np.int64)


def reach(n: int) -> int:
    """Components below this distance from 0: n products of two, or squares of their differences, add up well within a long integer."""
    return 1 << ((57 - max(n, 1).bit_length()) // 2 - 1)


def exact(x: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """x, as Python's own integers if long integers would overflow in sums of squares of x and the others."""
    most = max(int(np.abs(a).max()) if a.size else 0 for a in (x, *others))
    return x if most < reach(x.shape[-1]) else x.astype(object)
