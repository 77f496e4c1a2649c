"""Reading Arrow batches a few rows at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows, and bytes beyond a single row, that a worker holds as Python objects at once.
ROWS, BYTES = 256, 4 << 20


def _cuts(column: pa.Array) -> list[int]:
    """Where slices of at most ``ROWS`` rows and about ``BYTES`` bytes begin."""
    n = len(column)
    cuts = list(range(0, n, ROWS))
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        ends = np.cumsum(np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(float)))
        if n and ends[-1] > BYTES:
            cuts, at = [], 0
            while at < n:
                cuts.append(at)
                before = ends[at - 1] if at else 0.0
                at = max(at + 1, min(at + ROWS, int(np.searchsorted(ends, before + BYTES, "right"))))
    return [*cuts, n]


def values(batch: pa.RecordBatch, column: int) -> Iterator:
    """The values of a column, converted a few at a time; what they took is
    given back to the system at the end, so that idle workers stay small."""
    data = batch.column(column)
    cuts = _cuts(data)
    for lo, hi in zip(cuts, cuts[1:]):
        yield from data.slice(lo, hi - lo).to_pylist()
    give_back()


def give_back() -> None:
    """Return freed memory to the system (where its allocator can)."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass
