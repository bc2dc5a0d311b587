"""Arrow batches in pieces of bounded size.

A batch holds thousands of rows, and what is made of its rows while it is worked
on takes several times its bytes, in each Python worker of an executor. Pieces
keep that part small, however large files and batches are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def bounds(columns: list[pa.Array], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `limit` bytes of the columns, one row at least."""
    sizes = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


def in_pieces(batch: pa.RecordBatch, columns: list[str], limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch within `bounds`."""
    for start, stop in bounds([batch.column(c) for c in columns], limit):
        yield batch.slice(start, stop - start)
