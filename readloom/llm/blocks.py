"""Cutting Arrow batches into blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def blocks(column: pa.Array, most_bytes: int = 1_000_000) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a string column with their starts, each of at most ``most_bytes`` or of one value.

    Vectorised code needs some eighty bytes for every letter at once, so its memory follows the letters of a block and
    not the number of records in a batch.
    """
    column = column.cast(pa.large_string())
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        end = int(np.searchsorted(ends, ends[at] + most_bytes, side="right")) - 1
        end = min(max(end, at + 1), len(column))
        yield at, column.slice(at, end - at)
        at = end
