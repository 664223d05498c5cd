"""Helpers for functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def by_size(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a text column holds at most ``most`` bytes in each piece.

    A row over the limit is a piece of its own, so that Python objects made of a piece take
    memory in proportion to ``most`` or to one text, whatever the batch holds.
    """
    for batch in batches:
        if batch.num_rows < 2 or batch.column(column).nbytes <= most:
            yield batch
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        total = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            base = int(total[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(total, base + most, "right")))
            yield batch.slice(start, end - start)
            start = end
