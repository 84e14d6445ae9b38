"""Arrow batches in parts of bounded text, so that a worker's memory doesn't grow with a batch's rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a worker takes apart at a time; a longer text is a part of its own.
PART_BYTES = 1 << 20


def parts(batch: pa.RecordBatch, column: str, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch``, not copied, whose texts in ``column`` are about ``most`` bytes together."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1).tolist(), len(sizes)]
    for start, stop in zip(cuts, cuts[1:]):
        if start < stop:
            yield batch.slice(start, stop - start)
