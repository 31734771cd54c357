"""Arrow batches in pieces of bounded bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401


def slices(batch: pa.RecordBatch, size: int, column: int = 2) -> Iterator[tuple[pa.RecordBatch, int]]:
    """The batch in pieces of about so many bytes of a column of texts, with what they hold."""
    n = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    piece, begun = np.cumsum(n) // size, 0
    for end in [*(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]:
        if end > begun:
            yield batch.slice(begun, end - begun), int(n[begun:end].sum())
        begun = end
