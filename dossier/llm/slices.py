"""Texts of Arrow batches as Python strings, a bounded part of a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_slices(texts: pa.Array, most_bytes: int) -> Iterator[list[str]]:
    """Runs of whole texts of about most_bytes in all, null ones as empty; a longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        below = int(ends[at - 1]) if at else 0
        to = min(int(np.searchsorted(ends, below + most_bytes)) + 1, len(texts))
        yield [t or "" for t in texts.slice(at, to - at).to_pylist()]
        at = to


def release() -> None:
    """Gives memory that Arrow holds for later batches back to the system."""
    pa.default_memory_pool().release_unused()
