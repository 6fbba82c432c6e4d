"""Small helpers for functions that work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute

CHUNK_BYTES = 4_000_000


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose `column` holds about `limit` bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = [n or 0 for n in pa.compute.binary_length(batch.column(column)).to_pylist()]
        start = total = 0
        for row, size in enumerate(sizes):
            if row > start and total + size > limit:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += size
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """Strings of a column, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def raw(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a column, null as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.large_binary()).to_pylist()]
