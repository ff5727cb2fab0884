"""Small helpers for Arrow batches inside tasks: UTF-8 buffers as NumPy arrays, bounded slices, result batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    large = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary())
    if large.null_count:
        large = pc.fill_null(large, "" if pa.types.is_large_string(large.type) else b"")
    _, offsets, data = large.buffers()
    at = np.frombuffer(offsets, np.int64)[large.offset : large.offset + len(large) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer row is a range of its own."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, min(to, rows)
        at = to


def splits(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most ``limit`` bytes of one text column."""
    for batch in batches:
        _, offsets = utf8(batch.column(column))
        for a, b in row_slices(offsets, limit):
            yield batch.slice(a, b - a)


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from one byte array and row offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (the published splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
