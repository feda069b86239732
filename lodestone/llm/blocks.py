"""Arrow batches as byte blocks for array code inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa


@cache
def frugal() -> None:
    """Has this worker give freed arrays back to the system at once. Workers stay for the stages that follow, beside those of other tasks and what the executor itself holds."""
    pa.set_memory_pool(pa.system_memory_pool())
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, 1 << 20)  # arrays of 1 MB are mapped for themselves, whatever was freed before
        libc.mallopt(-1, 2 << 20)  # free memory at the end of the heap goes back from 2 MB on


def byte_blocks(column: pa.Array, max_bytes: int, max_rows: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) of at most max_bytes or one row each; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1
        end = min(max(end, first + 1), first + max_rows, len(column))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def grams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of each byte n-gram (n up to 8) that lies within a row; ASCII letters count as lower case."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
    m = len(low) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    code = low[:m].copy()
    for k in range(1, n):
        code = (code << np.uint64(8)) | low[k : k + m]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[:m] == row[n - 1 : n - 1 + m]
    return row[:m][inside], code[inside]


def bucket(code: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Multiplicative hash of n-gram codes to ``bits`` bits."""
    return (((code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
