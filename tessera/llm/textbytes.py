"""Vectorised work on the UTF-8 bytes of Arrow string columns.

Words are maximal runs of bytes outside [\\x20\\x09-\\x0D]; those are single bytes in UTF-8, so bytes suffice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about `most` bytes of text each (a longer text stands alone), which bounds the arrays."""
    n = batch.num_rows
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and the n + 1 offsets between them."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def strings(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """The strings between neighbouring offsets into UTF-8 bytes."""
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the number of words before it (n + 1 bounds)."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[n] = True
    gap = np.ones(n + 2, bool)
    gap[1 : n + 1] = SPACE[data]
    starts = np.flatnonzero(~gap[1 : n + 1] & (gap[:n] | edge[:n]))
    ends = np.flatnonzero(~gap[1 : n + 1] & (gap[2 : n + 2] | edge[1 : n + 1])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME ** i and PRIME ** -i modulo 2 ** 64 for i < n; longer runs than asked for are kept."""
    if not _powers or len(_powers[0][0]) < n:
        size = max(n, 1 << 16)
        pair = []
        for base in (PRIME, _INVERSE):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            pair.append(np.multiply.accumulate(row))
        _powers[0] = (pair[0], pair[1])
    return _powers[0][0][:n], _powers[0][1][:n]


def forget() -> None:
    """Let the kept powers go; they take 16 bytes a byte of the longest text."""
    _powers.clear()


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of data[start:end] for each pair, the same wherever the bytes stand."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
