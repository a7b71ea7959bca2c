"""Vectorised text kernels on Arrow buffers: word runs, 64-bit hashes, sliding minima.

Everything here works on the UTF-8 bytes of whole texts, a bounded slice of rows at a time, so the memory of
a Python worker depends on the longest text and not on the number of rows.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240501).integers(1, 2**63 - 1, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE_LOWER = _TABLE[_LOWER]

#: Byte classes: every byte of a multi-byte character belongs to a word in both.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64, kept between calls."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _BASE_INV)):
            out = np.full(size, U64(base))
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives back what it no longer needs: workers wait for their next task and count in an executor's memory."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _powers[:] = [np.ones(1, U64), np.ones(1, U64)]
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
            trim(0)

    return freed


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix_hash(buf: np.ndarray, lower: bool = False) -> np.ndarray:
    """Prefix sums from which the hash of any byte range follows in constant time."""
    out = np.zeros(len(buf) + 1, U64)
    if len(buf):
        np.cumsum((_TABLE_LOWER if lower else _TABLE)[buf] * powers(len(buf))[0], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inv = powers(len(prefix))[1]
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its offsets; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, offs


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows with at most `limit` bytes, or one row."""
    if not len(column):
        return
    buf, offs = column_bytes(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        yield row, end, buf[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def words(buf: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes of a class, and for each row the index of its first run (one more at the end)."""
    inside = kind[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    start, end = inside.copy(), inside.copy()
    if len(buf):
        start[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, from the index of each row's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ngrams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each position on, and whether they lie in one row."""
    count = len(h) - n + 1
    if count <= 0:
        return np.zeros(0, U64), np.zeros(0, bool)
    out = np.zeros(count, U64)
    for k in range(n):
        out = (out + h[k : k + count]) * U64(0xC2B2AE3D27D4EB4F)
        out ^= out >> U64(29)
    row = rows_of(first)
    return mix(out), row[:count] == row[n - 1 :]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by block-wise running minima from both sides."""
    n = len(x)
    if n < w:
        return x[:0]
    blocks = -(-n // w)
    pad = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    pad[:n] = x
    grid = pad.reshape(blocks, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def binary_array(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
