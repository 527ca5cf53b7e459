"""Vectorised scans of Arrow text columns: word spans and 64-bit polynomial hashes.

All arithmetic is modulo 2**64. A span's polynomial hash comes from prefix sums, so the
hash of any run of bytes or words costs two lookups, however long the run is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one document may exceed it.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE_BYTE = _U(0x9E3779B97F4A7C15)
_BASE_WORD = _U(0xD6E8FEB86659FD93)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half the output bits."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


class Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, _U(pow(int(base), -1, 2**64))
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self.need(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def span(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64))


BYTES, WORDS = Powers(_BASE_BYTE), Powers(_BASE_WORD)


class Chunk:
    """Rows first..last of a batch: their bytes, and where each row's bytes lie."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.rows = len(offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words (runs without ASCII white space), and each row's first word number."""
        n = len(self.data)
        word = ~_SPACE[self.data]
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        before = np.zeros(n, bool)
        before[1:] = word[:-1]
        starts = np.flatnonzero(word & (~before | cut[:n]))
        after = np.zeros(n, bool)
        after[:-1] = word[1:]
        ends = np.flatnonzero(word & (~after | cut[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def letters(self) -> np.ndarray:
        """The bytes of all words."""
        return self.data[~_SPACE[self.data]]

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each word: eight bytes after eight are mixed into it."""
        data = np.concatenate([self.data, np.zeros(8, np.uint8)])
        out = mix((ends - starts).astype(np.uint64) ^ _BASE_WORD)
        at, left, of = starts.astype(np.int64), ends - starts, np.arange(len(starts))
        while len(of):
            eight = np.zeros(len(of), np.uint64)
            for i in range(8):
                eight |= np.where(left > i, data[at + np.minimum(i, left)], 0).astype(np.uint64) << _U(8 * i)
            out[of] = mix(out[of] * _BASE_BYTE ^ mix(eight ^ _BASE_BYTE))
            more = left > 8
            at, left, of = at[more] + 8, left[more] - 8, of[more]
        return out


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Split a string or binary column into chunks of whole rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, "right")) - 1)
        last = min(last, n)
        yield Chunk(first, raw[offs[first] : offs[last]], offs[first : last + 1] - offs[first])
        first = last


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each start of a window of `width` values, the index of its leftmost smallest value."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    best, size = np.arange(n, dtype=np.int64), 1
    while size < width:
        step = min(size, width - size)
        left, right = best[: n - size - step + 1], best[step : step + n - size - step + 1]
        best = np.where(values[right] < values[left], right, left)
        size += step
    return best
