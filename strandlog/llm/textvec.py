"""Vectorised views of Arrow text columns.

Texts of a batch are handled as one byte buffer, so that words, hashes of words
and hashes of word windows cost a few numpy passes over whole texts instead of
Python work for each word. Batches are cut by bytes, not rows, which bounds the
memory of a task by the slice size or one text, whichever is larger.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
#: For work that holds many times a slice's bytes.
SMALL_SLICE = 1 << 19

_U = np.uint64
_RATIO = 0x9E3779B97F4A7C15 | 1
_RATIO_INV = pow(_RATIO, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64; a bijection on unsigned 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix64(np.arange(1, n + 1, dtype=_U) * _U(_RATIO) + _U(salt * 0x632BE59BD9B4E019 & (1 << 64) - 1))


_BYTE_CODES = seeds(256, 1)


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64; the table grows as needed."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, min(SLICE_BYTES, max(SMALL_SLICE, 2 * n)) + 1)
        table = np.full(size, _U(base), dtype=_U)
        table[0] = 1
        have = np.cumprod(table, dtype=_U)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[: n + 1]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end] for every span: a polynomial over 64 bits, mixed.

    Equal code sequences have equal hashes wherever they stand.
    """
    n = len(codes)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum(codes * _power(_RATIO, n)[:n], dtype=_U, out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * _power(_RATIO_INV, n)[starts])


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most limit text bytes (one row at least)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    total = np.cumsum(sizes)
    while at < len(sizes):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def give_back() -> None:
    """Give memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc's alone
        libc.malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which what it freed is given back: a worker process lives on, and what it keeps adds to the memory of all later tasks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    if len(column) == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[offsets[0] : offsets[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of all texts of a column.

    data, offsets: bytes of the texts; starts, ends: of each word in data;
    doc: the text of each word; first: index of each text's first word (n + 1).
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, self.offsets = utf8(column)
        if lower:
            self.data = _LOWER[self.data]
        n = len(self.data)
        solid = ~_SPACE[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        begin = solid.copy()
        begin[1:] &= ~solid[:-1] | edge[1:n]
        stop = solid.copy()
        stop[:-1] &= ~solid[1:] | edge[1:n]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.starts, self.offsets).astype(np.int64)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(_BYTE_CODES[self.data], self.starts, self.ends)

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of k words within one text."""
        n = len(hashes)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        at = np.arange(n - k + 1)
        at = at[self.doc[: n - k + 1] == self.doc[k - 1 :]]
        return at, span_hashes(hashes, at, at + k)


def reduce_min(values: np.ndarray, first: np.ndarray, counts: np.ndarray, empty: int) -> np.ndarray:
    """Least value of each run first[i]:first[i] + counts[i]; empty for empty runs."""
    out = np.full(len(counts), empty, dtype=values.dtype)
    full = counts > 0
    if full.any():
        out[full] = np.minimum.reduceat(values, first[:-1][full] if len(first) > len(counts) else first[full])
    return out
