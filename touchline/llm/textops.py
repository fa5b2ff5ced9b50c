"""Byte-level text helpers for tasks: slices of Arrow text, word spans, hashes.

Everything works on numpy arrays over the UTF-8 bytes of a bounded slice of
documents, so a task's memory depends on ``SLICE_BYTES`` and the longest
single text, not on the partition.
"""

from __future__ import annotations

import ctypes
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64

# Multiplier of the polynomial hash; odd, so it has an inverse modulo 2**64.
_MUL = 0x9E3779B97F4A7C15 | 2
_INV = pow(_MUL, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
_LIBC = ctypes.CDLL(None)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: spreads every input bit over all output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, at least ``n`` each."""
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1024)
        for key, base in (("p", _MUL), ("i", _INV)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps)
    return _POWERS["p"], _POWERS["i"]


def byte_table(keep: np.ndarray, fold_case: bool, seed: int = 7) -> np.ndarray:
    """A 64-bit value per byte; bytes outside ``keep`` count as zero."""
    table = seeded(256, seed)
    if fold_case:
        table[0x41:0x5B] = table[0x61:0x7B]
    table[~keep] = 0
    return table


def class_of(excluded: Iterable[tuple[int, int]]) -> np.ndarray:
    """Membership table over bytes: all but the given inclusive ranges."""
    keep = np.ones(256, dtype=bool)
    for lo, hi in excluded:
        keep[lo:hi + 1] = False
    return keep


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string/binary column and the offsets of its rows
    (a null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type)
                                  or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offs = np.frombuffer(buffers[1], kind)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def slices(batches: Iterable[pa.RecordBatch], text: str,
           limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into runs of rows of at most ``limit`` text bytes (one
    longer text is a run of its own): (rows, bytes, offsets)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        data, offs = text_bytes(batch.column(batch.schema.get_field_index(text)))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
            hi = min(n, max(lo + 1, hi))
            yield batch.slice(lo, hi - lo), data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
            lo = hi
    release()


def release() -> None:
    """Give freed memory back, so that idle Python workers stay small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)
    if trim is not None:
        trim(0)


def word_spans(data: np.ndarray, offs: np.ndarray,
               keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of kept bytes that do not cross rows: starts, ends, row."""
    w = keep[data]
    edge = offs[:-1][offs[:-1] < offs[1:]]
    before = np.zeros(len(w), dtype=bool)
    before[1:] = w[:-1]
    before[edge] = False
    starts = np.flatnonzero(w & ~before)
    after = np.zeros(len(w), dtype=bool)
    after[:-1] = w[1:]
    after[edge[1:] - 1] = False
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hash of the kept bytes from each start to the next start."""
    if not len(starts):
        return np.zeros(0, U64)
    p, inv = powers(len(data))
    h = np.add.reduceat(table[data] * p[:len(data)], starts)
    return mix64(h * inv[starts])


def windows(values: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``k`` consecutive values within a row: (hash, row)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    acc = np.zeros(n, U64)
    for j in range(k):
        acc = acc * U64(_MUL) + values[j:j + n]
    same = row[:n] == row[k - 1:]
    return mix64(acc[same]), row[:n][same]


def row_starts(row: np.ndarray, n_rows: int) -> np.ndarray:
    """Offsets of rows in an array that is ordered by row."""
    return np.searchsorted(row, np.arange(n_rows + 1))
