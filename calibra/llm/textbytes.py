"""Vectorised work on the UTF-8 bytes of Arrow text columns.

The mappers of this subpackage see a text column as one byte buffer with
offsets. Runs of bytes (words, pieces) are found with masks and hashed to 64
bits with prefix sums of a polynomial over a random byte table, a segment of
about a megabyte at a time, so memory does not follow the length of a text.
A null text reads as empty.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_UP = np.ones(1, dtype=np.uint64)
_DOWN = np.ones(1, dtype=np.uint64)


def _powers(n: int):
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    global _UP, _DOWN
    if len(_UP) < n:
        size = max(n, SEGMENT + 1)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        _UP, _DOWN = out
    return _UP, _DOWN


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary Arrow array and the offsets of its rows (nulls are empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, dtype=kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    b = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[offs[0]:offs[-1]], offs - offs[0]


def doc_groups(offs: np.ndarray, size: int = 4 * SEGMENT):
    """Consecutive row ranges of about ``size`` bytes (a longer row stands alone)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def run_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs [start, end), which are ascending and disjoint."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(int(np.searchsorted(ends, lo + SEGMENT, side="right")), i + 1)
        hi = int(ends[j - 1])
        up, down = _powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_TABLE[b[lo:hi]] * up[:hi - lo], out=sums[1:], dtype=np.uint64)
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        i = j
    return out


def run_bounds(inside: np.ndarray, offs: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` that do not cross a row of ``offs`` or a break
    (``breaks[i]``: a run may not hold both i - 1 and i)."""
    n = len(inside)
    first = np.zeros(n + 1, dtype=bool)
    if breaks is not None:
        first[:n] = breaks
    first[offs] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:n]
    ends = np.empty(n, dtype=bool)
    ends[:-1] = inside[:-1] & (~inside[1:] | first[1:n])
    if n:
        ends[-1] = inside[-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def words(b: np.ndarray, offs: np.ndarray):
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row, A-Z lower-cased.

    Returns the lower-cased bytes, starts, ends, 64-bit hashes, and for each
    row the index of its first word (one more entry than rows).
    """
    low = LOWER[b]
    starts, ends = run_bounds(~SPACE[b], offs)
    return low, starts, ends, run_hashes(low, starts, ends), np.searchsorted(starts, offs)
