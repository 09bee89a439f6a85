"""Vectorised text measurement: Arrow string columns seen as one byte buffer with offsets, no loop over rows or characters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WS = np.zeros(256, bool)
WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_HASH = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_HASH_LOWER = BYTE_HASH[LOWER]
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}
#: Bytes of text that are measured together: bounds the temporary arrays (about 60 bytes per byte of text).
SLICE_BYTES = 1 << 20
SLICE_ROWS = 2048


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n``; kept while they are no longer than a slice needs."""
    if "p" in _powers and _powers["p"].size >= n:
        return _powers["p"], _powers["i"]
    size = max(n, SLICE_BYTES + 1)
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        a = np.full(size, base, np.uint64)
        a[0] = 1
        out.append(np.cumprod(a, dtype=np.uint64))
    if size <= 8 * SLICE_BYTES:
        _powers["p"], _powers["i"] = out
    return out[0], out[1]


def prefix_hash(buf: np.ndarray, table: np.ndarray = BYTE_HASH) -> np.ndarray:
    """S with hash(buf[a:b]) = (S[b] - S[a]) * inverse_power[a], for :func:`span_hash`."""
    p, _ = powers(buf.size + 1)
    s = np.empty(buf.size + 1, np.uint64)
    s[0] = 0
    v = table[buf]
    v *= p[: buf.size]
    np.cumsum(v, out=s[1:])
    return s


def span_hash(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    _, i = powers(s.size)
    return mix((s[b] - s[a]) * i[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the offsets (rows + 1) of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(col: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text and SLICE_ROWS rows, or one row."""
    if len(col) == 0:
        return
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64))
    a = 0
    while a < len(col):
        b = int(np.searchsorted(size, (size[a - 1] if a else 0) + most, "right"))
        b = max(min(b, a + SLICE_ROWS), a + 1)
        yield a, b
        a = b


@dataclass
class Words:
    """The words of a slice: byte range and row of each, and the first word of each row (rows + 1)."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray


def words(buf: np.ndarray, off: np.ndarray, blank: np.ndarray = WS) -> Words:
    """The maximal runs of bytes that ``blank`` does not mark."""
    n = buf.size
    rows = off.size - 1
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(rows + 1, np.int64))
    ink = ~blank[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    a = ink.copy()
    a[1:] &= ~ink[:-1] | edge[1:n]
    b = ink.copy()
    b[:-1] &= ~ink[1:] | edge[1:n]
    start = np.flatnonzero(a)
    end = np.flatnonzero(b) + 1
    first = np.searchsorted(start, off)
    row = np.repeat(np.arange(rows), np.diff(first))
    return Words(start, end, row, first)


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive boundaries; zero where a row has none."""
    s = np.zeros(values.size + 1, np.int64)
    np.cumsum(values, out=s[1:])
    return s[first[1:]] - s[first[:-1]]
