"""Numpy arithmetic over the bytes of many texts at once: word hashes, shingle sets, rolling hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Texts are worked on in runs of about so many bytes.
RUN_BYTES = 1 << 18
_POWERS: dict[str, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _POWERS or len(_POWERS[key]) < n:
        out = np.full(max(n, RUN_BYTES + 1), base, np.uint64)
        out[0] = 1
        _POWERS[key] = np.multiply.accumulate(out)
    return _POWERS[key][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def runs(column: pa.Array, limit: int = RUN_BYTES):
    """(first row, bytes of the texts end to end, offsets) of runs of rows; null counts as empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def prefix_hash(data: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """Sums c with (c[e] - c[s]) * INVERSE**s (for the base BASE) the polynomial hash of data[s:e]."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), out=out[1:])
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word in order: words end at white space (space and 9 to 13) and at the ends of texts; A-Z count as a-z."""
    low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    solid = ~((low == 32) | ((low >= 9) & (low <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], solid[:-1])) if len(solid) else solid
    after = np.concatenate((solid[1:], [False])) if len(solid) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    c = prefix_hash(low)
    h = mixed((c[ends] - c[starts]) * powers(INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))
    return np.searchsorted(offsets, starts, "right") - 1, h


def shingles(row: np.ndarray, h: np.ndarray, size: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct runs of ``size`` words of each row, sorted; a row with fewer words has one run of all."""
    count = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, np.int64)
    coefficient = mixed(np.arange(1, size + 1, dtype=np.uint64) * BASE)
    n = max(0, len(h) - size + 1)
    x = np.zeros(n, np.uint64)
    for k in range(size):
        x += h[k : k + n] * coefficient[k]
    whole = row[:n] == row[size - 1 : size - 1 + n]
    at, x = row[:n][whole], mixed(x[whole])
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.concatenate(([0], np.cumsum(count)))[short]
        y = count[short].astype(np.uint64) * BASE
        for k in range(size - 1):
            has = count[short] > k
            y[has] += h[first[has] + k] * coefficient[k]
        at, x = np.concatenate((at, short)), np.concatenate((x, mixed(y)))
    order = np.lexsort((x, at))
    at, x = at[order], x[order]
    new = np.ones(len(x), bool)
    new[1:] = (at[1:] != at[:-1]) | (x[1:] != x[:-1])
    return at[new], x[new]


def summed(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, values.dtype)
