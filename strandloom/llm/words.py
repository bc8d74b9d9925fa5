"""Vectorised word scanning over Arrow text columns.

Words are hashed straight from the UTF-8 buffer: a polynomial over random byte
codes, taken from prefix sums modulo 2**64, then mixed. No Python object is made
per word, and a batch is handled in pieces of bounded bytes (a single text may
exceed the bound and is then a piece of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 19
_RNG = np.random.default_rng(20240607)
_CODES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULT, -1, 1 << 64)
_powers = {"pow": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}

SPACE = np.ones(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps modulo 2**64."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["pow"]) < n:
        for key, m in (("pow", _MULT), ("inv", _INVERSE)):
            a = np.full(n, m, np.uint64)
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
    return _powers["pow"][:n], _powers["inv"][:n]


def forget(keep: int = 2 * PIECE_BYTES) -> None:
    """Drop the tables of powers that a very long text has left behind."""
    if len(_powers["pow"]) > keep:
        for key in _powers:
            _powers[key] = _powers[key][:keep].copy()


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of at most `limit` bytes. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if offs else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def scan(buf: np.ndarray, offsets: np.ndarray, lower: bool = False, word: np.ndarray = SPACE):
    """Words of a piece: (starts, ends, first word of each row with the total at the end, 64-bit hashes)."""
    n = len(buf)
    rows = len(offsets) - 1
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(rows + 1, np.int64), np.zeros(0, np.uint64)
    inside = word[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    pw, inv = _power(n + 1)
    codes = _CODES[LOWER] if lower else _CODES
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(codes[buf] * pw[:n], out=total[1:])
    h = mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
    return starts, ends, np.searchsorted(starts, offsets), h


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of `k` word hashes, by start; crosses rows, so callers mask row ends."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[i : i + n]
    return mix(out)


def row_of(firsts: np.ndarray) -> np.ndarray:
    """Row number of each word, from the `firsts` that `scan` returns."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
