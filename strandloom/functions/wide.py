"""NumPy kernels that order k-mers by whole 64-bit hashes, for comparison with the engine's 16 bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# 64-bit hash constants of the letters, the word multiplier and the packed multiplier.
LETTERS = {"A": 0x3C8BFBB395C60474, "C": 0x3193C18562A02B4C, "G": 0x20323ED082572324, "T": 0x295549F54BE24456, "N": 0}
OTHER = 1
WORD_MUL = 0x517CC1B727220A95
PACKED_MUL = 1234565323

#: Bytes handled at once; a longer sequence is handled alone.
GROUP = 1 << 20


def turn(x: np.ndarray, r: np.ndarray | int) -> np.ndarray:
    """x rotated left by r in 64 bits."""
    r = np.asarray(r, np.uint64) % np.uint64(64)
    return (x << r) | (x >> ((np.uint64(64) - r) % np.uint64(64)))


def nt64(data: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash with rotation 1 over upper-case letters; any other byte counts as OTHER."""
    table = np.full(256, OTHER, np.uint64)
    for letter, value in LETTERS.items():
        table[ord(letter)] = value
    at = np.arange(len(data), dtype=np.int64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.bitwise_xor.accumulate(turn(table[data], -at % 64), out=total[1:])
    return turn(total[k:] ^ total[:-k], (at[: len(data) - k + 1] + k - 1) % 64)


def fx64(data: np.ndarray, k: int) -> np.ndarray:
    """The length, then words of 8, 4 and 1 little-endian bytes: turn by 5, XOR, multiply modulo 2**64."""
    n = len(data) - k + 1
    wide = data.astype(np.uint64)
    state = np.zeros(n, np.uint64)

    def take(word) -> np.ndarray:
        return (turn(state, 5) ^ word) * np.uint64(WORD_MUL)

    state = take(np.uint64(k))
    j = 0
    for size in [8] * (k // 8) + [4] * (k % 8 // 4) + [1] * (k % 4):
        word = np.zeros(n, np.uint64)
        for i in range(size):
            word |= wide[j + i : j + i + n] << np.uint64(8 * i)
        state = take(word)
        j += size
    return state


def fx_packed(data: np.ndarray, k: int) -> np.ndarray:
    """The k-mer's two-bit codes as one number, first base highest, times a constant modulo 2**32."""
    if k > 16:
        raise ValueError("fx_packed takes k up to 16")
    n = len(data) - k + 1
    codes = ((data >> 1) & 3).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for j in range(k):
        word = (word << np.uint64(2)) | codes[j : j + n]
    return (word * np.uint64(PACKED_MUL)) & np.uint64(0xFFFFFFFF)


HASHERS = {"nt64": nt64, "fx64": fx64, "fx_packed": fx_packed}


def window_best(hashes: np.ndarray, w: int, rightmost: bool = False) -> np.ndarray:
    """Position of the least of each w hashes, by doubling."""
    best, have = np.arange(len(hashes)), 1
    while have < w:
        step = min(have, w - have)
        if len(best) <= step:
            return best[:0]
        a, b = best[:-step], best[step:]
        best = np.where(hashes[b] <= hashes[a] if rightmost else hashes[b] < hashes[a], b, a)
        have += step
    return best


def reached(following: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Nodes on the paths from `starts`; following[i] > i, and len(following) is the end of every path.

    Paths are doubled each round, so a path of n nodes takes log2(n) rounds over arrays.
    """
    n = len(following)
    jump = np.append(following, n)
    seen = np.zeros(n + 1, bool)
    seen[starts] = True
    seen[n] = True
    many = 0
    while many != (many := int(seen.sum())):
        seen[jump[np.flatnonzero(seen)]] = True
        jump = jump[jump]
    return np.flatnonzero(seen[:n])


def _groups(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of up to GROUP bytes."""
    i, rows = 0, len(offsets) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + GROUP, "right")) - 1)
        yield i, j
        i = j


def sample(data: np.ndarray, offsets: np.ndarray, k: int, w: int, hasher: str, ties: str, scheme: str):
    """(row, window, position) of the samples of all sequences, in window order."""
    parts = [_sample(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k, w, hasher, ties, scheme, i) for i, j in _groups(offsets)]
    return tuple(np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts) if parts else ((), (), ())))


def _sample(data, offsets, k, w, hasher, ties, scheme, base):
    none = (np.zeros(0, np.int64),) * 3
    if len(data) < k + w - 1:
        return none
    best = window_best(HASHERS[hasher](data, k), w, ties == "right")
    windows = np.maximum(np.diff(offsets) - (k + w - 2), 0)
    row = np.repeat(np.arange(len(windows)), windows)
    first = offsets[:-1]
    at = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows) + first[row]  # places of whole windows
    if scheme == "jumping" and len(at):
        final = first + windows - 1
        following = np.full(len(data), len(data))
        inner = at[at < final[row]]
        onward = best[inner] + 1
        own = np.repeat(final, np.maximum(windows - 1, 0))
        following[inner] = np.where(onward < own, onward, len(data))
        some = windows > 0
        hit = reached(following, first[windows > 1])
        at = np.sort(np.concatenate([hit, final[some]]))
        row = np.searchsorted(first, at, "right") - 1
    pos = best[at]
    if scheme != "windows" and len(at):
        new = np.concatenate([[True], (pos[1:] != pos[:-1]) | (row[1:] != row[:-1])])
        at, row, pos = at[new], row[new], pos[new]
    return row + base, at - first[row], pos - first[row]
