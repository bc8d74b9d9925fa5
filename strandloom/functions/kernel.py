"""NumPy kernels over many concatenated sequences at once.

Codes of all sequences of a batch lie in one array with offsets. Rolling hashes
come from prefix XORs, sliding minima from doubling, so no step loops over bases.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# The 32-bit hash constants of the bases, by code A, C, T, G, and the rotation.
NT = np.array([0x95C60474, 0x62A02B4C, 0x82572324, 0x4BE24456], np.uint32)
ROTATION = 7
CODES = ((np.arange(256) >> 1) & 3).astype(np.uint8)
PLAIN = np.zeros(256, bool)
PLAIN[np.frombuffer(b"ACGTacgt", np.uint8)] = True
#: An odd multiplier for the multiplying hasher.
MUL = 0x9E3779B1


def rotl(x: np.ndarray, r: np.ndarray | int) -> np.ndarray:
    r = np.asarray(r, np.uint64) % np.uint64(32)
    wide = x.astype(np.uint64)
    return (((wide << r) | (wide >> (np.uint64(32) - r))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def scramble(seed: int | None) -> int:
    """A 32-bit word for a seed; 0 for none."""
    return 0 if seed is None else (seed * 0x85EBCA6B + 0xC2B2AE35) & 0xFFFFFFFF


@lru_cache(16)
def _turned(raw: bytes, reverse: bool) -> np.ndarray:
    """The table for each of the 32 places after which rotations repeat, flat by place and code."""
    table = np.frombuffer(raw, np.uint32)
    turn = ROTATION * np.arange(32) % 32
    return np.stack([rotl(table, int(t if reverse else 32 - t)) for t in turn]).ravel()


def _spin(x: np.ndarray, first: int, sign: int) -> np.ndarray:
    """Element i rotated left by first + sign * ROTATION * i, in rows of 32 so that the turns repeat."""
    n = len(x)
    turn = ((first + sign * ROTATION * np.arange(32)) % 32).astype(np.uint32)
    wide = np.zeros(-(-n // 32) * 32, np.uint32)
    wide[:n] = x
    wide = wide.reshape(-1, 32)
    return ((wide << turn) | (wide >> (np.uint32(32) - turn))).ravel()[:n]


def _rolling(table: np.ndarray, codes: np.ndarray, k: int, reverse: bool) -> np.ndarray:
    """XOR over j of rotl(table[c[i+j]], R(k-1-j)), or rotl(..., Rj) if reverse."""
    if len(codes) < k:
        return np.zeros(0, np.uint32)
    at = np.arange(len(codes), dtype=np.intp)
    at &= 31
    at *= len(table)
    at += codes
    total = np.zeros(len(codes) + 1, np.uint32)
    np.bitwise_xor.accumulate(_turned(table.tobytes(), reverse)[at], out=total[1:])
    part = total[k:] ^ total[:-k]
    return _spin(part, 0, -1) if reverse else _spin(part, ROTATION * (k - 1), 1)


def nt_hash(codes: np.ndarray, k: int, canonical: bool, seed: int | None = None) -> np.ndarray:
    """Rolling 32-bit hash of each k-mer; canonical adds both strands' hashes modulo 2**32."""
    table = NT ^ np.uint32(scramble(seed))
    forward = _rolling(table, codes, k, False)
    return forward + _rolling(table[np.arange(4) ^ 2], codes, k, True) if canonical else forward


def mul_hash(codes: np.ndarray, k: int, canonical: bool, seed: int | None = None) -> np.ndarray:
    """As `nt_hash`, over (code + 1) times an odd constant; for DNA codes and for bytes."""
    table = (np.arange(1, 257, dtype=np.uint64) * np.uint64(MUL) & np.uint64(0xFFFFFFFF)).astype(np.uint32) ^ np.uint32(scramble(seed))
    forward = _rolling(table, codes, k, False)
    return forward + _rolling(table[np.arange(256) ^ 2], codes, k, True) if canonical else forward


def antilex_hash(codes: np.ndarray, k: int, canonical: bool, seed: int | None = None) -> np.ndarray:
    """The first 16 codes (or bytes, 4) as big-endian digits with the first one inverted.

    Shorter k-mers are shifted to the top; canonical is the least of both strands.
    """
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    wide = 2 if len(codes) == 0 or codes.max() < 4 else 8
    take = min(k, 32 // wide)
    top = np.uint64((1 << wide) - 1)

    def read(get) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        for j in range(take):
            digit = get(j).astype(np.uint64)
            out = (out << np.uint64(wide)) | ((top - digit) if j == 0 else digit)
        return out << np.uint64(32 - wide * take)

    out = read(lambda j: codes[j : j + n])
    if canonical:
        out = np.minimum(out, read(lambda j: codes[k - 1 - j : k - 1 - j + n] ^ 2))
    return out.astype(np.uint32) ^ np.uint32(scramble(seed))


NAMED = {"nt": nt_hash, "mul": mul_hash, "antilex": antilex_hash}


def kmer_hashes(codes: np.ndarray, options) -> np.ndarray:
    if callable(options.hasher):
        return np.asarray(options.hasher(codes, options.k), np.uint32)
    return NAMED[options.hasher](codes, options.k, options.hash_canonical, options.seed)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    have = 1
    while have < w:
        step = min(have, w - have)
        if len(a) <= step:
            return a[:0]
        a = np.minimum(a[:-step], a[step:])
        have += step
    return a


#: Windows handled at once: positions within a block fit 16 bits, and its arrays a core's cache.
BLOCK = 1 << 15


def window_minima(hashes: np.ndarray, w: int, rightmost: bool = False) -> np.ndarray:
    """Position of the least upper half of each w hashes; ties by position. At most 2**16 hashes."""
    at = np.arange(len(hashes), dtype=np.uint32)
    low = np.uint32(0xFFFF)
    key = hashes & np.uint32(0xFFFF0000)
    key |= low - at if rightmost else at
    best = sliding_min(key, w) & low
    return low - best if rightmost else best


def prefix(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])


def sample(data: np.ndarray, offsets: np.ndarray, options):
    """(row, window, position) of the samples of all sequences, in window order.

    Windows and positions count from their sequence's start. Sequences shorter than
    a window give nothing.
    """
    length, w = options.length, options.w
    codes = CODES[data] if options.alphabet == "dna" else data
    total = len(codes) - length + 1
    if total <= 0:
        return (np.zeros(0, np.int64),) * 3
    sizes = np.diff(offsets)
    own = np.maximum(sizes - length + 1, 0)
    keep = np.repeat(np.tile([True, False], len(sizes)), np.stack([own, sizes - own], 1).ravel())
    wins, places, tail = [], [], -1
    for at in range(0, total, BLOCK):
        end = min(total, at + BLOCK)
        piece = codes[at : end + length - 1]
        pos = window_answers(piece, options)
        good = keep[at:end]
        if options.ambiguous == "skip":
            odd = prefix(~PLAIN[data[at : end + length - 1]])
            good = good & (odd[length:] == odd[:-length])
        if options.kind != "minimizers":
            start = np.arange(len(pos), dtype=np.uint32)
            good = good & ((pos == start) | (pos == start + np.uint32(w - 1)) if options.kind == "closed" else pos == start + np.uint32(w // 2))
        win = np.flatnonzero(good)
        pos = pos[win]
        if options.kind == "minimizers" and not options.all_windows and len(win):
            new = np.ones(len(win), bool)
            np.not_equal(pos[1:], pos[:-1], out=new[1:])  # sequences share no position
            last, win, pos = pos[-1], win[new], pos[new]
            if int(pos[0]) + at == tail:  # the run goes on from the block before
                win, pos = win[1:], pos[1:]
            tail = int(last) + at
        wins.append(win + at)
        places.append(pos.astype(np.int64) + at)
    win, pos = np.concatenate(wins), np.concatenate(places)
    row = np.searchsorted(offsets, win, "right") - 1
    start = offsets[:-1][row]
    return row, win - start, pos - start


def window_answers(codes: np.ndarray, options) -> np.ndarray:
    """The chosen position of each window of a block."""
    hashes = kmer_hashes(codes, options)
    at = window_minima(hashes, options.w)
    if options.canonical:
        length = options.length
        strand = np.zeros(len(codes) + 1, np.int32)
        np.cumsum(codes >> 1, dtype=np.int32, out=strand[1:])
        leftmost = 2 * (strand[length:] - strand[:-length]) > length
        at = np.where(leftmost, at, window_minima(hashes, options.w, True))
    return at


def values(codes: np.ndarray, at: np.ndarray, length: int, canonical: bool) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) 64-bit halves of sum(c[at + j] << 2j); canonical takes the least of both strands."""
    def read(get):
        low, high = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for j in range(length):
            c = get(j).astype(np.uint64)
            if j < 32:
                low |= c << np.uint64(2 * j)
            else:
                high |= c << np.uint64(2 * j - 64)
        return high, low

    high, low = read(lambda j: codes[at + j])
    if canonical:
        rh, rl = read(lambda j: codes[at + length - 1 - j] ^ 2)
        less = (rh < high) | ((rh == high) & (rl < low))
        high, low = np.where(less, rh, high), np.where(less, rl, low)
    return high, low
