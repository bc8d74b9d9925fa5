"""Definitions, one base at a time."""

# Hash constants of the base codes 0 to 3.
TABLE = [0x95C60474, 0x62A02B4C, 0x82572324, 0x4BE24456]


def rot(x, r):
    r %= 32
    return ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF if r else x


def code(s):
    return [(b >> 1) & 3 for b in s.encode()]


def kmer_hash(c, canonical):
    k = len(c)
    f = r = 0
    for j, x in enumerate(c):
        f ^= rot(TABLE[x], 7 * (k - 1 - j))
        r ^= rot(TABLE[x ^ 2], 7 * j)
    return (f + r) & 0xFFFFFFFF if canonical else f


def windows(s, k, w, canonical):
    c, n = code(s), k + w - 1
    h = [kmer_hash(c[i : i + k], canonical) >> 16 for i in range(len(c) - k + 1)]
    out = []
    for i in range(len(c) - n + 1):
        part = h[i : i + w]
        left = i + part.index(min(part))
        right = i + w - 1 - part[::-1].index(min(part))
        strand = 2 * sum(x >> 1 for x in c[i : i + n]) > n
        out.append(left if not canonical or strand else right)
    return out


def dedup(answers):
    return [(i, p) for i, p in enumerate(answers) if i == 0 or answers[i - 1] != p]
