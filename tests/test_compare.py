"""Comparison samplers against their definitions, one k-mer at a time."""

import random

import numpy as np
import pytest

from strandloom.functions import wide
from strandloom.operators.compare import wide_minimizers

MASK = (1 << 64) - 1


def rot(x, r):
    r %= 64
    return ((x << r) | (x >> (64 - r))) & MASK


def nt(t):
    out = 0
    for b in t:
        out = rot(out, 1) ^ wide.LETTERS.get(chr(b), wide.OTHER)
    return out


def fx(t):
    words, rest = [len(t)], t
    for size in (8, 4, 1):
        while len(rest) >= size:
            words.append(int.from_bytes(rest[:size], "little"))
            rest = rest[size:]
    out = 0
    for word in words:
        out = ((rot(out, 5) ^ word) * wide.WORD_MUL) & MASK
    return out


def packed(t):
    return int("".join(str((b >> 1) & 3) for b in t), 4) * wide.PACKED_MUL % 2**32


HASH = {"nt64": nt, "fx64": fx, "fx_packed": packed}


def plain(s, k, w, hasher, ties, scheme):
    t = (s or "").encode()
    h = [HASH[hasher](t[i : i + k]) for i in range(len(t) - k + 1)]
    best = lambda i: min(range(i, i + w), key=lambda p: (h[p], p if ties == "left" else -p))
    last, out = len(h) - w, []
    if last < 0:
        return out
    if scheme == "jumping":
        i = 0
        while i < last:
            out.append((i, best(i)))
            i = best(i) + 1
        if not out or out[-1][1] != best(last):
            out.append((last, best(last)))
        return out
    every = [(i, best(i)) for i in range(last + 1)]
    return every if scheme == "windows" else [x for i, x in enumerate(every) if i == 0 or every[i - 1][1] != x[1]]


CASES = [(3, 4), (1, 1), (5, 1), (9, 6), (13, 7), (16, 11)]
WAYS = [("left", "minimizers"), ("right", "minimizers"), ("left", "windows"), ("left", "jumping")]


@pytest.mark.parametrize("hasher", wide.HASHERS)
@pytest.mark.parametrize("k,w", CASES)
def test_kernel(hasher, k, w, monkeypatch):
    rng = random.Random(k * 100 + w)
    texts = ["", "A" * 70, "ACGT", "ACGT" * 9] + ["".join(rng.choice("ACGTN" if i % 2 else "AC") for _ in range(rng.randrange(90))) for i in range(30)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for group in (1, 64, 1 << 20):
        monkeypatch.setattr(wide, "GROUP", group)
        for ties, scheme in WAYS:
            got = list(zip(*(x.tolist() for x in wide.sample(data, offsets, k, w, hasher, ties, scheme))))
            assert got == [(i, *x) for i, t in enumerate(texts) for x in plain(t, k, w, hasher, ties, scheme)], (ties, scheme, group)


def test_no_rows():
    for texts in ([], [b""], [b"", b""]):
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        assert [len(x) for x in wide.sample(np.zeros(0, np.uint8), offsets, 3, 2, "fx64", "left", "jumping")] == [0, 0, 0]


def test_operator(spark):
    texts = [None, "", "ACGTACGGT" * 20, "ACGTACGGT" * 20, "AC", "é" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, seq string").repartition(3)
    for ties, scheme in WAYS:
        got = sorted(map(tuple, wide_minimizers(df, "seq", 5, 4, "fx64", ties, scheme).collect()))
        assert got == [(i, *x) for i, t in enumerate(texts) for x in plain(t, 5, 4, "fx64", ties, scheme)]
    assert wide_minimizers(df.filter("id < 0"), "seq", 5, 4).count() == 0


def test_refusals(spark):
    df = spark.createDataFrame([(1, "ACGT")], "id long, seq string")
    for bad in ({"hasher": "other"}, {"hasher": "fx_packed", "k": 17}, {"ties": "both"}, {"scheme": "all"}, {"scheme": "jumping", "ties": "right"}, {"w": 0}):
        with pytest.raises(ValueError):
            wide_minimizers(df, "seq", **{"k": 5, "w": 4, **bad})
