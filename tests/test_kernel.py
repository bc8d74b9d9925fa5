import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.functions import kernel
from strandloom.functions.arrow import value_array
from strandloom.options import SketchOptions, syncmer_options

from . import naive

PLAIN = "ACGTGCTCAGAGACTCAG"
LONG = "ACGTGCTCAGAGACTCAGAGGA"


def one(s, o):
    data = np.frombuffer(s.encode(), np.uint8)
    _, win, pos = kernel.sample(data, np.array([0, len(data)]), o)
    return list(zip(win.tolist(), pos.tolist()))


def pos(s, o):
    return [p for _, p in one(s, o)]


def lcg(n):
    return "".join("ACGT"[((i * 1103515245 + 12345) % 2**32 >> 16) % 4] for i in range(n))


def test_goldens():
    assert pos(PLAIN, SketchOptions(5, 7)) == [4, 5, 8, 13]
    assert pos(LONG, SketchOptions(5, 7, canonical=True)) == [0, 7, 9, 15]
    back = LONG[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert pos(back, SketchOptions(5, 7, canonical=True)) == [2, 8, 10, 17]
    assert pos(LONG, SketchOptions(5, 7, canonical=True, all_windows=True)) == [0, 7, 7, 7, 7, 7, 7, 7, 9, 15, 15, 15]
    assert one(LONG, SketchOptions(5, 7, canonical=True)) == [(0, 0), (1, 7), (8, 9), (9, 15)]
    assert one(LONG, SketchOptions(5, 7)) == [(0, 4), (5, 5), (6, 8), (7, 13)]
    assert [w for w, _ in one(LONG, SketchOptions(5, 7, canonical=True, kind="closed"))] == [0, 1, 7, 9]
    assert [w for w, _ in one(LONG, SketchOptions(5, 7, canonical=True, kind="open"))] == [4]
    assert [w for w, _ in one(LONG, SketchOptions(5, 7, kind="closed"))] == [4, 5, 7]
    assert [w for w, _ in one(LONG, SketchOptions(5, 7, kind="open"))] == [1, 10]
    assert pos("ACGTACGTACGT", SketchOptions(3, 5, canonical=True)) == [4, 1, 4, 5, 8, 5]
    assert pos("AAAAAAACCCCCCCGGGGGGGTTTTTTT", SketchOptions(5, 7, canonical=True)) == [4, 6, 13, 10, 17, 19]
    assert kernel.nt_hash(kernel.CODES[np.frombuffer(b"AAA", np.uint8)], 3, True).tolist() == [0x58E8AD3F]
    found = kernel.nt_hash(kernel.CODES[np.frombuffer(b"ACGTACGTACGT", np.uint8)], 7, True).tolist()
    assert [f"{h:08x}" for h in found] == ["f882eae6", "f882eae6", "8b6f6f46", "8b6f6f46", "f882eae6", "f882eae6"]


def test_golden_values():
    at = np.array(pos(LONG, SketchOptions(5, 7, canonical=True)))
    high, low = kernel.values(kernel.CODES[np.frombuffer(LONG.encode(), np.uint8)], at, 5, True)
    assert low.tolist() == [0b1011010001, 0b1100110001, 0b0100110011, 0b1100110001] and not high.any()


def test_generated_counts():
    s = lcg(1000)
    assert len(one(s, SketchOptions(11, 11, all_windows=True))) == 980
    assert len(one(s, SketchOptions(11, 11))) == 182
    assert len(one(s, SketchOptions(11, 11, kind="closed"))) == 186
    assert len(one(s, SketchOptions(11, 11, kind="open"))) == 76
    big = lcg(1_000_000)
    assert len(one(big, SketchOptions(21, 11))) == 200_799
    assert len(one(big, SketchOptions(21, 11, canonical=True))) == 170_608
    assert len(one(big, SketchOptions(11, 11, kind="closed"))) == 189_285
    assert len(one(big, SketchOptions(11, 11, kind="open"))) == 80_948


@settings(max_examples=150, deadline=None)
@given(st.text("ACGTacgt", max_size=120), st.integers(1, 40), st.integers(1, 40), st.booleans())
def test_against_definition(s, k, w, canonical):
    if canonical and (k + w - 1) % 2 == 0:
        w += 1
    answers = naive.windows(s, k, w, canonical)
    assert pos(s, SketchOptions(k, w, canonical=canonical, all_windows=True)) == answers
    assert one(s, SketchOptions(k, w, canonical=canonical)) == naive.dedup(answers)
    assert [i for i, _ in one(s, SketchOptions(k, w, canonical=canonical, kind="closed"))] == [i for i, p in enumerate(answers) if p in (i, i + w - 1)]


@pytest.mark.parametrize("k", [1, 2, 3, 5, 31, 32, 33, 63, 64, 65])
@pytest.mark.parametrize("w", [1, 2, 3, 5, 31, 32, 33, 63, 64, 65])
def test_grid_and_strands(k, w):
    rng = random.Random(k * 100 + w)
    for n in (0, 1, 7, 16, 33, 64, 99, 300):
        s = "".join(rng.choice("ACGT") for _ in range(n))
        assert pos(s, SketchOptions(k, w, all_windows=True)) == naive.windows(s, k, w, False)
        if (k + w - 1) % 2:
            o = SketchOptions(k, w, canonical=True)
            back = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
            assert pos(s, o) == [n - k - p for p in pos(back, o)][::-1]


def test_many_sequences_are_apart():
    parts = ["", "ACGT", LONG, PLAIN, "A" * 40, "", LONG]
    data = np.frombuffer("".join(parts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    for o in (SketchOptions(5, 7), SketchOptions(5, 7, canonical=True), SketchOptions(3, 5, kind="closed"), SketchOptions(5, 7, hasher="antilex")):
        row, win, p = kernel.sample(data, offsets, o)
        assert [list(zip(win[row == i].tolist(), p[row == i].tolist())) for i in range(len(parts))] == [one(x, o) for x in parts]


def test_ambiguous_windows():
    rng = random.Random(4)
    for _ in range(50):
        s = "".join(rng.choice("ACGT") if rng.random() > 0.03 else "N" for _ in range(100))
        o = SketchOptions(5, 7, canonical=True, ambiguous="skip")
        answers = naive.windows(s, 5, 7, True)
        keep = [(i, p) for i, p in enumerate(answers) if "N" not in s[i : i + 11]]
        want = [x for j, x in enumerate(keep) if j == 0 or keep[j - 1][1] != x[1]]
        assert one(s, o) == want


def test_long_positions():
    s = lcg(200_000)
    o = SketchOptions(3, 31)
    codes = kernel.CODES[np.frombuffer(s.encode(), np.uint8)]
    top = kernel.nt_hash(codes, 3, False) >> 16
    want = np.lib.stride_tricks.sliding_window_view(top, 31).argmin(1) + np.arange(len(top) - 30)
    assert pos(s, SketchOptions(3, 31, all_windows=True)) == want.tolist()
    assert o.length == 33


def test_values_all_lengths():
    for length in (1, 15, 31, 32, 33, 47, 63, 64):
        s = "G" * 70
        high, low = kernel.values(kernel.CODES[np.frombuffer(s.encode(), np.uint8)], np.array([0, 3]), length, False)
        got = value_array(high, low, length)[1].as_py()
        got = int.from_bytes(got, "big") if isinstance(got, bytes) else int(got)
        assert got == 4**length - 1


def test_user_hasher_and_seeds():
    o = SketchOptions(3, 4, hasher=lambda codes, k: (np.arange(len(codes) - k + 1, dtype=np.uint32)[::-1] << 16).astype(np.uint32))
    assert pos("ACGTACGTAC", o) == [3, 4, 5, 6, 7]
    assert pos(lcg(300), SketchOptions(5, 7, seed=1)) != pos(lcg(300), SketchOptions(5, 7, seed=2))
    for hasher in ("mul", "antilex"):
        s = lcg(400)
        back = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
        o = SketchOptions(7, 9, canonical=True, hasher=hasher)
        assert pos(s, o) == [len(s) - 7 - p for p in pos(back, o)][::-1]


@pytest.mark.parametrize("bad", [dict(k=0, w=1), dict(k=1, w=0), dict(k=1, w=1 << 15), dict(k=2, w=3, canonical=True), dict(k=3, w=4, kind="open"), dict(k=3, w=3, hasher="?"), dict(k=3, w=3, alphabet="bytes"), dict(k=3, w=3, canonical=True, symmetric=False)])
def test_bad_options(bad):
    with pytest.raises(ValueError):
        SketchOptions(**bad)


def test_syncmer_names():
    assert syncmer_options(11, 21).length == 21
