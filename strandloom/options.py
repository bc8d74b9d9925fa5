"""Validated options of a sketch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

KINDS = ("minimizers", "closed", "open")
HASHERS = ("nt", "mul", "antilex")


@dataclass(frozen=True)
class SketchOptions:
    """What to sample from a sequence.

    k: k-mer length; w: k-mers per window; canonical: strand-symmetric; kind:
    "minimizers", or "closed" or "open" syncmers (of length k + w - 1); hasher: a
    name, or a callable from a uint8 array of codes and k to a uint32 array with one
    hash per k-mer start; seed: changes a named hasher; symmetric: hash canonically
    even when positions are chosen by the forward rule (defaults to `canonical`);
    ambiguous: "code" hashes other letters as the base their bits give, "skip" leaves
    out windows that hold one; alphabet: "dna", or "bytes" for any text;
    all_windows: one row per window, without dropping repeats.
    """

    k: int
    w: int
    canonical: bool = False
    kind: str = "minimizers"
    hasher: str | Callable = "nt"
    seed: int | None = None
    symmetric: bool | None = None
    ambiguous: str = "code"
    alphabet: str = "dna"
    all_windows: bool = False

    def __post_init__(self):
        if self.k < 1:
            raise ValueError("k must be at least 1")
        if not 0 < self.w < 1 << 15:
            raise ValueError("w must be from 1 to 32767")
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        if self.canonical and self.length % 2 == 0:
            raise ValueError("canonical sampling needs an odd window length k + w - 1")
        if self.kind == "open" and self.w % 2 == 0:
            raise ValueError("open syncmers need an odd w")
        if not callable(self.hasher) and self.hasher not in HASHERS:
            raise ValueError(f"hasher must be callable or one of {HASHERS}")
        if self.ambiguous not in ("code", "skip"):
            raise ValueError('ambiguous must be "code" or "skip"')
        if self.alphabet not in ("dna", "bytes"):
            raise ValueError('alphabet must be "dna" or "bytes"')
        if self.alphabet == "bytes" and (self.canonical or self.hasher == "nt" or self.ambiguous == "skip"):
            raise ValueError("general text takes neither strands, nor the nt hasher, nor ambiguity")
        if self.canonical and self.symmetric is False:
            raise ValueError("canonical sampling needs a canonical hasher")
        if self.kind != "minimizers" and self.all_windows:
            raise ValueError("all_windows is for minimizers")

    @property
    def length(self) -> int:
        """Bases in a window."""
        return self.k + self.w - 1

    @property
    def hash_canonical(self) -> bool:
        return self.canonical if self.symmetric is None else self.symmetric

    @property
    def value_length(self) -> int:
        return self.k if self.kind == "minimizers" else self.length


def syncmer_options(s: int, length: int, **more) -> SketchOptions:
    """Syncmers named by syncmer length and inner k-mer length `s`."""
    return SketchOptions(k=s, w=length - s + 1, **{"kind": "closed", **more})
