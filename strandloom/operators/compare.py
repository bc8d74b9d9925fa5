"""Samplers to hold others against: whole 64-bit hashes, rightmost ties, jumping minimizers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import wide
from strandloom.functions.arrow import column_bytes, list_of
from strandloom.shipping import ship

SCHEMES = ("minimizers", "windows", "jumping")


def wide_minimizers(df: DataFrame, seq: str, k: int, w: int, hasher: str = "nt64", ties: str = "left", scheme: str = "minimizers", keep: list[str] | None = None) -> DataFrame:
    """Samples of the column `seq` under a hash compared in all its bits: the kept columns, win, pos.

    hasher: "nt64" (upper-case letters, rotation 1), "fx64" (any bytes) or "fx_packed"
    (two-bit codes, k up to 16). ties: "left" or "right". scheme: "minimizers" drops
    adjacent repeats, "windows" has a row per window, "jumping" looks for the next
    sample in the w k-mers behind the last one, and at the end in the last w; win is
    where such a search begins. A null sequence, or one under k + w - 1 letters, gives
    no rows. Every sequence is sampled whole, in the task of its row.
    """
    if k < 1 or w < 1:
        raise ValueError("k and w must be at least 1")
    if hasher not in wide.HASHERS:
        raise ValueError(f"hasher must be one of {tuple(wide.HASHERS)}")
    if hasher == "fx_packed" and k > 16:
        raise ValueError("fx_packed takes k up to 16")
    if ties not in ("left", "right") or scheme not in SCHEMES:
        raise ValueError(f'ties must be "left" or "right", scheme one of {SCHEMES}')
    if scheme == "jumping" and ties == "right":
        raise ValueError("jumping takes the leftmost of equal hashes")
    ship(df.sparkSession)

    def run(column: pa.Array) -> pa.Array:
        data, offsets = column_bytes(column)
        row, win, pos = wide.sample(data, offsets, k, w, hasher, ties, scheme)
        return pa.StructArray.from_arrays([list_of(row, len(column), pa.array(x)) for x in (win, pos)], ["win", "pos"])

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    names = keep if keep is not None else [c for c in df.columns if c != seq]
    met = df.select(*names, F.arrow_udf(run, "struct<win:array<bigint>,pos:array<bigint>>")(F.col(seq)).alias("_m"))
    return met.select(*names, F.inline_outer(F.arrays_zip(F.col("_m.win").alias("win"), F.col("_m.pos").alias("pos")))).filter("win is not null")
