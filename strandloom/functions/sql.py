"""SQL surface: scalar functions and a table function registered in a session."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, LongType

from strandloom.options import SketchOptions
from strandloom.shipping import ship


def _positions(canonical: bool, kind: str):
    def run(seq: pd.Series, k: pd.Series, w: pd.Series) -> pd.Series:
        from strandloom.functions import kernel

        out = pd.Series([None] * len(seq), dtype=object)
        known = seq.notna() & k.notna() & w.notna()
        # one call of the kernel for each (k, w), commonly one in all
        for (a, b), rows in seq[known].groupby([k[known], w[known]]):
            texts = [s.encode() for s in rows]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            row, win, pos = kernel.sample(np.frombuffer(b"".join(texts), np.uint8), offsets, SketchOptions(int(a), int(b), canonical, kind))
            found = np.split(pos if kind == "minimizers" else win, np.searchsorted(row, np.arange(1, len(texts))))
            out[rows.index] = pd.Series(found, index=rows.index, dtype=object)
        return out

    return run


def register(spark: SparkSession) -> None:
    """Register minimizer_positions, canonical_minimizer_positions, closed_syncmer_positions and open_syncmer_positions
    (seq, k, w) -> array<bigint>, and the table function minimizers(seq, k, w, canonical) -> (win, pos)."""
    from pyspark.sql.functions import pandas_udf

    ship(spark)
    for name, canonical, kind in (
        ("minimizer_positions", False, "minimizers"), ("canonical_minimizer_positions", True, "minimizers"),
        ("closed_syncmer_positions", False, "closed"), ("canonical_closed_syncmer_positions", True, "closed"),
        ("open_syncmer_positions", False, "open"), ("canonical_open_syncmer_positions", True, "open"),
    ):
        spark.udf.register(name, pandas_udf(_positions(canonical, kind), ArrayType(LongType())))

    @udtf(returnType="win bigint, pos bigint")
    class Minimizers:
        def eval(self, seq: str, k: int, w: int, canonical: bool):
            from strandloom.functions import kernel

            data = np.frombuffer((seq or "").encode(), np.uint8)
            _, win, pos = kernel.sample(data, np.array([0, len(data)]), SketchOptions(k, w, canonical))
            yield from zip(win.tolist(), pos.tolist())

    spark.udtf.register("minimizers", Minimizers)
