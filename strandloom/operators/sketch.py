"""Sampling operators: a row per sample, computed in Arrow batches without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.arrow import hashes_udf, sketch_udf
from strandloom.options import SketchOptions
from strandloom.shipping import ship

#: Windows per chunk when sequences are cut.
CHUNK = 1 << 20


def _carried(df: DataFrame, seq: str, keep: list[str] | None) -> list[str]:
    return keep if keep is not None else [c for c in df.columns if c != seq]


def sketch(df: DataFrame, seq: str, options: SketchOptions, keep: list[str] | None = None, value: bool = False, chunk: int | None = None, spread: int | None = None) -> DataFrame:
    """Samples of the column `seq`: the kept columns, then win, pos and, if asked, value.

    For minimizers win is the first window of a run with the same answer, that is the
    start of its super-k-mer; for syncmers win is where the syncmer starts. A null or
    short sequence gives no rows. With `chunk`, a sequence is cut into pieces of so
    many windows that overlap by what an answer can see; results are the same. A
    row's pieces are cut and sampled in its own task, unless `spread` names a number
    of partitions: the cut pieces are then dealt out evenly, by one shuffle of the
    sequences, so that one very long row keeps many tasks busy. Works on streams.
    """
    ship(df.sparkSession)
    names = _carried(df, seq, keep)
    if chunk or spread:
        return _chunked(df, seq, options, names, value, chunk or CHUNK, spread)
    return _exploded(df.select(*names, F.col(seq).alias("_s")), names, options, value)


def _exploded(rows: DataFrame, names: list[str], options: SketchOptions, value: bool) -> DataFrame:
    fields = ["win", "pos"] + ["value"] * value
    met = rows.select(*names, sketch_udf(options, value)("_s").alias("_m"))
    # inline_outer and a filter: inline would make Catalyst evaluate the function twice
    out = met.select(*names, F.inline_outer(F.arrays_zip(*[F.col(f"_m.{f}").alias(f) for f in fields])))
    return out.filter("win is not null")


def _chunked(df: DataFrame, seq: str, options: SketchOptions, names: list[str], value: bool, chunk: int, spread: int | None) -> DataFrame:
    length = options.length
    # substring of binary copies only the piece; of a string it would scan from the start
    rows = df.select(*names, F.col(seq).cast("binary").alias("_b"))
    windows = F.length("_b") - (length - 1)
    pieces = rows.filter(windows > 0).select(*names, "_b", F.explode(F.sequence(F.lit(0), F.floor((windows - 1) / chunk).cast("int"))).alias("_j"))
    begin = F.greatest(F.col("_j") * F.lit(chunk) - 1, F.lit(0))  # one window of context
    size = F.lit(chunk + length) - F.when(F.col("_j") == 0, 1).otherwise(0)
    cut = pieces.select(*names, "_j", begin.cast("long").alias("_at"), F.substring("_b", begin + 1, size).alias("_s"))
    if spread:
        cut = cut.repartition(spread)
    out = _exploded(cut, [*names, "_j", "_at"], options, value).filter("_j = 0 or win > 0")
    fields = [(F.col("win") + F.col("_at")).alias("win"), (F.col("pos") + F.col("_at")).alias("pos")]
    return out.select(*names, *fields, *["value"] * value)


def minimizers(df: DataFrame, seq: str, k: int, w: int, **more) -> DataFrame:
    return _options(df, seq, more, k=k, w=w)


def canonical_minimizers(df: DataFrame, seq: str, k: int, w: int, **more) -> DataFrame:
    return _options(df, seq, more, k=k, w=w, canonical=True)


def closed_syncmers(df: DataFrame, seq: str, k: int, w: int, **more) -> DataFrame:
    return _options(df, seq, more, k=k, w=w, kind="closed")


def canonical_closed_syncmers(df: DataFrame, seq: str, k: int, w: int, **more) -> DataFrame:
    return _options(df, seq, more, k=k, w=w, kind="closed", canonical=True)


def open_syncmers(df: DataFrame, seq: str, k: int, w: int, **more) -> DataFrame:
    return _options(df, seq, more, k=k, w=w, kind="open")


def canonical_open_syncmers(df: DataFrame, seq: str, k: int, w: int, **more) -> DataFrame:
    return _options(df, seq, more, k=k, w=w, kind="open", canonical=True)


def _options(df: DataFrame, seq: str, more: dict, **fixed) -> DataFrame:
    own = {n: more.pop(n) for n in ("keep", "value", "chunk", "spread") if n in more}
    return sketch(df, seq, SketchOptions(**fixed, **more), **own)


def super_kmers(df: DataFrame, seq: str, options: SketchOptions, keep: list[str] | None = None) -> DataFrame:
    """Runs of windows with one answer: win, pos, end_win, and the bases [win, win + length) the run covers."""
    names = _carried(df, seq, keep)
    n = F.length(F.col(seq).cast("binary"))
    rows = df.select(*names, n.alias("_n"), F.col(seq).alias("_s"))
    ship(df.sparkSession)
    met = rows.select(*names, "_n", sketch_udf(options)("_s").alias("_m"))
    last = F.col("_n") - options.length + 1
    ends = F.when(F.size("_m.win") > 0, F.concat(F.slice("_m.win", F.lit(2), F.size("_m.win")), F.array(last.cast("long"))))
    out = met.select(*names, F.inline_outer(F.arrays_zip(F.col("_m.win").alias("win"), F.col("_m.pos").alias("pos"), ends.alias("end_win"))))
    return out.filter("win is not null").withColumn("length", F.col("end_win") - F.col("win") + (options.length - 1))


def kmer_hashes(df: DataFrame, seq: str, options: SketchOptions, keep: list[str] | None = None) -> DataFrame:
    """The 32-bit hash of every k-mer: pos, hash."""
    ship(df.sparkSession)
    names = _carried(df, seq, keep)
    met = df.select(*names, hashes_udf(options)(F.col(seq)).alias("_m"))
    return met.select(*names, F.inline_outer(F.arrays_zip(F.col("_m.pos").alias("pos"), F.col("_m.hash").alias("hash")))).filter("pos is not null")


def one_minimizer(df: DataFrame, seq: str, k: int, canonical: bool = False, keep: list[str] | None = None) -> DataFrame:
    """The position of the least hash of each whole sequence, leftmost on ties; null if there is no k-mer."""
    ship(df.sparkSession)
    names = _carried(df, seq, keep)
    met = df.select(*names, hashes_udf(SketchOptions(k, 1, symmetric=canonical))(F.col(seq)).alias("_m"))
    keys = F.transform(F.arrays_zip(F.col("_m.hash").alias("hash"), F.col("_m.pos").alias("pos")), lambda x: F.shiftright(x["hash"], 16) * F.lit(1 << 32) + x["pos"])
    return met.select(*names, F.array_min(keys).bitwiseAND(F.lit(0xFFFFFFFF)).alias("pos"))


def positions(seq: Column, options: SketchOptions) -> Column:
    """The sample positions of a sequence as an array, in order (syncmers: their starts)."""
    field = "pos" if options.kind == "minimizers" else "win"
    return sketch_udf(options)(seq)[field]
