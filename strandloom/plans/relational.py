"""The same samples as pure window expressions: a second engine, no Python workers.

Bases become rows; the rolling hash is a running XOR of rotated base constants, so
the hash of a k-mer is the difference of two prefixes; sliding minima, strand counts
and adjacent repeats are window functions over one exchange and sort per sequence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions.bases import MASK, rotate_left, rotate_right
from strandloom.functions.kernel import NT, ROTATION
from strandloom.options import SketchOptions

WIDE = 1 << 32


def bases(df: DataFrame, seq: str, keep: list[str]) -> DataFrame:
    """A row per base: the kept columns, pos, code, plain (an A, C, G or T of any case)."""
    letters = F.posexplode(F.split(F.col(seq), "")).alias("pos", "letter")
    rows = df.filter(F.length(seq) > 0).select(*keep, letters).filter("letter <> ''")
    code = F.shiftright(F.ascii("letter"), 1).bitwiseAND(3)
    return rows.select(*keep, F.col("pos").cast("long").alias("pos"), code.alias("code"), F.col("letter").isin(*"ACGTacgt").alias("plain"))


def _constant(code: Column) -> Column:
    return reduce(lambda c, i: c.when(code == i, F.lit(int(NT[i]))), range(1, 4), F.when(code == 0, F.lit(int(NT[0])))).cast("long")


def hashed(rows: DataFrame, keep: list[str], k: int, canonical: bool) -> DataFrame:
    """Add hash: that of the k-mer at pos, null where the sequence has fewer than k bases left."""
    run = W.partitionBy(*keep).orderBy("pos").rowsBetween(0, k - 1)
    turn = F.col("pos") * ROTATION
    out = rows.withColumn("_f", rotate_right(_constant(F.col("code")), turn))
    if canonical:
        out = out.withColumn("_r", rotate_left(_constant(F.col("code").bitwiseXOR(F.lit(2))), turn))
        out = out.withColumn("_rx", F.bit_xor("_r").over(run))
    out = out.withColumn("_fx", F.bit_xor("_f").over(run)).withColumn("_n", F.count(F.lit(1)).over(run))
    hash_ = rotate_left(F.col("_fx"), (F.col("pos") + (k - 1)) * ROTATION)
    if canonical:
        hash_ = (hash_ + rotate_right(F.col("_rx"), turn)).bitwiseAND(F.lit(MASK))
    return out.withColumn("hash", F.when(F.col("_n") == k, hash_)).drop("_f", "_r", "_fx", "_rx", "_n")


def sketch(df: DataFrame, seq: str, options: SketchOptions, keep: list[str]) -> DataFrame:
    """As `operators.sketch.sketch` for the nt hasher; `keep` must name one sequence per value."""
    if options.hasher != "nt" or options.seed is not None or options.alphabet != "dna":
        raise ValueError("the relational engine has the nt hasher only")
    k, w, length = options.k, options.w, options.length
    one = W.partitionBy(*keep).orderBy("pos")
    run, span = one.rowsBetween(0, w - 1), one.rowsBetween(0, length - 1)
    rows = hashed(bases(df, seq, keep), keep, k, options.hash_canonical)
    top = F.shiftright("hash", 16) * WIDE
    rows = rows.withColumn("_left", F.min(top + F.col("pos")).over(run)).withColumn("_n", F.count("hash").over(run))
    answer = F.col("_left").bitwiseAND(F.lit(MASK))
    if options.canonical:
        rows = rows.withColumn("_right", F.min(top + (F.lit(MASK) - F.col("pos"))).over(run)).withColumn(
            "_tg", F.sum(F.shiftright("code", 1)).over(span)
        )
        answer = F.when(2 * F.col("_tg") > length, answer).otherwise(F.lit(MASK) - F.col("_right").bitwiseAND(F.lit(MASK)))
    if options.ambiguous == "skip":
        rows = rows.withColumn("_plain", F.bool_and("plain").over(span))
    out = rows.filter(F.col("_n") == w)
    if options.ambiguous == "skip":
        out = out.filter("_plain")
    out = out.select(*keep, F.col("pos").alias("win"), answer.alias("pos"))
    if options.kind == "closed":
        return out.filter((F.col("pos") == F.col("win")) | (F.col("pos") == F.col("win") + (w - 1)))
    if options.kind == "open":
        return out.filter(F.col("pos") == F.col("win") + w // 2)
    if options.all_windows:
        return out
    before = F.lag("pos").over(W.partitionBy(*keep).orderBy("win"))
    return out.withColumn("_b", before).filter("_b is null or _b <> pos").drop("_b")


def sliding_minimum(df: DataFrame, key: list[str], order: str, value: str, w: int) -> DataFrame:
    """For each full window of w rows: the order numbers of its leftmost and rightmost least value's upper half.

    `order` holds 0, 1, 2 ... per key, `value` 32-bit words.
    """
    run = W.partitionBy(*key).orderBy(order).rowsBetween(0, w - 1)
    top = F.shiftright(F.col(value), 16) * WIDE
    out = df.withColumn("_l", F.min(top + F.col(order)).over(run)).withColumn("_r", F.min(top + (F.lit(MASK) - F.col(order))).over(run))
    out = out.withColumn("_n", F.count(F.lit(1)).over(run)).filter(F.col("_n") == w)
    return out.select(
        *key, F.col(order).alias("win"), F.col("_l").bitwiseAND(F.lit(MASK)).alias("left"), (F.lit(MASK) - F.col("_r").bitwiseAND(F.lit(MASK))).alias("right")
    )


def adjacent_distinct(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value differs from the row before; null values (skipped windows) are left out first."""
    rows = df.filter(F.col(value).isNotNull())
    return rows.withColumn("_b", F.lag(value).over(W.partitionBy(*key).orderBy(order))).filter(F.col("_b").isNull() | (F.col("_b") != F.col(value))).drop("_b")
