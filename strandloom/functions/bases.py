"""Column expressions over bases, sequences and 32-bit words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF


def base_code(letter: Column) -> Column:
    """A, C, T, G (any case) -> 0, 1, 2, 3."""
    return F.shiftright(F.ascii(letter), 1).bitwiseAND(3)


def base_letter(code: Column) -> Column:
    return F.substring(F.lit("ACTG"), code + 1, F.lit(1))


def complement_code(code: Column) -> Column:
    return code.bitwiseXOR(F.lit(2))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def rotate_left(x: Column, by: Column) -> Column:
    """Rotate a 32-bit word held in a bigint."""
    r = F.pmod(by, F.lit(32)).cast("int")
    left = F.call_function("shiftleft", x, r).bitwiseAND(F.lit(MASK))
    return left.bitwiseOR(F.call_function("shiftright", x, F.lit(32) - r))


def rotate_right(x: Column, by: Column) -> Column:
    return rotate_left(x, F.lit(32) - F.pmod(by, F.lit(32)))


def dna_letters(text: Column, ambiguous: bool = False) -> Column:
    """The DNA letters of a text, in order; with `ambiguous` the letter N too."""
    return F.regexp_replace(text, "[^ACGTNacgtn]" if ambiguous else "[^ACGTacgt]", "")


def pack_bases(seq: Column) -> Column:
    """Four bases a byte, the first in the low bits, as binary."""
    from .arrow import pack_udf

    return pack_udf()(seq)


def unpack_bases(packed: Column, length: Column) -> Column:
    from .arrow import unpack_udf

    return unpack_udf()(packed, length)
