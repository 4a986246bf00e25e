"""Cells of messy tables: trimming, blanks, sentinels, loose equality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space when a cell is trimmed (all Unicode white space and the byte order mark).
WHITE = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The same marks one by one.
WHITE_MARKS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
# Cells that mean "no value", in lower case.
SENTINELS = ("", "null", "n/a", "na", "none", "-", "--", ".")


def trim(cell: Column) -> Column:
    """Without Unicode white space at both ends; blank cells become null."""
    bare = F.regexp_replace(cell, f"^{WHITE}+|{WHITE}+$", "")
    return F.when(bare != "", bare)


def is_blank(cell: Column) -> Column:
    return trim(cell).isNull()


def lower(cell: Column) -> Column:
    return F.lower(trim(cell))


def upper(cell: Column) -> Column:
    return F.upper(trim(cell))


def normalize(cell: Column) -> Column:
    """Trimmed; sentinels become null."""
    bare = trim(cell)
    return F.when(~F.lower(bare).isin(*SENTINELS), bare)


def is_sentinel(cell: Column) -> Column:
    """Whether a cell that is not blank stands for no value."""
    return F.coalesce(F.lower(trim(cell)).isin(*SENTINELS), F.lit(False))


def to_number(cell: Column) -> Column:
    """The finite number a cell holds, commas aside; null otherwise. Plain decimal and exponent forms only."""
    bare = F.regexp_replace(trim(cell.cast("string")), ",", "")
    value = F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def eq_norm(a: Column, b: Column) -> Column:
    """Both blank, or equal numbers (spaces and commas aside), or equal text without white space."""
    number = lambda c: F.transform(F.array(F.replace(c, F.lit(","), F.lit(""))), _number)[0]

    def same(x: Column) -> Column:
        n = F.transform(F.array(F.struct(number(x["a"]).alias("a"), number(x["b"]).alias("b"))), lambda n: F.coalesce(n["a"] == n["b"], x["a"] == x["b"]))[0]
        blank = lambda c: F.coalesce(c == "", F.lit(True))
        return F.when(blank(x["a"]) | blank(x["b"]), blank(x["a"]) & blank(x["b"])).otherwise((x["a"] == x["b"]) | n)

    # each side is squeezed once; equal cells need no numbers
    return F.transform(F.array(F.struct(_squeeze(a).alias("a"), _squeeze(b).alias("b"))), same)[0]


def _squeeze(cell: Column) -> Column:
    return F.translate(cell.cast("string"), WHITE_MARKS, "")


def _number(bare: Column) -> Column:
    """``to_number`` of a cell without white space and commas."""
    value = F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare).try_cast("double")
    return F.transform(F.array(value), lambda v: F.when(F.abs(v) < float("inf"), v))[0]
