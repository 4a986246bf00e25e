"""Named transforms: a closed registry, each with the contract that its results can be checked by."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import cells

# How numbers, pairs, ranges and open ranges are written.
NUMBER = r"-?\d+(?:\.\d+)?"
PAIR = r"^(\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)$"
RANGE = rf"^({NUMBER})\s*[-–]\s*({NUMBER})$"
BELOW = rf"^[<≤]=?\s*({NUMBER})$"
ABOVE = rf"^[>≥]=?\s*({NUMBER})$"


def to_date(cell: Column) -> Column:
    """An ISO date at the start is kept as YYYY-MM-DD, M/D/YYYY is turned into it, other text stays trimmed. No calendar check."""
    bare = cells.trim(cell)
    # fixed values: how dates are written
    iso, us = r"^(\d{4})-(\d{2})-(\d{2})", r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    part = lambda i: F.regexp_extract(bare, us, i)
    return F.when(bare.rlike(iso), F.substring(bare, 1, 10)).when(bare.rlike(us), F.concat_ws("-", part(3), F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0"))).otherwise(bare)


def to_boolean(cell: Column) -> Column:
    bare = cells.lower(cell)
    return F.when(bare.isin("y", "yes", "true", "1", "t"), True).when(bare.isin("n", "no", "false", "0", "f"), False)


def split_pair(cell: Column) -> list[Column]:
    """Both numbers of a/b, or nulls."""
    bare = cells.trim(cell)
    return [F.when(bare.rlike(PAIR), F.regexp_extract(bare, PAIR, i)).try_cast("double") for i in (1, 2)]


def reference_range(cell: Column) -> list[Column]:
    """(low, high) of lo-hi, <hi or >lo; open ends and anything else are null."""
    bare = cells.trim(cell)
    got = lambda pattern, i: F.regexp_extract(bare, pattern, i).try_cast("double")
    return [F.when(bare.rlike(RANGE), got(RANGE, 1)).when(bare.rlike(ABOVE), got(ABOVE, 1)), F.when(bare.rlike(RANGE), got(RANGE, 2)).when(bare.rlike(BELOW), got(BELOW, 1))]


def _same_number(raw: Column, out: Column) -> Column:
    return F.coalesce(cells.to_number(raw) == out, cells.is_blank(raw) & out.isNull(), F.lit(False))


@dataclass(frozen=True)
class Transform:
    """``apply`` makes one column, or ``arity`` of them; ``check`` says whether results agree with the raw cell.

    ``kind``: reversible (the cell can be written again), equivalence (another cell with the same meaning can), one-way.
    """

    apply: Callable
    kind: str
    check: Callable[[Column, list[Column]], Column]
    arity: int = 1
    inverse: Callable[[list[Column]], Column] | None = None


def _date_check(raw: Column, out: list[Column]) -> Column:
    return F.coalesce(to_date(out[0]) == to_date(raw), cells.is_blank(raw) & out[0].isNull(), F.lit(False))


def _pair_text(out: list[Column]) -> Column:
    short = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    return F.concat_ws("/", *map(short, out))


def _range_check(raw: Column, out: list[Column]) -> Column:
    """Both ends agree with the cell; one-sided ranges always do."""
    low, high = reference_range(raw)
    one = cells.trim(raw).rlike(BELOW) | cells.trim(raw).rlike(ABOVE)
    return F.coalesce(one, F.lit(False)) | F.coalesce(cells.is_blank(raw) & out[0].isNull() & out[1].isNull(), F.lit(False)) | F.coalesce(cells.trim(raw).rlike(RANGE) & (out[0] == low) & (out[1] == high), F.lit(False))


REGISTRY: dict[str, Transform] = {
    "trim": Transform(cells.trim, "equivalence", lambda raw, out: cells.trim(raw).eqNullSafe(out[0]), inverse=lambda out: out[0]),
    "to_number": Transform(cells.to_number, "equivalence", lambda raw, out: _same_number(raw, out[0]), inverse=lambda out: out[0].cast("string")),
    "to_date": Transform(to_date, "equivalence", _date_check, inverse=lambda out: out[0]),
    "to_boolean": Transform(to_boolean, "one-way", lambda raw, out: to_boolean(raw).eqNullSafe(out[0]) & (out[0].isNotNull() | cells.is_blank(raw))),
    "lower": Transform(cells.lower, "one-way", lambda raw, out: cells.lower(raw).eqNullSafe(out[0])),
    "upper": Transform(cells.upper, "one-way", lambda raw, out: cells.upper(raw).eqNullSafe(out[0])),
    "split_bp": Transform(split_pair, "reversible", lambda raw, out: F.coalesce(cells.eq_norm(raw, _pair_text(out)) & out[0].isNotNull(), F.lit(False)) | (cells.is_blank(raw) & out[0].isNull()), 2, _pair_text),
    "parse_reference_range": Transform(reference_range, "equivalence", _range_check, 2),
}
