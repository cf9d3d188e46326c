"""Small helpers shared by the column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MONEY_TYPE = "decimal(18,2)"


def money(c: Column) -> Column:
    return c.cast(MONEY_TYPE)


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def text(c: Column) -> Column:
    """NULL as the empty string, trimmed."""
    return F.trim(F.coalesce(c, F.lit("")))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def zero_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def first_filled(*cols: Column) -> Column:
    """First value that is neither NULL nor blank (strings)."""
    return F.coalesce(*[F.when(F.length(F.trim(c)) > 0, c) for c in cols])


def first_nonzero(*cols: Column) -> Column:
    """First value that is neither NULL nor 0 (numbers)."""
    return F.coalesce(*[zero_to_null(c) for c in cols])


def flags_array(*pairs: tuple[Column, Column]) -> Column:
    """Array of the values whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, value) for cond, value in pairs]))


def any_contains(c: Column, needles) -> Column:
    """True when the column holds one of the literal needles."""
    cond = F.lit(False)
    for needle in needles:
        cond = cond | c.contains(needle)
    return cond
