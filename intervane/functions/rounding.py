"""The two rounding modes: bins and quality round halves to even, printed timecodes away from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column) -> Column:
    return F.rint(x)


def half_even_2(x: Column) -> Column:
    """Two decimals, halves to even, on the binary value."""
    return F.rint(x * 100) / 100


def half_away(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x) + F.lit(0.5))


def bind(value: Column, then) -> Column:
    """then(value) with value computed once: it is held by a lambda variable, where a plain expression would be copied to each use."""
    return F.element_at(F.transform(F.array(value), then), 1)
