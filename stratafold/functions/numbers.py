"""Numeric column expressions whose rounding and null rules are fixed."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the number texts that count as numbers; everything else is missing.
NUMBER_TEXT = r"^[+-]?(((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)|([iI][nN][fF]([iI][nN][iI][tT][yY])?))$"
_BLANKS = " \t\n\r\x0b\x0c"


def parse_number(column: Column) -> Column:
    """Double value of a number or number text; null where it is neither."""
    text = F.btrim(column.cast("string"), F.lit(_BLANKS))
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def floor_mod(value: Column, base: int) -> Column:
    """Remainder with the sign of ``base`` (−3 mod 12 is 9)."""
    return F.pmod(value, F.lit(base))


def floor_div(value: Column, base: int) -> Column:
    """Quotient rounded towards minus infinity."""
    return (value - floor_mod(value, base)) / F.lit(base)


def half_even(value: Column, unit: int) -> Column:
    """Nearest multiple of ``unit``; halves go to the even multiple."""
    return F.rint(value / F.lit(unit)) * F.lit(unit)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, null where the denominator is zero."""
    return F.when(denominator != 0, numerator / denominator)


def as_feature(value: Column) -> Column:
    """Single-precision value, the storage type of every feature."""
    return value.cast("float")
