"""Python-style number formats as JVM column expressions (half-even, like str.format)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money0(x: Column) -> Column:
    """``{:,.0f}``: no decimals, thousands separators."""
    return F.format_number(x, 0)


def one_decimal(x: Column) -> Column:
    """``{:.1f}``: one decimal, no separators (the pattern form keeps half-even rounding)."""
    return F.call_function("format_number", x, F.lit("0.0"))


def no_decimal(x: Column) -> Column:
    """``{:.0f}``."""
    return F.call_function("format_number", x, F.lit("0"))


def percent1(x: Column) -> Column:
    """``{:.1%}``."""
    return F.concat(one_decimal(x * F.lit(100.0)), F.lit("%"))
