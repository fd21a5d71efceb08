"""How values are shown on pages: amounts with fixed places and days."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fixed(c: Column, places: int = 2) -> Column:
    """A number as text with a fixed number of decimals, 0 when missing."""
    return F.coalesce(c, F.lit(0)).cast(f"decimal(30,{places})").cast("string")


def rupees(c: Column) -> Column:
    return F.concat(F.lit("Rs. "), fixed(c))


def day(c: Column) -> Column:
    """Month/day/year without leading zeros."""
    return F.date_format(c, "M/d/yyyy")
