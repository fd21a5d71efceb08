"""Decimal arithmetic for fares, commissions and discounts (rounds half up)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

# Rates used for a ride whose city and type have no fare rule, and the platform share.
DEFAULT_RATES = {
    "base_rate": Decimal("50.00"),
    "per_km_rate": Decimal("20.00"),
    "per_min_rate": Decimal("2.00"),
    "surge_multi": Decimal("1.00"),
}
COMMISSION = Decimal("0.20")


def money(c: Column) -> Column:
    return c.cast("decimal(10,2)")


def total(column: Column | str) -> Column:
    """Sum of a money column, wide enough for any table and of one fixed type."""
    return F.sum(column).cast("decimal(20,2)")


def rate(name: str) -> Column:
    """A fare rule's rate, or the default where the ride has no rule."""
    kind = "decimal(4,2)" if name == "surge_multi" else "decimal(8,2)"
    return F.coalesce(F.col(name), F.lit(DEFAULT_RATES[name]).cast(kind))


def fare(distance: Column, duration: Column) -> Column:
    metered = rate("base_rate") + rate("per_km_rate") * distance + rate("per_min_rate") * duration
    return money(metered * rate("surge_multi"))


def commission(fare_col: Column, share: Decimal = COMMISSION) -> Column:
    return money(F.round(fare_col * F.lit(share), 2))


def discount(fare_col: Column, pct: Column) -> Column:
    return money(F.round(fare_col * pct * F.lit(Decimal("0.01")), 2))


def after_discount(fare_col: Column, off: Column) -> Column:
    return money(F.greatest(F.lit(Decimal("0.00")), fare_col - off))
