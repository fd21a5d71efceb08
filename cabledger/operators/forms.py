"""Checks of form input (text fields as sent in).

Each check keeps every row and adds ``errors`` (codes of all rules the row breaks, in rule order) and
``first_error`` (NULL on a clean row). All rules are column expressions evaluated in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cabledger import schema
from cabledger.functions import text as tx
from cabledger.functions.clock import moment

Rules = list[tuple[str, Column]]
c = F.col


def with_errors(df: DataFrame, rules: Rules) -> DataFrame:
    found = F.filter(F.array(*[F.when(bad, code) for code, bad in rules]), lambda e: e.isNotNull())
    return df.withColumn("errors", found).withColumn("first_error", F.get("errors", F.lit(0)))


def passed(df: DataFrame) -> DataFrame:
    return df.filter(c("first_error").isNull()).drop("errors", "first_error")


def failed(df: DataFrame) -> DataFrame:
    """Rows that broke a rule, with the first broken one as ``reason``."""
    return df.filter(c("first_error").isNotNull()).withColumn("reason", c("first_error")).drop("errors", "first_error")


def _not_in(column: str, words: list[str]) -> Column:
    return ~F.coalesce(c(column).isin(words), F.lit(False))


def _below(value: Column, least) -> Column:
    """Missing, not a number, or under ``least``."""
    return F.coalesce(value < least, F.lit(True))


def _above(value: Column, most) -> Column:
    return F.coalesce(value > most, F.lit(False))


def _not_positive(value: Column) -> Column:
    return F.coalesce(value <= 0, F.lit(True))


def check_registration(forms: DataFrame) -> DataFrame:
    """New account; drivers also need an identity card and a licence number."""
    driver = F.coalesce(c("role") == "driver", F.lit(False))
    return with_errors(forms, [
        ("full_name_too_short", tx.shorter_than(c("full_name"), 3)),
        ("email_invalid", tx.fails(c("email"), tx.EMAIL)),
        ("phone_invalid", ~tx.valid_phone(c("phone"))),
        ("role_invalid", _not_in("role", schema.RATER_ROLES)),
        ("cnic_invalid", driver & ~tx.valid_cnic(c("cnic"))),
        ("license_too_short", driver & tx.shorter_than(c("license_num"), 5)),
    ])


def check_booking(forms: DataFrame, as_of: str) -> DataFrame:
    """Ride booking: both ends named and different, known vehicle type, no past schedule."""
    def same(a: str, b: str) -> Column:
        return F.coalesce(F.lower(tx.trimmed(c(a))) == F.lower(tx.trimmed(c(b))), F.lit(False))
    return with_errors(forms, [
        ("pickup_address_too_short", tx.shorter_than(c("pickup_address"), 3)),
        ("pickup_city_too_short", tx.shorter_than(c("pickup_city"), 2)),
        ("dropoff_address_too_short", tx.shorter_than(c("dropoff_address"), 3)),
        ("dropoff_city_too_short", tx.shorter_than(c("dropoff_city"), 2)),
        ("ends_identical", same("pickup_address", "dropoff_address") & same("pickup_city", "dropoff_city")),
        ("vehicle_type_invalid", _not_in("vehicle_type", schema.VEHICLE_TYPES)),
        ("schedule_not_in_future",
         F.coalesce(c("scheduled_at").try_cast("timestamp_ntz") <= moment(as_of), F.lit(False))),
    ])


def check_trip_completion(forms: DataFrame) -> DataFrame:
    """Distance up to 500 km and duration up to 600 minutes, both positive."""
    km, minutes = tx.number(c("distance")), tx.whole(c("duration"))
    return with_errors(forms, [
        ("distance_not_positive", _not_positive(km)),
        ("distance_too_long", _above(km, 500)),
        ("duration_not_positive", _not_positive(minutes)),
        ("duration_too_long", _above(minutes, 600)),
    ])


def check_vehicle(forms: DataFrame, as_of: str) -> DataFrame:
    """New vehicle, built between 2000 and the current year."""
    year = tx.whole(c("year"))
    return with_errors(forms, [
        ("make_too_short", tx.shorter_than(c("make"), 2)),
        ("model_missing", tx.shorter_than(c("model"), 1)),
        ("year_out_of_range", _below(year, 2000) | _above(year, F.year(moment(as_of)))),
        ("color_too_short", tx.shorter_than(c("color"), 2)),
        ("plate_too_short", tx.shorter_than(c("license_plate"), 4)),
        ("vehicle_type_invalid", _not_in("vehicle_type", schema.VEHICLE_TYPES)),
    ])


def check_topup(forms: DataFrame) -> DataFrame:
    """Wallet top-up between 100 and 50,000."""
    amount = tx.number(c("amount"))
    return with_errors(forms, [
        ("amount_invalid", amount.isNull()),
        ("amount_too_small", F.coalesce(amount < 100, F.lit(False))),
        ("amount_too_large", _above(amount, 50000)),
    ])


def check_fare_rule(forms: DataFrame) -> DataFrame:
    surge = tx.number(c("surge_multi"))
    return with_errors(forms, [
        ("city_too_short", tx.shorter_than(c("city"), 2)),
        ("vehicle_type_invalid", _not_in("vehicle_type", schema.VEHICLE_TYPES)),
        ("base_rate_not_positive", _not_positive(tx.number(c("base_rate")))),
        ("per_km_rate_not_positive", _not_positive(tx.number(c("per_km_rate")))),
        ("per_min_rate_not_positive", _not_positive(tx.number(c("per_min_rate")))),
        ("surge_below_one", F.coalesce(surge < 1, F.lit(False))),
    ])


def check_promo(forms: DataFrame) -> DataFrame:
    start, end = c("valid_from").try_cast("timestamp_ntz"), c("valid_until").try_cast("timestamp_ntz")
    pct = tx.number(c("discount_pct"))
    return with_errors(forms, [
        ("code_too_short", tx.shorter_than(c("code"), 3)),
        ("code_not_alphanumeric", tx.fails(tx.trimmed(c("code")), tx.PROMO_CODE)),
        ("discount_out_of_range", _below(pct, 1) | _above(pct, 100)),
        ("usage_limit_below_one", _below(tx.whole(c("usage_limit")), 1)),
        ("valid_from_missing", tx.blank(c("valid_from"))),
        ("valid_until_missing", tx.blank(c("valid_until"))),
        ("dates_not_ordered", F.coalesce(end <= start, F.lit(False))),
    ])


def check_rating(forms: DataFrame) -> DataFrame:
    score = tx.whole(c("score"))
    return with_errors(forms, [
        ("score_out_of_range", _below(score, 1) | _above(score, 5)),
        ("target_missing", c("rated_user_id").isNull()),
    ])


def check_plate_format(vehicles: DataFrame) -> DataFrame:
    """Two to four letters, then three or four digits."""
    return with_errors(vehicles, [("plate_format", ~tx.valid_plate(c("license_plate")))])
