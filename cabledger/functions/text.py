"""Text comparison, trimming and format tests used by joins and form checks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Text keys compare without regard to case, accents and trailing blanks.
COLLATION = "UNICODE_CI_AI_RTRIM"
BLANKS = " \t\n\r\f\v ﻿"

# The formats that form fields must meet. The very end is meant, not a line feed before it.
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+\z"
PHONE = r"^03[0-9]{9}\z"
CNIC_DASHED = r"^\d{5}-\d{7}-\d{1}\z"
CNIC_PLAIN = r"^\d{13}\z"
PLATE = r"^[A-Z]{2,4}[-\s]?\d{3,4}\z"
PROMO_CODE = r"^[A-Za-z0-9]+\z"


def folded(c: Column) -> Column:
    return F.collate(c, COLLATION)


def unfolded(c: Column) -> Column:
    return F.collate(c, "UTF8_BINARY")


def same_text(a: Column, b: Column) -> Column:
    return folded(a) == folded(b)


def trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def blank(c: Column) -> Column:
    """True for a form field that is missing or holds no characters."""
    return c.isNull() | (c == "")


def shorter_than(c: Column, n: int) -> Column:
    return F.coalesce(F.length(trimmed(c)), F.lit(0)) < n


def fails(c: Column, pattern: str) -> Column:
    return ~F.coalesce(c.rlike(pattern), F.lit(False))


def valid_phone(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, r"[-\s]", "").rlike(PHONE), F.lit(False))


def valid_cnic(c: Column) -> Column:
    plain = F.regexp_replace(c, "-", "").rlike(CNIC_PLAIN)
    return F.coalesce(c.rlike(CNIC_DASHED) | plain, F.lit(False))


def valid_plate(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.upper(c), r"\s", "-").rlike(PLATE), F.lit(False))


def number(c: Column) -> Column:
    """A form field as a decimal; NULL when it is not a plain number."""
    return trimmed(c).try_cast("decimal(18,4)")


def whole(c: Column) -> Column:
    return F.when(trimmed(c).rlike(r"^[+-]?\d+\z"), trimmed(c).try_cast("bigint"))
