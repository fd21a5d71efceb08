"""Column helpers shared by the text operators."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, functions as F


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other letter as it is; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def text_key(text: Column) -> Column:
    """A 128-bit key of a whole text (MD5), so that equal texts are handled once; null counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
