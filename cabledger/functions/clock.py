"""Points in time and date ranges, always passed in and never read from the clock."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F


def moment(as_of: str | datetime) -> Column:
    return F.lit(str(as_of)).cast("timestamp_ntz")


def default_range(as_of: str | datetime) -> tuple[str, str]:
    """The last thirty days up to ``as_of``, as dates."""
    last = datetime.fromisoformat(str(as_of)).date()
    return str(last - timedelta(days=30)), str(last)


def in_range(c: Column, date_from: str | date, date_to: str | date, half_open: bool = False) -> Column:
    """From the first day up to the midnight after the last day.

    That midnight itself counts, as in the reports this reproduces, unless ``half_open`` is set.
    """
    start = moment(f"{date_from} 00:00:00" if len(str(date_from)) == 10 else date_from)
    end = moment(datetime.fromisoformat(str(date_to)) + timedelta(days=1))
    return (c >= start) & ((c < end) if half_open else (c <= end))


def rows_in_range(df: DataFrame, column: str, date_from: str | date, date_to: str | date,
                  half_open: bool = False) -> DataFrame:
    """Rows within the range; of a table laid out by month only those months are read."""
    hit = in_range(F.col(column), date_from, date_to, half_open)
    if "month" in df.columns:
        end = datetime.fromisoformat(str(date_to)) + timedelta(days=1)
        hit = hit & F.col("month").between(str(date_from)[:7], str(end)[:7])
    return df.filter(hit)
