"""Changes to tables laid out by month that read and write only the months they touch.

The months are found first by a scan of the key columns alone, cut to the delta's key range, which sorted files
answer from few row groups. Only their list (some hundred values at most) comes to the driver. The changed months are then built by
the same functions that change whole tables, written once to the shared folder, and put in place with Spark's dynamic
partition overwrite. All other files keep their name and time. Readers see old or new files of a month, so switch them
over between runs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cabledger import schema
from cabledger.session import materialize
from cabledger.sources import sinks
from cabledger.sources.tables import MONTH_OF, append, by_month, load_tables


def _months(df: DataFrame) -> set[str]:
    return {r["month"] for r in df.select("month").distinct().collect()}


def _month(table: str) -> Column:
    return F.date_format(MONTH_OF[table], "yyyy-MM")


def months_of_keys(base: DataFrame, delta: DataFrame, keys: Sequence[str]) -> set[str]:
    """Months that hold a key of ``delta``; an equi-join on the keys, after a range filter that the files can answer."""
    first = keys[0]
    low, high = delta.agg(F.min(first), F.max(first)).first()
    if low is None:
        return set()
    near = base.select(*keys, "month").filter(F.col(first).between(low, high))
    return _months(near.join(delta.select(*keys), list(keys), "left_semi"))


def rewrite(spark: SparkSession, root: str, table: str, months: set[str], change: Callable[[DataFrame], DataFrame]) -> list[str]:
    """Apply ``change`` to the rows of ``months`` and put the months it touches in place; their names.

    Rows may move to another month, when a change sets the table's time; that month is then taken in as well. A month that
    loses its last row is left with an empty file.
    """
    base = load_tables(spark, root, [table])[table]

    def changed(of: set[str]) -> DataFrame:
        rows = base.filter(F.col("month").isin(sorted(of))).drop("month")
        return materialize(schema.conform(change(schema.conform(rows, table)), table).withColumn("month", _month(table)))
    new = changed(months)
    reached = _months(new)
    if not reached <= months:
        months = months | reached
        new = changed(months)
        reached = _months(new)
    laid = by_month(new, table)
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{root}/{table}")
    for empty in sorted(months - reached):
        new.drop("month").limit(0).write.mode("overwrite").parquet(f"{root}/{table}/month={empty}")
    return sorted(months)


def upsert(spark: SparkSession, root: str, table: str, delta: DataFrame, keys: Sequence[str], set_cols: Sequence[str],
           order: Sequence[str] | None = None) -> list[str]:
    """``sinks.upsert`` on the months that hold the delta's keys and those its new rows belong to."""
    delta = materialize(delta)
    base = load_tables(spark, root, [table])[table]
    held = months_of_keys(base, delta, keys)
    fresh = delta.join(base.filter(F.col("month").isin(sorted(held))).select(*keys), list(keys), "left_anti")
    months = held | _months(fresh.withColumn("month", _month(table)))
    return rewrite(spark, root, table, months, lambda part: sinks.upsert(part, delta, keys, set_cols, order))


def insert_ignore(spark: SparkSession, root: str, table: str, delta: DataFrame, keys: Sequence[str],
                  order: Sequence[str] | None = None) -> None:
    """``sinks.insert_ignore``: only new files are written, no old one is touched."""
    delta = materialize(delta)
    base = load_tables(spark, root, [table])[table]
    held = base.filter(F.col("month").isin(sorted(months_of_keys(base, delta, keys)))).drop("month")
    fresh = sinks.insert_ignore(schema.conform(held.limit(0), table), sinks.new_rows(held, delta, keys), keys, order)
    append(materialize(fresh), table, root)


def update_where(spark: SparkSession, root: str, table: str, condition: Column, values: Mapping[str, Column]) -> list[str]:
    """``sinks.update_where`` on the months with a row that meets the condition."""
    months = _months(load_tables(spark, root, [table])[table].filter(condition))
    return rewrite(spark, root, table, months, lambda part: sinks.update_where(part, condition, values))


def update_join(spark: SparkSession, root: str, table: str, other: DataFrame, on: Sequence[str], values: Mapping[str, Column],
                carry: Sequence[str] = ()) -> list[str]:
    """``sinks.update_join`` on the months that hold a partner of ``other``."""
    other = materialize(other)
    months = months_of_keys(load_tables(spark, root, [table])[table], other, on)
    return rewrite(spark, root, table, months, lambda part: sinks.update_join(part, other, on, values, carry))


def newest(spark: SparkSession, root: str, table: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows by ``order``, which must begin with the table's time, newest first.

    Months are read from the newest on, one, then two, then four more, until they hold ``k`` rows; older files are never opened.
    """
    base = load_tables(spark, root, [table])[table]
    months = sorted(_months(base), reverse=True)
    taken = 1
    while True:
        rows = base.filter(F.col("month").isin(months[:taken])).drop("month")
        if taken >= len(months) or rows.limit(k).count() >= k:
            return rows.orderBy(*order).limit(k)
        taken *= 2
