"""Running values along an order within a key, also for keys too large for one task.

A window sends all rows of a key to one task. That is fine for ordinary keys, so those use it. Keys with
more than ``hot_rows`` rows (found by a pre-aggregated count) are cut into chunks instead: their rows are
range-partitioned by key and order, each range becomes a chunk, and the value at a row is the value
carried into its chunk plus the value inside it. Carried values come from one small row per chunk.
The chunk numbers are written to the shared folder first, because both passes must see the same ones even if a
task is redone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cabledger.session import materialize

HOT_ROWS = 2_000_000
CHUNK = "_chunk"


def split_hot(df: DataFrame, keys: Sequence[str], hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and rows of hot keys (None when there are none)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = materialize(counts.filter(F.col("_n") > hot_rows).select(*keys))
    if hot.isEmpty():
        return df, None
    return df.join(hot, list(keys), "left_anti"), df.join(hot, list(keys), "left_semi")


def cut_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Even, ordered chunks over (key, order), numbered and fixed."""
    ranged = df.repartitionByRange(*keys, *order)
    return materialize(ranged.withColumn(CHUNK, F.spark_partition_id()))


def carried_in(chunks: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Per key and chunk, the sum of ``value`` over all earlier chunks of the key (column ``_before``)."""
    sums = chunks.groupBy(*keys, CHUNK).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, CHUNK, F.sum("_sum").over(earlier).alias("_before"))


def chunk_running_sum(chunks: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column,
                      out: str) -> DataFrame:
    inside = (Window.partitionBy(*keys, CHUNK).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = F.sum(value).over(inside)
    before = carried_in(chunks, keys, value)
    return (chunks.join(before, [*keys, CHUNK])
            .withColumn(out, F.coalesce(F.col("_before") + within, within)).drop("_before"))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, out: str,
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Running total per key including the row itself; ``order`` must end in a unique column."""
    cold, hot = split_hot(df, keys, hot_rows)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    result = cold.withColumn(out, F.sum(value).over(w))
    if hot is None:
        return result
    chunks = cut_chunks(hot, keys, order)
    kind = result.schema[out].dataType
    spread = chunk_running_sum(chunks, keys, order, value, out).withColumn(out, F.col(out).cast(kind))
    return result.unionByName(spread.select(*result.columns))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str,
             hot_rows: int = HOT_ROWS) -> DataFrame:
    """Row number per key, from 1."""
    return running_sum(df, keys, order, F.lit(1).cast("bigint"), out, hot_rows)


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, out: str,
             hot_rows: int = HOT_ROWS) -> DataFrame:
    """The value of ``column`` in the row before, NULL in a key's first row."""
    cold, hot = split_hot(df, keys, hot_rows)
    w = Window.partitionBy(*keys).orderBy(*order)
    result = cold.withColumn(out, F.lag(column).over(w))
    if hot is None:
        return result
    chunks = cut_chunks(hot, keys, order)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    last = (chunks.groupBy(*keys, CHUNK).agg(F.max_by(column, F.struct(*order)).alias("_last"))
            .select(*keys, CHUNK, F.lag("_last").over(across).alias("_carried")))
    spread = (chunks.withColumn("_rn", F.row_number().over(inside))
              .withColumn("_lag", F.lag(column).over(inside))
              .join(last, [*keys, CHUNK])
              .withColumn(out, F.when(F.col("_rn") == 1, F.col("_carried")).otherwise(F.col("_lag"))))
    return result.unionByName(spread.select(*result.columns))
