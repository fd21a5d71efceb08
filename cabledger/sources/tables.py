"""Read and write the marketplace tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from cabledger import schema

# Fact tables and the time column their files are split by.
MONTH_OF = {
    "rides": "created_at", "payments": "transaction_date", "driver_earnings": "earned_at",
    "ratings": "rated_at", "ride_history": "archived_at",
}


def load_tables(spark: SparkSession, root: str, tables: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """Parquet tables under ``root`` with their declared schemas (no footer inference).

    Tables laid out by month also show the column ``month``, which range reports filter on.
    """
    return {
        name: spark.read.schema(schema.struct(name)).parquet(f"{root}/{name}")
        for name in (tables or schema.COLUMNS)
    }


def load_jdbc(spark: SparkSession, url: str, table: str, lower: int, upper: int, partitions: int,
              **options: str) -> DataFrame:
    """A live table, read in parallel over ranges of its primary key."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=schema.PRIMARY_KEY[table],
        lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions), **options)
    return schema.conform(reader.load(), table)


def append(df: DataFrame, table: str, root: str) -> None:
    """Add rows to a table; fact tables are laid out by month and sorted by key within each file.

    Month folders and the min/max of the sorted keys let later scans skip most files and row groups.
    """
    out = schema.conform(df, table)
    if table in MONTH_OF:
        by_month(out, table).write.mode("append").partitionBy("month").parquet(f"{root}/{table}")
    else:
        out.write.mode("append").parquet(f"{root}/{table}")


def by_month(df: DataFrame, table: str) -> DataFrame:
    """Rows with their ``month``, ready to be laid out: AQE splits a large month over several tasks and joins small ones."""
    out = df.withColumn("month", F.date_format(MONTH_OF[table], "yyyy-MM"))
    return out.hint("rebalance", "month").sortWithinPartitions("month", schema.PRIMARY_KEY[table])


def save_tables(tables: Mapping[str, DataFrame], root: str) -> None:
    """Write a complete new snapshot; readers move over to ``root`` once it is complete."""
    for name, df in tables.items():
        schema.conform(df, name).write.mode("errorifexists").parquet(f"{root}/{name}")


# Facts that are joined with each other on the ride.
BUCKETED_BY_RIDE = ["rides", "payments", "driver_earnings", "ride_history", "ratings"]


def save_bucketed(tables: Mapping[str, DataFrame], prefix: str, buckets: int) -> None:
    """Catalog tables bucketed and sorted by ride, so that joins between them need no shuffle."""
    for name in BUCKETED_BY_RIDE:
        if name in tables:
            # One task per bucket, or every task would write a file into every bucket.
            out = schema.conform(tables[name], name).repartition(buckets, "ride_id")
            out.write.bucketBy(buckets, "ride_id").sortBy("ride_id").mode("errorifexists").saveAsTable(f"{prefix}{name}")


def load_bucketed(spark: SparkSession, prefix: str) -> dict[str, DataFrame]:
    return {name: spark.table(f"{prefix}{name}") for name in BUCKETED_BY_RIDE
            if spark.catalog.tableExists(f"{prefix}{name}")}
