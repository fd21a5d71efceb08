"""Daily sums of payments that reports merge, kept by (day, city, method, state).

``refresh`` builds the sums of the days a change touches, from the payments of just those days, and replaces them; the reports
read some rows per day instead of the payments. ``midnight`` parts the payments of a day's first instant, which a range that ends
the day before counts as well. Cities are kept by place spelling and merged in the reports.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from cabledger.functions.money import total
from cabledger.operators.regions import merge_cities
from cabledger.session import materialize

c = F.col
KEY = ["day", "midnight", "city", "pay_method", "pay_status"]
DAILY = ("day DATE, midnight BOOLEAN, city STRING, pay_method STRING, pay_status STRING, n BIGINT, amount DECIMAL(20,2), month STRING")


def daily_sums(t: Mapping[str, DataFrame]) -> DataFrame:
    """Payments per day, place and method, summed per place before the city is added."""
    rides = t["rides"].select("ride_id", "pickup_location_id")
    per_place = (t["payments"].withColumns({
        "day": c("transaction_date").cast("date"), "midnight": c("transaction_date") == c("transaction_date").cast("date").cast("timestamp_ntz")})
        .join(rides, "ride_id", "left").groupBy("day", "midnight", "pickup_location_id", "pay_method", "pay_status")
        .agg(F.count(F.lit(1)).alias("n"), total("amount").alias("amount")))
    cities = t["locations"].select(c("location_id").alias("pickup_location_id"), "city")
    return per_place.join(cities, "pickup_location_id", "left").groupBy(*KEY).agg(F.sum("n").alias("n"), total("amount").alias("amount"))


def refresh(spark: SparkSession, root: str, t: Mapping[str, DataFrame], days: DataFrame | None = None) -> None:
    """Replace the sums of ``days`` (column ``day``; all if None) under ``root`` by those of the payments of these days.

    A day that a payment left, by a correction of its time, must be among the days as well as the one it went to.
    """
    sums = daily_sums(t).withColumn("month", F.date_format("day", "yyyy-MM"))
    if days is None:
        sums.write.mode("overwrite").partitionBy("month").parquet(root)
        return
    days = materialize(days.select(c("day").cast("date").alias("day")).filter(c("day").isNotNull()).distinct())
    asked = sorted(r["month"] for r in days.select(F.date_format("day", "yyyy-MM").alias("month")).distinct().collect())
    first, last = days.agg(F.min("day"), F.max("day")).first()
    near = t["payments"].filter((c("transaction_date") >= F.lit(first).cast("timestamp_ntz"))
                                & (c("transaction_date") < F.date_add(F.lit(last), 1).cast("timestamp_ntz")))
    touched = near.join(F.broadcast(days), near.transaction_date.cast("date") == days.day, "left_semi")
    fresh = daily_sums({"payments": touched, "rides": t["rides"], "locations": t["locations"]}).withColumn("month", F.date_format("day", "yyyy-MM"))
    kept = load(spark, root).filter(c("month").isin(asked)).join(F.broadcast(days), "day", "left_anti")
    new = materialize(kept.select(*fresh.columns).unionByName(fresh))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(root)
    left = {r["month"] for r in new.select("month").distinct().collect()}
    for month in asked:
        if month not in left:
            new.drop("month").limit(0).write.mode("overwrite").parquet(f"{root}/month={month}")


def load(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(DAILY).parquet(root)


def in_range(sums: DataFrame, date_from: str, date_to: str, status: str, half_open: bool = False) -> DataFrame:
    """Sum and count of payments in a state; the midnight after the last day counts unless ``half_open``."""
    low, high = F.lit(date_from).cast("date"), F.lit(date_to).cast("date")
    months = c("month").between(F.date_format(low, "yyyy-MM"), F.date_format(F.date_add(high, 1), "yyyy-MM"))
    within = c("day").between(low, high)
    hit = within if half_open else within | ((c("day") == F.date_add(high, 1)) & c("midnight"))
    return sums.filter(months & hit & (c("pay_status") == status)).agg(
        total("amount").alias("total"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("count"))


def per_city(sums: DataFrame) -> DataFrame:
    """Paid revenue and rides per pickup city, highest first."""
    paid = sums.filter((c("pay_status") == "paid") & c("city").isNotNull()).select("city", "n", "amount")
    merged = merge_cities(paid, {"n": F.sum("n"), "amount": F.sum("amount")}, {"n": F.sum("n"), "amount": total("amount")})
    return merged.select("city", c("amount").alias("total_revenue"), c("n").alias("total_rides")).orderBy(F.desc("total_revenue"), "city")


def by_method(sums: DataFrame) -> DataFrame:
    """Paid revenue and payments per payment method."""
    paid = sums.filter(c("pay_status") == "paid")
    return paid.groupBy("pay_method").agg(total("amount").alias("total"), F.sum("n").alias("count"))
