"""Money reports: revenue by city and method, date ranges, payouts and earnings.

``t`` maps table names to DataFrames. Facts are summed per id before they meet a dimension, so a key with
a large share of the rows is combined in the map tasks and never travels row by row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from cabledger.functions.clock import rows_in_range
from cabledger.functions.display import fixed, rupees
from cabledger.functions.money import total
from cabledger.operators.joins import with_pickup_city
from cabledger.operators.regions import merge_cities

Tables = Mapping[str, DataFrame]


def _paid_by_city(t: Tables) -> DataFrame:
    """Paid rides per pickup city: ``rides`` and ``revenue``."""
    paid = t["payments"].filter(F.col("pay_status") == "paid").select("ride_id", "amount")
    fares = paid.join(t["rides"].select("ride_id", "pickup_location_id"), "ride_id")
    per_place = fares.groupBy("pickup_location_id").agg(
        F.count("ride_id").alias("rides"), F.sum("amount").cast("decimal(20,2)").alias("revenue"))
    placed = with_pickup_city(per_place, t["locations"])
    return merge_cities(
        placed,
        {"rides": F.sum("rides"), "revenue": F.sum("revenue")},
        {"rides": F.sum("rides"), "revenue": total("revenue")})


def revenue_by_city_avg(t: Tables) -> DataFrame:
    """Paid rides, revenue and mean payment per pickup city."""
    return _paid_by_city(t).select(
        "city", F.col("rides").alias("total_rides"), F.col("revenue").alias("total_revenue"),
        F.round(F.col("revenue") / F.col("rides"), 6).cast("decimal(14,6)").alias("avg_fare"))


def revenue_per_city(t: Tables) -> DataFrame:
    """Paid revenue and rides per pickup city, highest first."""
    return _paid_by_city(t).select(
        "city", F.col("revenue").alias("total_revenue"), F.col("rides").alias("total_rides"),
    ).orderBy(F.desc("total_revenue"), "city")


def top_cities(t: Tables, k: int = 10) -> DataFrame:
    """The ``k`` cities with the most paid revenue."""
    return _paid_by_city(t).select("city", "revenue", "rides").orderBy(F.desc("revenue"), "city").limit(k)


def revenue_by_method(t: Tables) -> DataFrame:
    """Paid revenue and payments per payment method."""
    paid = t["payments"].filter(F.col("pay_status") == "paid")
    return paid.groupBy("pay_method").agg(total("amount").alias("total"), F.count(F.lit(1)).alias("count"))


def chart_series(report: DataFrame, label: str, value: str) -> DataFrame:
    """A small report as one row of JSON arrays, in the report's order, as a chart takes it."""
    points = report.agg(F.collect_list(F.struct(
        F.col(label).alias("label"), fixed(F.col(value)).alias("value"))).alias("p"))
    return points.select(F.to_json("p.label").alias("labels"), F.to_json("p.value").alias("data"))


def earnings_page(t: Tables, id: int | None = None) -> DataFrame:
    """Totals per driver as the page shows them."""
    shown = driver_totals(t, id)
    return shown.select("driver_id", *[rupees(F.col(n)).alias(n) for n in
                                       ("total_gross", "total_commission", "total_net")], "total_rides")


def _range_total(t: Tables, status: str, date_from: str, date_to: str, half_open: bool) -> DataFrame:
    hit = rows_in_range(t["payments"], "transaction_date", date_from, date_to, half_open).filter(
        F.col("pay_status") == status)
    return hit.agg(total("amount").alias("total"), F.count(F.lit(1)).alias("count"))


def revenue_in_range(t: Tables, date_from: str, date_to: str, half_open: bool = False) -> DataFrame:
    """Sum and count of paid payments; the midnight after the last day counts unless ``half_open``."""
    return _range_total(t, "paid", date_from, date_to, half_open)


def refunds_in_range(t: Tables, date_from: str, date_to: str, half_open: bool = False) -> DataFrame:
    return _range_total(t, "refunded", date_from, date_to, half_open)


def driver_earnings_in_range(t: Tables, date_from: str, date_to: str, half_open: bool = False) -> DataFrame:
    """Gross, commission, net and trips per driver, highest gross first."""
    hit = rows_in_range(t["driver_earnings"], "earned_at", date_from, date_to, half_open)
    per_driver = hit.groupBy("driver_id").agg(
        total("gross_amount").alias("gross"), total("commission").alias("commission"),
        total("net_amount").alias("net"), F.count("earning_id").alias("trips"))
    named = per_driver.join(t["drivers"].select("driver_id", "user_id"), "driver_id").join(
        t["users"].select("user_id", "full_name"), "user_id")
    return named.orderBy(F.desc("gross"), "driver_id").select("full_name", "gross", "commission", "net", "trips")


def admin_kpis(t: Tables) -> DataFrame:
    """Users, drivers, rides and paid revenue in one row."""
    def one(table: str, count: str) -> DataFrame:
        return t[table].agg(F.count(F.lit(1)).alias("n")).select(F.lit(count).alias("what"), "n",
                                                                 F.lit(None).cast("decimal(20,2)").alias("money"))
    revenue = t["payments"].filter(F.col("pay_status") == "paid").agg(total("amount").alias("money")).select(
        F.lit("revenue").alias("what"), F.lit(None).cast("bigint").alias("n"), "money")
    facts = one("users", "users").unionByName(one("drivers", "drivers")).unionByName(
        one("rides", "rides")).unionByName(revenue)

    def pick(what: str, column: str):
        return F.max(F.when(F.col("what") == what, F.col(column)))
    return facts.agg(
        pick("users", "n").alias("total_users"), pick("drivers", "n").alias("total_drivers"),
        pick("rides", "n").alias("total_rides"),
        F.coalesce(pick("revenue", "money"), F.lit(0)).cast("decimal(20,2)").alias("total_revenue"))


def pending_payouts(t: Tables) -> DataFrame:
    """Drivers with earnings waiting for payout, and their wallet, largest sum first."""
    waiting = t["driver_earnings"].filter(F.col("payout_status") == "pending").groupBy("driver_id").agg(
        F.count("earning_id").alias("pending_count"), total("net_amount").alias("pending_total"))
    wallet = t["wallet"].select("user_id", F.col("balance").alias("wallet_balance"),
                                F.col("payout_status").alias("wallet_payout_status"), "last_payout_date")
    named = (waiting.join(t["drivers"].select("driver_id", "user_id"), "driver_id")
             .join(t["users"].select("user_id", "full_name", "email"), "user_id").join(wallet, "user_id"))
    return named.select(
        "driver_id", "full_name", "email", "wallet_balance", "wallet_payout_status", "last_payout_date",
        "pending_count", "pending_total").orderBy(F.desc("pending_total"), "driver_id")


def _for_driver(df: DataFrame, id: int | None) -> DataFrame:
    return df if id is None else df.filter(F.col("driver_id") == id)


def driver_totals(t: Tables, id: int | None = None) -> DataFrame:
    """Lifetime gross, commission, net and rides per driver."""
    return _for_driver(t["driver_earnings"], id).groupBy("driver_id").agg(
        total("gross_amount").alias("total_gross"), total("commission").alias("total_commission"),
        total("net_amount").alias("total_net"), F.count(F.lit(1)).alias("total_rides"))


def driver_pending_summary(t: Tables, id: int | None = None) -> DataFrame:
    """Earnings not paid out yet, per driver."""
    waiting = _for_driver(t["driver_earnings"], id).filter(F.col("payout_status") == "pending")
    return waiting.groupBy("driver_id").agg(
        F.count(F.lit(1)).alias("pending_count"), total("net_amount").alias("pending_total"))


def wallet_balance(t: Tables, id: int | None = None) -> DataFrame:
    """Wallet of each user."""
    wallet = t["wallet"] if id is None else t["wallet"].filter(F.col("user_id") == id)
    known = wallet.join(t["users"].select("user_id"), "user_id", "left_semi")
    return known.select("user_id", "balance", "payout_status", "last_payout_date")
