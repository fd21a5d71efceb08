"""Finishing trips: fare, commission, earnings, wallet credit, payment due and ride state."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cabledger import schema
from cabledger.functions import money
from cabledger.functions.clock import moment
from cabledger.operators.deliveries import FORM, ledger, once
from cabledger.operators.forms import check_trip_completion, failed, passed
from cabledger.operators.pick import first_per_key
from cabledger.session import materialize
from cabledger.sources.sinks import insert_ignore, update_join, upsert

c = F.col


def rate_fares(trips: DataFrame, rides: DataFrame, fare_rules: DataFrame) -> DataFrame:
    """Fare of each finished trip: (base + km + minutes) x surge; default rates for rides without a rule.

    ``trips`` holds ride_id, distance and duration, one row per ride.
    """
    rules = fare_rules.select("rule_id", *money.DEFAULT_RATES)
    known = trips.select("ride_id", c("distance").cast("decimal(8,2)"), c("duration").cast("int")).join(
        rides.select("ride_id", "driver_id", "rider_id", "rule_id"), "ride_id")
    return known.join(rules, "rule_id", "left").select(
        "ride_id", "driver_id", "rider_id", "distance", "duration",
        money.fare(c("distance"), c("duration")).alias("fare"))


def split_commission(rated: DataFrame, share: Decimal = money.COMMISSION) -> DataFrame:
    """The platform's share of the full fare (before any discount) and what is left for the driver."""
    cut = rated.withColumn("commission", money.commission(c("fare"), share))
    return cut.withColumn("net_amount", money.money(c("fare") - c("commission")))


def finish_trips(forms: DataFrame, t: Mapping[str, DataFrame], as_of: str, applied: DataFrame | None = None) -> dict[str, DataFrame]:
    """The whole chain for finished trips, from the drivers' forms to all new tables.

    The rated trips feed five tables, so they are computed and written once. Forms with errors come
    back as ``rejected``, and so do good forms of a ride after its first (``repeated_form``): one request after the
    other, the first finishes the ride. A form delivered again has no effect and is not listed again. With the ledger
    ``applied`` of earlier runs that also holds across runs; without it a new form of a finished ride rates it again.
    """
    checked = materialize(check_trip_completion(once(forms, "trip_id", ["submitted_at"], applied)))
    good, repeated = first_forms(passed(checked), applied)
    good = materialize(good)
    rated = materialize(split_commission(rate_fares(good, t["rides"], t["fare_rules"])))
    return {
        "rated": rated,
        "rejected": failed(checked).unionByName(repeated).drop(FORM),
        "applied": ledger(checked, applied, good, "ride_id"),
        "driver_earnings": post_earnings(t["driver_earnings"], rated, as_of),
        "payments": open_payments(t["payments"], rated, as_of),
        "wallet": credit_wallets(t["wallet"], t["drivers"], rated, t["driver_earnings"]),
        **complete_rides(t["rides"], t["drivers"], t["ride_history"], rated, as_of),
    }


#: What decides between forms of one ride; the rest of the row parts equal ones.
FIRST = ["submitted_at", "trip_id"]


def first_form_per_ride(good: DataFrame) -> DataFrame:
    """The first good form of each ride by ``submitted_at``, then ``trip_id``, then the rest of the row; repeats don't matter."""
    rest = [n for n in good.columns if n not in ("ride_id", *FIRST)]
    return first_per_key(good, ["ride_id"], [*FIRST, *rest])


def first_forms(good: DataFrame, applied: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The first good form of each ride, and the others with their reason. Rides in the ledger have had their first form."""
    repeated = F.lit("repeated_form")
    done = []
    if applied is not None:
        rides = applied.select(c("subject").cast("bigint").alias("ride_id")).filter(c("ride_id").isNotNull()).distinct()
        done = [good.join(rides, "ride_id", "left_semi")]
        good = good.join(rides, "ride_id", "left_anti")
    kept = first_form_per_ride(good)
    others = [good.join(kept.select(FORM), FORM, "left_anti"), *done]
    return kept, reduce(DataFrame.unionByName, others).withColumn("reason", repeated)


def post_earnings(driver_earnings: DataFrame, rated: DataFrame, as_of: str) -> DataFrame:
    """One earning per ride; rating a ride again replaces the amounts, not the driver or payout state."""
    posted = rated.filter(c("driver_id").isNotNull()).select(
        c("ride_id").alias("earning_id"), "ride_id", "driver_id", c("fare").alias("gross_amount"), "commission",
        "net_amount", F.lit("pending").alias("payout_status"), moment(as_of).alias("earned_at"))
    return upsert(driver_earnings, posted, ["ride_id"], ["gross_amount", "commission", "net_amount"])


def open_payments(payments: DataFrame, rated: DataFrame, as_of: str) -> DataFrame:
    """A pending cash payment per rated ride; an existing payment only gets the new amount."""
    due = rated.select(
        c("ride_id").alias("payment_id"), "ride_id", "rider_id", c("fare").alias("amount"),
        F.lit("cash").alias("pay_method"), F.lit("pending").alias("pay_status"),
        money.money(F.lit(0)).alias("discount_appld"), moment(as_of).alias("transaction_date"))
    return upsert(payments, due, ["ride_id"], ["amount"])


def credit_wallets(wallet: DataFrame, drivers: DataFrame, rated: DataFrame, earnings_before: DataFrame) -> DataFrame:
    """Add each ride's net to its driver's wallet once; a ride rated again adds only the difference."""
    before = earnings_before.select("ride_id", c("net_amount").alias("_before"))
    change = c("net_amount") - F.coalesce("_before", money.money(F.lit(0)))
    per_driver = (rated.filter(c("driver_id").isNotNull()).join(before, "ride_id", "left")
                  .groupBy("driver_id").agg(F.sum(change).cast("decimal(20,2)").alias("credit")))
    per_user = per_driver.join(drivers.select("driver_id", "user_id"), "driver_id").select("user_id", "credit")
    return update_join(wallet, per_user, ["user_id"], {"balance": c("balance") + c("_d_credit")}, carry=["credit"])


def complete_rides(rides: DataFrame, drivers: DataFrame, ride_history: DataFrame, rated: DataFrame,
                   as_of: str) -> dict[str, DataFrame]:
    """Close rated rides, put their drivers online with the new trip counted once, archive the rides."""
    set_from = ["fare", "distance", "duration"]
    closed = update_join(
        rides, rated, ["ride_id"],
        {"status": F.lit("completed"), "completed_at": moment(as_of), **{n: c(f"_d_{n}") for n in set_from}},
        carry=set_from)
    # Each ride adds one trip, and only if it was not completed before.
    fresh = rated.select("ride_id").join(rides.select("ride_id", "driver_id", "status"), "ride_id").filter(
        c("driver_id").isNotNull())
    per_driver = fresh.groupBy("driver_id").agg(
        F.sum(F.when(c("status") != "completed", 1).otherwise(0)).cast("bigint").alias("trips"))
    online = update_join(drivers, per_driver, ["driver_id"],
                         {"avail_status": F.lit("online"), "total_trips": c("total_trips") + c("_d_trips")},
                         carry=["trips"])
    archive = rated.select("ride_id", F.lit("completed").alias("outcome"),
                           F.coalesce("fare", F.lit(0)).alias("final_fare"), moment(as_of).alias("archived_at"))
    return {"rides": closed, "drivers": online, "ride_history": insert_ignore(ride_history, archive, ["ride_id"])}


def count_completed_trips(rides: DataFrame, drivers: DataFrame) -> DataFrame:
    """Trips per driver counted anew from the rides, so that running it again changes nothing."""
    done = rides.filter((c("status") == "completed") & c("driver_id").isNotNull()).groupBy("driver_id").agg(
        F.count("ride_id").alias("_n"))
    counted = drivers.join(done, "driver_id", "left").withColumn(
        "total_trips", F.coalesce("_n", F.lit(0).cast("bigint")))
    return counted.select(*schema.names("drivers"))


def archive_cancelled(rides_old: DataFrame, rides_new: DataFrame, ride_history: DataFrame, as_of: str) -> DataFrame:
    """Archive rides that turned cancelled between two states of the table."""
    now = rides_new.filter(c("status") == "cancelled").select("ride_id", "fare")
    was = rides_old.filter(c("status") != "cancelled").select("ride_id")
    turned = now.join(was, "ride_id", "left_semi").select(
        "ride_id", F.lit("cancelled").alias("outcome"), F.coalesce("fare", F.lit(0)).alias("final_fare"),
        moment(as_of).alias("archived_at"))
    return insert_ignore(ride_history, turned, ["ride_id"])
