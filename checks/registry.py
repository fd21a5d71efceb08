"""Every registered query: name -> function of (session, input folder)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from cabledger import schema
from cabledger.functions.clock import moment
from cabledger.operators import constraints, forms
from cabledger.operators.deliveries import FORM
from cabledger.operators.joins import with_pickup_city
from cabledger.plans import (accounts, daily, dispatch, fares, feedback, payments, people, promos, revenue, trips,
                             wallets)
from cabledger.session import materialize, shared_dir
from cabledger.sources import monthly, sinks
from cabledger.sources.star import AS_OF, DAMAGE, star_tables
from cabledger.sources.tables import append, load_tables, save_tables
from checks.delivery_queries import delivery_queries
from checks.stream_queries import stream_queries

Query = Callable[[SparkSession, str], DataFrame]
MONTH = ("1997-01-01", "1997-01-30")


def _on_tables(report, *args, **kwargs) -> Query:
    return lambda spark, sf_dir: report(star_tables(spark, sf_dir), *args, **kwargs)


def report_queries() -> dict[str, Query]:
    plain = [
        trips.active_rides, trips.full_trip_report, trips.recent_rides, trips.payment_promo_history,
        trips.rider_completed_rides, trips.rider_recent_rides, trips.rider_history, trips.riders_with_active_ride,
        trips.fare_rule_list, trips.open_requests, trips.driver_active_rides, trips.driver_trips,
        revenue.revenue_by_city_avg, revenue.revenue_per_city, revenue.top_cities, revenue.revenue_by_method,
        revenue.admin_kpis, revenue.earnings_page, revenue.pending_payouts, revenue.driver_totals, revenue.driver_pending_summary,
        revenue.wallet_balance, people.top_drivers, people.driver_stats, people.low_score_drivers,
        people.low_rated_drivers, people.trips_per_driver, people.completed_trips_per_driver, people.rides_per_rider,
        people.user_directory, people.driver_directory, people.vehicle_review_queue, people.driver_profile,
        people.driver_recent_earnings, people.driver_earning_detail, people.city_leaderboard,
    ]
    out = {f.__name__: _on_tables(f) for f in plain}
    for f in (revenue.revenue_in_range, revenue.refunds_in_range, revenue.driver_earnings_in_range):
        out[f.__name__] = _on_tables(f, *MONTH)
    for f in (trips.active_promos, trips.promo_list):
        out[f.__name__] = _on_tables(f, AS_OF)
    out["drivers_in_city"] = _on_tables(people.drivers_in_city, "nation_3 ")
    out["city_chart"] = _on_tables(lambda t: revenue.chart_series(revenue.top_cities(t), "city", "revenue"))
    out["ride_quote"] = _on_tables(lambda t: trips.ride_quote(t, t["payment_requests"], AS_OF))
    out["pricing_rule_lookup"] = _on_tables(lambda t: trips.pricing_rule_lookup(
        t["raw_bookings"].select("ride_id", "pickup_city", "vehicle_type"), t["fare_rules"]))
    return out


#: Tables that the constraint checks run over, each damaged where ``dirty_`` says so.
DIRTY = ["users", "rides", "complaints", *DAMAGE]


def _over(t, tables: list[str], check) -> DataFrame:
    """The findings of ``check(table, name)`` over damaged tables, as one."""
    parts = [check(t[f"dirty_{n}" if f"dirty_{n}" in t else n], n) for n in tables]
    return reduce(DataFrame.unionByName, parts)


def _form_view(checked: DataFrame, *keys: str) -> DataFrame:
    """Key, first error and all errors as one text."""
    return checked.select(*keys, "first_error", F.array_join("errors", ",").alias("errors"))


def quality_queries() -> dict[str, Query]:
    def form(check, table: str, key: str, *args) -> Query:
        return _on_tables(lambda t: _form_view(check(t[table], *args), key))
    out = {
        "check_registration": form(forms.check_registration, "raw_registrations", "user_id"),
        "check_booking": form(forms.check_booking, "raw_bookings", "ride_id", AS_OF),
        "check_trip_completion": form(forms.check_trip_completion, "raw_trips", "trip_id"),
        "check_vehicle": form(forms.check_vehicle, "raw_vehicles", "vehicle_id", AS_OF),
        "check_topup": form(forms.check_topup, "raw_topups", "request_id"),
        "check_fare_rule": form(forms.check_fare_rule, "raw_fare_rules", "rule_id"),
        "check_promo": form(forms.check_promo, "raw_promos", "promo_id"),
        "check_rating": form(forms.check_rating, "raw_ratings", "rating_id"),
        "check_plate_format": form(forms.check_plate_format, "raw_vehicles", "vehicle_id"),
        "check_constraints": _on_tables(lambda t: _over(t, DIRTY, constraints.check_constraints)),
        "check_unique": _on_tables(lambda t: _over(t, DIRTY, constraints.check_unique)),
        "check_foreign_keys": _on_tables(lambda t: _over(t, [n for n in DIRTY if any(x.child == n for x in schema.LINKS)], lambda df, n: (
            constraints.check_foreign_keys({**{p: t[p] for p in DIRTY}, n: df}, n)))),
        "check_not_self": _on_tables(lambda t: _over(t, list(schema.DISTINCT_PAIRS), constraints.check_not_self)),
        **{f"propagate_delete_{root}": _on_tables(lambda t, root=root, keys=keys: constraints.propagate_delete(
            {n: t[n] for n in DIRTY}, root, t[keys])) for root, keys in (
                ("drivers", "leaving_drivers"), ("promo_codes", "ended_codes"), ("fare_rules", "ended_rules"))},
        "propagate_delete": _on_tables(lambda t: constraints.propagate_delete({n: t[n] for n in DIRTY}, "users", t["leavers"])),
    }
    return out


def _rated(t) -> DataFrame:
    good = fares.first_form_per_ride(forms.passed(forms.check_trip_completion(t["raw_trips"])))
    return fares.split_commission(fares.rate_fares(good, t["rides"], t["fare_rules"]))


def _finished(t) -> dict[str, DataFrame]:
    """The trip chain on the state before it: part of the earnings, payments and history."""
    state = {n: t[n] for n in ("rides", "fare_rules", "wallet", "drivers")}
    return fares.finish_trips(t["raw_trips"], {
        **state, "driver_earnings": t["earnings_before"], "payments": t["payments_before"],
        "ride_history": t["history_before"]}, AS_OF)


def _priced(t):
    return payments.apply_promos(t["payment_requests"], t["rides"], t["payments"], t["promo_codes"], AS_OF)


def _redeemed(t):
    return payments.redeem_promos_capped(_priced(t)["priced"], t["promo_codes"], t["wallet"], t["payments"])


def _settled(t):
    redeemed = _redeemed(t)
    return {**payments.settle_payments(redeemed["accepted"], t["payments"], t["wallet"], AS_OF, t["promo_codes"]),
            "rejected": redeemed["refused"]}


def _outputs(name: str, job, main: str) -> dict[str, Query]:
    """A job with several outputs: the main one under its own name, the others as name_output."""
    keys, run = job
    return {name if k == main else f"{name}_{k}": _on_tables(lambda t, k=k: run(t)[k].drop(FORM)) for k in keys}


def job_queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "rate_fares": _on_tables(lambda t: _rated(t).drop("commission", "net_amount")),
        "split_commission": _on_tables(_rated),
        "post_earnings": _on_tables(lambda t: _finished(t)["driver_earnings"]),
        "open_payments": _on_tables(lambda t: _finished(t)["payments"]),
        "credit_wallets": _on_tables(lambda t: _finished(t)["wallet"]),
        "archive_cancelled": _on_tables(lambda t: fares.archive_cancelled(
            t["rides_before"], t["rides"], t["history_before"], AS_OF)),
        "count_completed_trips": _on_tables(lambda t: fares.count_completed_trips(
            t["rides"], t["drivers"].withColumn("total_trips", F.lit(0).cast("bigint")))),
        "driver_rating_rollup": _on_tables(lambda t: feedback.driver_rating_rollup(
            t["ratings"], t["drivers"].withColumn("avg_rating", F.lit(0).cast("decimal(3,2)")))),
        "expire_promos": _on_tables(lambda t: promos.expire_promos(t["promo_codes"], AS_OF)),
        "first_verified_vehicle": _on_tables(lambda t: dispatch.first_verified_vehicle(t["vehicles"])),
        "match_drivers": _on_tables(lambda t: dispatch.match_drivers(
            t["rides"], t["fare_rules"], t["drivers"], t["vehicles"], t["rejections"])),
        "toggle_availability": _on_tables(lambda t: accounts.toggle_availability(t["drivers"], t["toggles"])),
        "pay_rides_rejected": _on_tables(lambda t: payments.pay_rides(t["payment_requests"], t, AS_OF)["rejected"]),
        "wallet_statement": _on_tables(lambda t: wallets.wallet_statement(
            t["topups"], t["driver_earnings"], t["drivers"], t["payments"], t["payouts"])),
    }
    jobs = {
        "complete_rides": ((["rides", "drivers", "ride_history", "rejected"], _finished), "rides"),
        "apply_promos": ((["priced", "rejected"], _priced), "priced"),
        "redeem_promos_capped": ((["accepted", "rejected", "reserved"], _redeemed), "accepted"),
        "settle_payments": ((["payments", "wallet", "rejected", "promo_codes"], _settled), "payments"),
        "on_payment_paid": ((["rides", "ride_history"], lambda t: payments.on_payment_paid(
            t["payments_before"], t["payments"], t["rides_before"], t["history_before"], AS_OF)), "rides"),
        "flag_low_rated": ((["users", "admin_notifications"], lambda t: feedback.flag_low_rated(
            t["drivers"], t["users"], AS_OF)), "users"),
        "accept_rides": ((["rides", "drivers", "rejected"], lambda t: dispatch.accept_rides(
            t["accept_attempts"], t["rides"], t["drivers"], t["vehicles"])), "rides"),
        "advance_status": ((["rides", "illegal"], lambda t: dispatch.advance_status(
            t["status_changes"], t["rides_before"])), "rides"),
        "book_rides": ((["rides", "locations", "rejected"], lambda t: dispatch.book_rides(
            t["raw_bookings"], t["rides"], t["fare_rules"], AS_OF)), "rides"),
        "register_users": ((["users", "drivers", "wallet", "rejected"], lambda t: accounts.register_users(
            t["raw_registrations"], t["users"], t["drivers"], AS_OF)), "users"),
        "add_vehicles": ((["vehicles", "rejected"], lambda t: accounts.add_vehicles(
            t["raw_vehicles"], t["vehicles"], AS_OF)), "vehicles"),
        "upsert_fare_rules": ((["fare_rules", "rejected"], lambda t: promos.upsert_fare_rules(
            t["raw_fare_rules"], t["fare_rules"])), "fare_rules"),
        "create_promos": ((["promo_codes", "rejected"], lambda t: promos.create_promos(
            t["raw_promos"], t["promo_codes"])), "promo_codes"),
        "top_up_wallets": ((["wallet", "rejected"], lambda t: wallets.top_up_wallets(
            t["raw_topups"], t["wallet"])), "wallet"),
        "request_payouts": ((["wallet", "rejected"], lambda t: wallets.request_payouts(
            t["wallet"], t["wallet"].select("user_id"), AS_OF)), "wallet"),
        "approve_payouts": ((["driver_earnings", "wallet", "differences"], lambda t: wallets.approve_payouts(
            t["drivers"].filter("driver_id % 2 = 0").select("driver_id"), t["driver_earnings"], t["wallet"],
            t["drivers"], AS_OF)), "driver_earnings"),
        "accept_ratings": ((["ratings", "accepted", "rejected"], lambda t: feedback.accept_ratings(
            t["raw_ratings"], t["rides"], t["ratings"], t["drivers"])), "ratings"),
        "apply_status_changes": ((["table", "rejected"], lambda t: accounts.apply_status_changes(
            t["users"], t["account_changes"], "user_id", "acc_status", schema.ACCOUNT_STATES)), "table"),
        "review_vehicles": ((["table", "rejected"], lambda t: accounts.apply_status_changes(
            t["vehicles"], t["review_changes"], "vehicle_id", "verify_status", schema.VERIFY_STATES)), "table"),
    }
    for name, (job, main) in jobs.items():
        out.update(_outputs(name, job, main))
    return out


def _fresh_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"


def _load_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write tables as a snapshot, read them back and join two of them."""
    t, root = star_tables(spark, sf_dir), _fresh_folder(spark)
    save_tables({n: t[n] for n in ("rides", "locations")}, root)
    loaded = load_tables(spark, root, ["rides", "locations"])
    return with_pickup_city(loaded["rides"], loaded["locations"]).select("ride_id", "city", "fare", "created_at")


def _append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add two lots of rides to a table laid out by month and read them back."""
    t, root = star_tables(spark, sf_dir), _fresh_folder(spark)
    for lot in (0, 1):
        append(t["rides"].filter(F.col("ride_id") % 2 == lot), "rides", root)
    return load_tables(spark, root, ["rides"])["rides"].drop("month")


def _by_month(table: str, source: str, change) -> Query:
    """A table laid out by month, changed in place by ``change(spark, root, t)`` and read back."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t, root = star_tables(spark, sf_dir), _fresh_folder(spark)
        append(t[source], table, root)
        change(spark, root, t)
        return load_tables(spark, root, [table])[table].drop("month")
    return run


def _newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _fresh_folder(spark)
    append(star_tables(spark, sf_dir)["rides"], "rides", root)
    return monthly.newest(spark, root, "rides", [F.desc("created_at"), F.desc("ride_id")], 10)


#: Three days that are added, and payments that were wrong at first: in state, and a hundred days late.
DAYS, WRONG = ("1995-03-01", "1995-03-02", "1995-03-03"), "ride_id % 100 = 7"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums built once, then with three more days, then corrected."""
    t, root = star_tables(spark, sf_dir), _fresh_folder(spark)
    day = F.col("transaction_date").cast("date")
    wrong = materialize(t["payments"].withColumns({
        "pay_status": F.expr(f"CASE WHEN {WRONG} THEN 'pending' ELSE pay_status END"),
        "transaction_date": F.expr(f"CASE WHEN {WRONG} THEN transaction_date + INTERVAL '100' DAY ELSE transaction_date END")}))
    needed = {"rides": t["rides"], "locations": t["locations"]}  # {**t} would derive and write every table
    daily.refresh(spark, root, {**needed, "payments": wrong.filter(~day.cast("string").isin(*DAYS))})
    daily.refresh(spark, root, {**needed, "payments": wrong}, spark.createDataFrame([(d,) for d in DAYS], "day STRING"))
    changed = wrong.filter(WRONG).select(day.alias("day")).union(t["payments"].filter(WRONG).select(day.alias("day")))
    daily.refresh(spark, root, t, changed)
    return daily.load(spark, root)


def monthly_queries() -> dict[str, Query]:
    return {
        "upsert_by_month": _by_month("payments", "payments_before", lambda spark, root, t: monthly.upsert(
            spark, root, "payments", t["payments"].filter("ride_id % 200 < 3").withColumn(
                "transaction_date", F.expr("transaction_date + INTERVAL '40' DAY")), ["ride_id"], ["pay_status", "promo_id", "transaction_date"])),
        "insert_ignore_by_month": _by_month("ride_history", "history_before", lambda spark, root, t: monthly.insert_ignore(
            spark, root, "ride_history", t["closure_events"].select(
                "ride_id", "event_id", F.lit("completed").alias("outcome"), F.lit(0).alias("final_fare"),
                F.col("happened_at").alias("archived_at")), ["ride_id"], ["archived_at", "event_id"])),
        "update_where_by_month": _by_month("driver_earnings", "driver_earnings", lambda spark, root, t: monthly.update_where(
            spark, root, "driver_earnings", (F.col("payout_status") == "pending") & F.col("earned_at").between("1995-03-01", "1995-04-15"),
            {"payout_status": F.lit("paid")})),
        "update_join_by_month": _by_month("rides", "rides", lambda spark, root, t: monthly.update_join(
            spark, root, "rides", t["payments"].filter("pay_status = 'refunded'"), ["ride_id"],
            {"status": F.lit("cancelled"), "fare": F.col("fare") - F.col("_d_amount")}, carry=["amount"])),
        "recent_rides_by_month": _newest,
        "daily_revenue_in_range": lambda spark, sf_dir: daily.in_range(_daily(spark, sf_dir), *MONTH, "paid"),
        "daily_refunds_in_range": lambda spark, sf_dir: daily.in_range(_daily(spark, sf_dir), *MONTH, "refunded"),
        "daily_revenue_per_city": lambda spark, sf_dir: daily.per_city(_daily(spark, sf_dir)),
        "daily_revenue_by_method": lambda spark, sf_dir: daily.by_method(_daily(spark, sf_dir)),
    }


def sink_queries() -> dict[str, Query]:
    return {
        **monthly_queries(),
        "load_tables": _load_tables,
        "append": _append,
        "upsert": _on_tables(lambda t: sinks.upsert(
            t["payments_before"], t["payments"], ["ride_id"], ["pay_status", "promo_id"])),
        "insert_ignore": _on_tables(lambda t: sinks.insert_ignore(
            t["history_before"], t["closure_events"].select(
                "ride_id", "event_id", F.lit("completed").alias("outcome"), F.lit(0).alias("final_fare"),
                F.col("happened_at").alias("archived_at")), ["ride_id"], ["archived_at", "event_id"])),
        "update_where": _on_tables(lambda t: sinks.update_where(
            t["wallet"], F.col("balance") < 500, {"payout_status": F.lit("none"), "last_payout_date": moment(AS_OF)})),
        "update_join": _on_tables(lambda t: sinks.update_join(
            t["vehicles"], t["drivers"].filter("verify_status <> 'verified'"), ["driver_id"],
            {"verify_status": F.col("_d_verify_status")}, carry=["verify_status"])),
        "ids_of_inserted": _on_tables(lambda t: sinks.ids_of_inserted(
            t["users"], t["users"].select("email", F.lit(0).alias("balance"), F.lit(None).cast("bigint").alias("user_id")),
            ["email"], "user_id")),
        "assign_drivers": _on_tables(lambda t: dispatch.assign_drivers(t["rides"], dispatch.match_drivers(
            t["rides"], t["fare_rules"], t["drivers"], t["vehicles"], t["rejections"]))),
    }


def all_queries() -> dict[str, Query]:
    return {**report_queries(), **quality_queries(), **job_queries(), **delivery_queries(), **sink_queries(),
            **stream_queries()}
