"""Hand-made cases: limits, ties, ranges, and running a job twice."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from cabledger import schema
from cabledger.functions import display
from cabledger.functions.clock import default_range
from cabledger.operators import constraints, forms
from cabledger.plans import accounts, dispatch, fares, feedback, payments, people, promos, revenue, trips, wallets
from cabledger.sources import sinks
from cabledger.sources.tables import append, load_bucketed, load_tables, save_bucketed, save_tables

NOW = "2000-01-01 00:00:00"
T0 = dt.datetime(2000, 1, 1)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or df.columns)).collect())


def ride(i, **kw):
    base = dict(ride_id=i, rider_id=1, driver_id=1, pickup_location_id=1, dropoff_location_id=2, status="completed",
                fare=D("100.00"), created_at=T0)
    return {**base, **kw}


# --- sinks -------------------------------------------------------------------------------------------

def test_sinks(spark):
    base = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k INT, s STRING, n INT")
    delta = spark.createDataFrame([(2, "z", None), (3, "c", 30)], "k INT, s STRING, n INT")
    assert rows(sinks.upsert(base, delta, ["k"], ["s"])) == [(1, "a", 10), (2, "z", 20), (3, "c", 30)]
    both = sinks.upsert(base, delta, ["k"], ["s", "n"])
    assert [tuple(r) for r in both.orderBy("k").collect()] == [(1, "a", 10), (2, "z", None), (3, "c", 30)]
    again = spark.createDataFrame([(3, "x", 2), (3, "y", 1), (1, "q", 0)], "k INT, s STRING, n INT")
    assert rows(sinks.insert_ignore(base, again, ["k"], ["n"])) == [(1, "a", 10), (2, "b", 20), (3, "y", 1)]
    changed = sinks.update_where(base, F.col("n") > 15, {"s": F.lit("!")})
    assert rows(changed) == [(1, "a", 10), (2, "!", 20)]
    kids = spark.createDataFrame([("a", 5), ("b", 6)], "s STRING, c INT").withColumn("k", F.lit(None).cast("int"))
    assert rows(sinks.ids_of_inserted(base, kids, ["s"], "k"), "s", "c", "k") == [("a", 5, 1), ("b", 6, 2)]


def test_upsert_twice_changes_nothing(spark):
    base = spark.createDataFrame([(1, "a")], "k INT, s STRING")
    delta = spark.createDataFrame([(1, "b"), (2, "c")], "k INT, s STRING")
    once = sinks.upsert(base, delta, ["k"], ["s"])
    assert rows(sinks.upsert(once, delta, ["k"], ["s"])) == rows(once)


def test_save_load_append(spark, frame, tmp_path):
    rides = frame([ride(1), ride(2, created_at=dt.datetime(2000, 2, 3))], "rides")
    save_tables({"rides": rides}, str(tmp_path / "v1"))
    assert rows(load_tables(spark, str(tmp_path / "v1"), ["rides"])["rides"], "ride_id") == [(1,), (2,)]
    append(rides, "rides", str(tmp_path / "v2"))
    append(frame([ride(3)], "rides"), "rides", str(tmp_path / "v2"))
    assert rows(load_tables(spark, str(tmp_path / "v2"), ["rides"])["rides"], "ride_id") == [(1,), (2,), (3,)]
    assert (tmp_path / "v2" / "rides" / "month=2000-02").exists()


def test_range_reads_only_its_months(spark, tables, tmp_path):
    append(tables["payments"], "payments", str(tmp_path))
    t = load_tables(spark, str(tmp_path), ["payments"])
    report = revenue.revenue_in_range(t, "1997-01-01", "1997-01-30")
    assert rows(report) == rows(revenue.revenue_in_range(tables, "1997-01-01", "1997-01-30"))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_bucketed_facts_join_without_shuffle(spark, tables, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS market LOCATION '{tmp_path}/market'")
    save_bucketed({n: tables[n] for n in ("rides", "payments", "driver_earnings")}, "market.", 4)
    facts = load_bucketed(spark, "market.")
    # Adaptive runs may broadcast tables this small; the hints ask for the join large ones get.
    joined = facts["rides"].hint("merge").join(facts["payments"].select("ride_id", "amount"), "ride_id").hint("merge").join(
        facts["driver_earnings"].select("ride_id", "net_amount"), "ride_id")
    assert joined.count() == tables["payments"].count()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
    spark.sql("DROP DATABASE market CASCADE")


# --- reports -----------------------------------------------------------------------------------------

def test_range_includes_next_midnight(frame):
    def pay(i, when):
        return dict(payment_id=i, ride_id=i, amount=D("1.00"), pay_status="paid", transaction_date=when)
    t = {"payments": frame([pay(1, T0), pay(2, dt.datetime(2000, 1, 31, 23)), pay(3, dt.datetime(2000, 2, 1)),
                            pay(4, dt.datetime(2000, 2, 1, 1))], "payments")}
    assert revenue.revenue_in_range(t, "2000-01-01", "2000-01-31").first()["count"] == 3
    assert revenue.revenue_in_range(t, "2000-01-01", "2000-01-31", half_open=True).first()["count"] == 2
    assert revenue.refunds_in_range(t, "2000-01-01", "2000-01-31").first().asDict() == {"total": None, "count": 0}
    assert default_range(NOW) == ("1999-12-02", "2000-01-01")


def test_city_spellings_are_one_city(frame):
    cities = ["Karachi", "karachi ", "KARÁCHI", "Lahore"]
    t = {
        "locations": frame([dict(location_id=i, city=c) for i, c in enumerate(cities)], "locations"),
        "rides": frame([ride(i, pickup_location_id=i) for i in range(4)], "rides"),
        "payments": frame([dict(payment_id=i, ride_id=i, amount=D(10), pay_status="paid") for i in range(4)], "payments"),
    }
    assert rows(revenue.revenue_per_city(t), "total_rides") == [(1,), (3,)]
    rules = frame([dict(rule_id=7, city="Karachi", vehicle_type="economy")], "fare_rules")
    asked = t["locations"].select(F.col("city").alias("pickup_city"), F.lit("").alias("vehicle_type"))
    assert rows(trips.pricing_rule_lookup(asked, rules).filter("rule_id = 7"), "pickup_city") == [
        (c,) for c in sorted(cities[:3])]


def test_mean_below_limit_is_tested_unrounded(frame):
    """699 points in 200 ratings: 3.495 is below 3.5, but rounds to 3.50."""
    scores = [4] * 99 + [3] * 101
    ratings = frame([dict(rating_id=i, ride_id=i, rated_by=5, rated_user_id=9, score=s) for i, s in enumerate(scores)], "ratings")
    drivers = frame([dict(driver_id=1, user_id=9, avg_rating=D(0), total_trips=0)], "drivers")
    users = frame([dict(user_id=9, full_name="Ali", acc_status="active")], "users")
    t = {"ratings": ratings, "drivers": drivers, "users": users}
    assert people.low_score_drivers(t).count() == 1
    rolled = feedback.driver_rating_rollup(ratings, drivers)
    assert rolled.first()["avg_rating"] == D("3.50")
    assert feedback.flag_low_rated(rolled, users, NOW)["admin_notifications"].count() == 0
    worse = drivers.withColumn("avg_rating", F.lit("3.49").cast("decimal(3,2)"))
    flagged = feedback.flag_low_rated(worse, users, NOW)
    assert flagged["users"].first()["acc_status"] == "suspended"
    assert flagged["admin_notifications"].first()["message"] == (
        'ALERT: Driver "Ali" (driver_id=1) has been auto-suspended. Average rating dropped to 3.49 (below 3.5). Please review.')


def test_leaderboard_ties(frame):
    """Equal ratings share a rank and leave a gap; a driver with two equal main cities is ranked in both."""
    rating = {1: "4.90", 2: "4.90", 3: "4.10", 4: "4.00"}
    t = {
        "drivers": frame([dict(driver_id=i, user_id=i, verify_status="verified", avg_rating=D(r)) for i, r in rating.items()], "drivers"),
        "users": frame([dict(user_id=i, full_name=f"D{i}") for i in rating], "users"),
        "locations": frame([dict(location_id=1, city="A"), dict(location_id=2, city="B")], "locations"),
        "rides": frame([ride(i, driver_id=i) for i in rating] + [ride(9, driver_id=3, pickup_location_id=2)], "rides"),
    }
    board = people.city_leaderboard(t)
    assert rows(board, "city", "full_name", "city_rank", "medal") == [
        ("A", "D1", 1, "🥇"), ("A", "D2", 1, "🥇"), ("A", "D3", 3, "🥉"), ("A", "D4", 4, "#4"), ("B", "D3", 1, "🥇")]


def test_open_requests_by_driver(frame):
    t = {
        "rides": frame([ride(1, status="requested", driver_id=None), ride(2, status="requested", driver_id=7),
                        ride(3, status="requested", driver_id=8)], "rides"),
        "locations": frame([dict(location_id=1, city="A"), dict(location_id=2, city="B")], "locations"),
        "users": frame([dict(user_id=1, full_name="R")], "users"), "fare_rules": frame([], "fare_rules"),
    }
    assert rows(trips.open_requests(t, id=7), "ride_id") == [(1,), (2,)]
    assert rows(trips.open_requests(t), "ride_id") == [(1,), (2,), (3,)]


def test_display(spark):
    row = spark.range(1).select(display.fixed(F.lit(4.25), 1), display.rupees(F.lit(None).cast("decimal(5,2)")),
                                display.day(F.lit("2000-03-04").cast("date"))).first()
    assert tuple(row) == ("4.3", "Rs. 0.00", "3/4/2000")


def test_promo_bounds(frame):
    """A code ending exactly now is neither usable nor expired by the nightly job."""
    codes = frame([dict(promo_id=1, code="NOW", discount_pct=D(10), usage_limit=5, usage_count=0, valid_from=T0, valid_until=T0)], "promo_codes")
    assert trips.active_promos({"promo_codes": codes}, NOW).count() == 0
    assert promos.expire_promos(codes, NOW).first()["usage_limit"] == 5
    early = codes.withColumn("valid_until", F.lit("2001-01-01").cast("timestamp_ntz")).withColumn(
        "valid_from", F.lit("2000-06-01").cast("timestamp_ntz"))
    assert trips.active_promos({"promo_codes": early}, NOW).count() == 1
    assert trips.active_promos({"promo_codes": early}, NOW, enforce_start=True).count() == 0


# --- jobs --------------------------------------------------------------------------------------------

TRIP = "ride_id BIGINT, distance DECIMAL(8,2), duration INT"


def test_fares_and_rerun(frame):
    rides = frame([ride(1, rule_id=1, status="in_progress", fare=None), ride(2, driver_id=2, status="completed")], "rides")
    rules = frame([dict(rule_id=1, city="A", vehicle_type="bike", base_rate=D(40), per_km_rate=D(10), per_min_rate=D(1),
                        surge_multi=D("1.25"))], "fare_rules")
    drivers = frame([dict(driver_id=i, user_id=10 + i, total_trips=3, avail_status="on_trip") for i in (1, 2)], "drivers")
    wallet = frame([dict(user_id=11, balance=D("5.00")), dict(user_id=12, balance=D(0))], "wallet")
    trips_in = frame([dict(ride_id=1, distance=D("2.50"), duration=7), dict(ride_id=2, distance=D(1), duration=1)], ddl=TRIP)
    rated = fares.split_commission(fares.rate_fares(trips_in, rides, rules))
    assert rows(rated, "ride_id", "fare", "commission", "net_amount") == [
        (1, D("90.00"), D("18.00"), D("72.00")), (2, D("72.00"), D("14.40"), D("57.60"))]
    none = frame([], "driver_earnings")
    earned = fares.post_earnings(none, rated, NOW)
    first = fares.credit_wallets(wallet, drivers, rated, none)
    assert rows(first, "user_id", "balance") == [(11, D("77.00")), (12, D("57.60"))]
    assert rows(fares.credit_wallets(first, drivers, rated, earned)) == rows(first)
    assert rows(fares.post_earnings(earned, rated, NOW)) == rows(earned)
    done = fares.complete_rides(rides, drivers, frame([], "ride_history"), rated, NOW)
    assert rows(done["drivers"], "driver_id", "total_trips", "avail_status") == [(1, 4, "online"), (2, 3, "online")]
    assert rows(done["ride_history"], "ride_id", "final_fare") == [(1, D("90.00")), (2, D("72.00"))]


REQ = "request_id BIGINT, ride_id BIGINT, rider_id BIGINT, pay_method STRING, promo_code STRING, requested_at TIMESTAMP_NTZ"


def test_payment_chain(frame):
    """A shortfall leaves the balance for a later, cheaper request; the last use of a code goes to the first."""
    rides = frame([ride(i, fare=D(f)) for i, f in [(1, 80), (2, 300), (3, 20), (4, 50), (5, 50)]], "rides")
    codes = frame([dict(promo_id=1, code="HALF", discount_pct=D(50), usage_limit=3, usage_count=2, valid_from=T0,
                        valid_until=dt.datetime(2001, 1, 1)),
                   dict(promo_id=2, code="ALL", discount_pct=D(100), usage_limit=9, usage_count=0, valid_from=T0,
                        valid_until=dt.datetime(2001, 1, 1))], "promo_codes")

    def ask(i, method, code=None, ride_id=None):
        return dict(request_id=i, ride_id=ride_id or i, rider_id=1, pay_method=method, promo_code=code,
                    requested_at=T0 + dt.timedelta(minutes=i))
    asked = frame([ask(1, "wallet", " half "), ask(2, "wallet"), ask(3, "wallet", "HALF"), ask(4, "cash", "all"), ask(5, "barter"),
                   ask(6, "wallet", ride_id=5), ask(7, "card", ride_id=5)], ddl=REQ)
    no_pay = frame([], "payments")
    priced = payments.apply_promos(asked, rides, no_pay, codes, NOW)
    assert rows(priced["rejected"], "request_id", "reason") == [(5, "method_invalid")]
    wallet = frame([dict(user_id=1, balance=D("95.00"))], "wallet")
    for limits in ({}, {"hot_rows": 0}):
        redeemed = payments.redeem_promos_capped(priced["priced"], codes, wallet, no_pay, **limits)
        assert rows(redeemed["rejected"], "request_id", "reason") == [(3, "promo_used_up")]
        assert rows(redeemed["refused"], "request_id", "reason") == [(2, "insufficient_balance"), (7, "already_paid")]
        assert dict(rows(redeemed["reserved"], "promo_id", "uses")) == {1: 1, 2: 1}
        settled = payments.settle_payments(redeemed["accepted"], no_pay, wallet, NOW, codes)
        assert rows(settled["promo_codes"], "promo_id", "usage_count") == [(1, 3), (2, 1)]
        assert settled["wallet"].first()["balance"] == D("5.00")
        assert rows(settled["payments"], "ride_id", "amount", "discount_appld", "pay_status") == [
            (1, D("40.00"), D("40.00"), "paid"), (4, D("0.00"), D("50.00"), "paid"), (5, D("50.00"), D("0.00"), "paid")]
    closed = payments.on_payment_paid(no_pay, settled["payments"], rides.withColumn("status", F.when(
        F.col("ride_id") == 4, "cancelled").otherwise("in_progress")), frame([], "ride_history"), NOW)
    assert rows(closed["ride_history"], "ride_id", "outcome") == [(1, "completed"), (5, "completed")]
    assert rows(closed["rides"].filter("status = 'cancelled'"), "ride_id") == [(4,)]


def test_cancelled_ride_keeps_its_fare(frame):
    old, new = frame([ride(1, status="accepted")], "rides"), frame([ride(1, status="cancelled")], "rides")
    assert fares.archive_cancelled(old, new, frame([], "ride_history"), NOW).first()["final_fare"] == D("100.00")


@pytest.mark.parametrize("chunk", [1000, 1])
def test_matching(frame, chunk):
    rides = frame([ride(i, status="requested", driver_id=None, rule_id=r, created_at=T0 - dt.timedelta(days=i))
                   for i, r in [(1, None), (2, 1), (3, 1), (4, 2)]], "rides")
    rules = frame([dict(rule_id=1, vehicle_type="economy"), dict(rule_id=2, vehicle_type="bike")], "fare_rules")
    drivers = frame([dict(driver_id=i, verify_status="verified", avail_status="online", avg_rating=D(r))
                     for i, r in [(1, 3), (2, 5), (3, 4)]], "drivers")
    cars = frame([dict(vehicle_id=10 * d + n, driver_id=d, vehicle_type=k, verify_status="verified")
                  for d, n, k in [(1, 1, "economy"), (2, 1, "economy"), (2, 2, "bike"), (3, 1, "bike")]], "vehicles")
    none = frame([], ddl="ride_id BIGINT, driver_id BIGINT")
    got = dispatch.match_drivers(rides, rules, drivers, cars, none, chunk)
    # Ride 4 is the oldest and takes the best driver, though its bike is that driver's second vehicle.
    assert rows(got, "ride_id", "driver_id", "vehicle_id") == [(3, 1, 11), (4, 2, 22)]
    offered = dispatch.assign_drivers(rides, got)
    assert rows(offered.filter("driver_id IS NOT NULL"), "ride_id", "status") == [(i, "requested") for i in (3, 4)]
    no = frame([dict(ride_id=4, driver_id=2)], ddl="ride_id BIGINT, driver_id BIGINT")
    again = rows(dispatch.match_drivers(rides, rules, drivers, cars, no, chunk), "ride_id", "driver_id")
    assert again == [(3, 2), (4, 3)] or (4, 2) not in again and len({r for r, _ in again}) == len({d for _, d in again}) == len(again)
    held = offered.filter("driver_id IS NOT NULL").select("driver_id").collect()
    assert not {d for _, d in rows(dispatch.match_drivers(offered, rules, drivers, cars, none, chunk), "ride_id", "driver_id")} & {
        h["driver_id"] for h in held}


def test_no_ride_waits_while_a_free_driver_may_take_it(frame):
    n = 5
    rides = frame([ride(i, status="requested", driver_id=None, rule_id=None, created_at=T0 + dt.timedelta(minutes=i)) for i in range(1, n + 1)], "rides")
    drivers = frame([dict(driver_id=i, user_id=i, avail_status="online", verify_status="verified", avg_rating=D(i)) for i in range(1, n)], "drivers")
    cars = frame([dict(vehicle_id=10 + i, driver_id=i, vehicle_type="economy", verify_status="verified") for i in range(1, n)], "vehicles")
    refused = {(1, d) for d in (4, 3, 2)} | {(2, d) for d in range(1, n)} | {(3, 4), (3, 2), (5, 1)}
    no = frame([dict(ride_id=r, driver_id=d) for r, d in sorted(refused)], ddl="ride_id BIGINT, driver_id BIGINT")
    got = rows(dispatch.match_drivers(rides, frame([], "fare_rules"), drivers, cars, no), "ride_id", "driver_id")
    assert not set(got) & refused and len({d for _, d in got}) == len(got)
    free = set(range(1, n)) - {d for _, d in got}
    assert all((r, d) in refused for r in set(range(1, n + 1)) - {r for r, _ in got} for d in free)


def test_a_form_sent_twice_pays_once(frame):
    old = {"rides": frame([ride(1, status="in_progress", driver_id=1, rule_id=None, fare=None)], "rides"), "fare_rules": frame([], "fare_rules"),
           "drivers": frame([dict(driver_id=1, user_id=9, total_trips=0)], "drivers"), "wallet": frame([dict(user_id=9, balance=D("0.00"))], "wallet"),
           "payments": frame([], "payments"), "driver_earnings": frame([], "driver_earnings"), "ride_history": frame([], "ride_history")}
    forms_in = frame([dict(trip_id=i, submitted_at=T0 + dt.timedelta(minutes=-i), ride_id=1, distance=str(i), duration="5") for i in (1, 2, 3)],
                     ddl="trip_id BIGINT, submitted_at TIMESTAMP_NTZ, ride_id BIGINT, distance STRING, duration STRING")
    new = fares.finish_trips(forms_in, old, NOW)
    assert rows(new["rejected"], "trip_id", "reason") == [(1, "repeated_form"), (2, "repeated_form")]
    assert [new[n].count() for n in ("rides", "payments", "driver_earnings", "ride_history")] == [1, 1, 1, 1]
    assert new["wallet"].first()["balance"] == new["driver_earnings"].first()["net_amount"]


def test_sinks_with_repeated_keys(frame):
    base = frame([dict(k=1, v=10)], ddl="k BIGINT, v BIGINT")
    delta = frame([dict(k=1, v=12), dict(k=1, v=11), dict(k=2, v=5), dict(k=2, v=6)], ddl="k BIGINT, v BIGINT")
    assert rows(sinks.upsert(base, delta, ["k"], ["v"]), "k", "v") == [(1, 12), (2, 6)]
    assert rows(sinks.insert_ignore(base, delta, ["k"]), "k", "v") == [(1, 10), (2, 5)]


@pytest.mark.parametrize("hot_rows", [1000, 0])
def test_status_steps(frame, hot_rows):
    ddl = "change_id BIGINT, ride_id BIGINT, new_status STRING, changed_at TIMESTAMP_NTZ"
    steps = ["driver_en_route", "in_progress", "driver_en_route", "completed"]
    changes = frame([dict(change_id=i, ride_id=1, new_status=s, changed_at=T0 + dt.timedelta(minutes=i)) for i, s in enumerate(steps)], ddl=ddl)
    got = dispatch.advance_status(changes, frame([ride(1, status="accepted")], "rides"), hot_rows)
    assert got["rides"].first()["status"] == "driver_en_route"
    assert rows(got["illegal"], "change_id", "old_status", "reason") == [
        (2, "in_progress", "out_of_order"), (3, "accepted", "status_not_allowed")]


def test_toggle_parity(frame):
    drivers = frame([dict(driver_id=i, user_id=i, avail_status=s) for i, s in enumerate(["online", "offline", "on_trip", "on_trip"])], "drivers")
    presses = frame([dict(driver_id=d) for d in (0, 1, 1, 2)], ddl="driver_id BIGINT")
    assert rows(accounts.toggle_availability(drivers, presses), "driver_id", "avail_status") == [
        (0, "offline"), (1, "offline"), (2, "online"), (3, "on_trip")]


def test_statement_spread_equals_plain(tables):
    args = [tables[n] for n in ("topups", "driver_earnings", "drivers", "payments", "payouts")]
    plain = rows(wallets.wallet_statement(*args))
    assert rows(wallets.wallet_statement(*args, hot_rows=20)) == plain


def test_money_adds_up(tables):
    bad = tables["driver_earnings"].filter("gross_amount <> commission + net_amount").count()
    twice = tables["driver_earnings"].groupBy("ride_id").count().filter("count > 1").count()
    assert (bad, twice) == (0, 0)
    priced = payments.apply_promos(tables["payment_requests"], tables["rides"], tables["payments"], tables["promo_codes"], NOW)["priced"]
    after = payments.redeem_promos_capped(priced, tables["promo_codes"], tables["wallet"], tables["payments"])
    settled = payments.settle_payments(after["accepted"], tables["payments"], tables["wallet"], NOW, tables["promo_codes"])
    assert settled["promo_codes"].filter("usage_count > usage_limit").count() == 0
    assert settled["wallet"].filter("balance < 0").count() == 0


# --- checks ------------------------------------------------------------------------------------------

@pytest.mark.parametrize("phone,good", [("03001234567", True), ("0300-123 4567", True), ("3001234567", False), (None, False)])
def test_phone(spark, phone, good):
    df = spark.createDataFrame([("Ali Khan", "a@b.co", phone, "rider", None, None)],
                               "full_name STRING, email STRING, phone STRING, role STRING, cnic STRING, license_num STRING")
    assert (forms.check_registration(df).first()["first_error"] is None) == good


def test_all_errors_are_listed(spark):
    df = spark.createDataFrame([("600.5", "x")], "distance STRING, duration STRING")
    assert forms.check_trip_completion(df).first()["errors"] == ["distance_too_long", "duration_not_positive"]


@pytest.mark.parametrize("table", list(schema.COLUMNS))
def test_row_rules_hold_or_break(spark, frame, table):
    """A row of NULLs breaks exactly the required-column rules."""
    got = {r["rule"] for r in constraints.check_constraints(frame([{}], table), table).collect()}
    required = [n for n in schema.names(table) if n not in schema.NULLABLE.get(table, set())]
    assert got == {f"{n}_missing" for n in required}


def test_unique_folds_text(frame):
    users = frame([dict(user_id=i, email=e, phone=str(i)) for i, e in enumerate(["a@x.pk", "A@x.pk ", "b@x.pk"])], "users")
    assert rows(constraints.check_unique(users, "users"), "rule", "rows") == [("email_repeated", 2)]


def test_jobs_refuse_self_and_double_ratings(frame):
    ddl = "rating_id BIGINT, ride_id BIGINT, rated_by BIGINT, rated_user_id BIGINT, rater_role STRING, score STRING, comment STRING, rated_at TIMESTAMP_NTZ"
    asked = frame([dict(rating_id=i, ride_id=1, rated_by=b, rated_user_id=u, rater_role=r, score="5", rated_at=T0)
                   for i, b, u, r in [(1, 1, 9, "rider"), (2, 1, 9, "rider"), (3, 9, 9, "driver"), (4, 9, 1, "driver")]], ddl=ddl)
    got = feedback.accept_ratings(asked, frame([ride(1)], "rides"), frame([], "ratings"),
                                  frame([dict(driver_id=1, user_id=9)], "drivers"))
    assert rows(got["accepted"], "rating_id", "target_mismatch") == [(1, False), (4, False)]
    assert rows(got["rejected"], "rating_id", "reason") == [(2, "already_rated"), (3, "self_rating")]
