"""Tables laid out by month change only where a delta touches them; daily sums follow corrections."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from cabledger import schema
from cabledger.operators import constraints
from cabledger.plans import daily, revenue
from cabledger.sources import monthly, sinks
from cabledger.sources.tables import append, load_tables


@pytest.fixture
def laid(spark, frame, tmp_path):
    """Five months of payments, four a month."""
    rows = [dict(payment_id=i, ride_id=i, rider_id=i, amount=D(i), pay_method="cash", pay_status="pending",
                 transaction_date=dt.datetime(2000, 1 + i // 4, 1 + i % 4)) for i in range(20)]
    append(frame(rows, "payments"), "payments", str(tmp_path))
    return str(tmp_path)


def files(root):
    import pathlib
    return {(str(p), p.stat().st_mtime_ns) for p in pathlib.Path(root, "payments").rglob("part-*.parquet")}


def month_of(paths):
    return {p.split("month=")[1][:7] for p, _ in paths}


def table(spark, root):
    return load_tables(spark, root, ["payments"])["payments"].drop("month")


def same(a, b):
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_upsert_rewrites_its_months_only(spark, frame, laid):
    before, old = files(laid), spark.createDataFrame(table(spark, laid).collect(), schema.struct("payments"))
    delta = frame([dict(payment_id=i, ride_id=i, amount=D(99), pay_status="paid", transaction_date=dt.datetime(2000, 2, 9)) for i in (5, 6, 40)], "payments")
    done = monthly.upsert(spark, laid, "payments", delta, ["ride_id"], ["amount", "pay_status"])
    assert done == ["2000-02"] and month_of(before - files(laid)) == {"2000-02"}
    assert same(table(spark, laid), sinks.upsert(old, delta, ["ride_id"], ["amount", "pay_status"]))


def test_rows_move_between_months(spark, frame, laid):
    """All rows of January go to March and June; January is left empty, the others are complete."""
    before, old = files(laid), spark.createDataFrame(table(spark, laid).collect(), schema.struct("payments"))
    delta = frame([dict(ride_id=i, transaction_date=dt.datetime(2000, 3 if i < 2 else 6, 20)) for i in range(4)], "payments")
    done = monthly.upsert(spark, laid, "payments", delta, ["ride_id"], ["transaction_date"])
    assert done == ["2000-01", "2000-03", "2000-06"] and month_of(before - files(laid)) == {"2000-01", "2000-03"}
    assert same(table(spark, laid), sinks.upsert(old, delta, ["ride_id"], ["transaction_date"]))


def test_insert_ignore_touches_no_file(spark, frame, laid):
    before = files(laid)
    delta = frame([dict(payment_id=i, ride_id=i, amount=D(7), transaction_date=dt.datetime(2000, 2, 9)) for i in (5, 41, 41)], "payments")
    monthly.insert_ignore(spark, laid, "payments", delta, ["ride_id"])
    assert before < files(laid) and table(spark, laid).count() == 21
    assert table(spark, laid).filter("ride_id = 5").first()["amount"] == D(5)


def test_updates_and_empty_deltas(spark, frame, laid):
    before = files(laid)
    assert monthly.update_where(spark, laid, "payments", F.col("amount").between(9, 10), {"pay_status": F.lit("paid")}) == ["2000-03"]
    assert monthly.update_where(spark, laid, "payments", F.col("amount") > 1000, {"pay_status": F.lit("paid")}) == []
    none = frame([], "payments")
    assert monthly.upsert(spark, laid, "payments", none, ["ride_id"], ["amount"]) == []
    assert monthly.update_join(spark, laid, "payments", frame([dict(ride_id=17, amount=D(1))], "payments"), ["ride_id"],
                               {"amount": F.col("amount") + F.col("_d_amount")}, ["amount"]) == ["2000-05"]
    assert month_of(before - files(laid)) == {"2000-03", "2000-05"}
    assert {(r["ride_id"], r["amount"]) for r in table(spark, laid).filter("pay_status = 'paid' OR ride_id = 17").collect()} == {
        (9, D(9)), (10, D(10)), (17, D(18))}


def test_months_are_found_by_keys_alone(spark, frame, laid):
    base, delta = load_tables(spark, laid, ["payments"])["payments"], frame([dict(ride_id=6)], "payments")
    near = base.select("ride_id", "month").filter(F.col("ride_id").between(6, 6))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ride_id:bigint>" in plan and "PushedFilters: [IsNotNull(ride_id)" in plan
    assert monthly.months_of_keys(base, delta, ["ride_id"]) == {"2000-02"}


def test_newest_reads_the_last_months(spark, laid):
    got = monthly.newest(spark, laid, "payments", [F.desc("transaction_date"), F.desc("payment_id")], 6)
    assert [r["ride_id"] for r in got.collect()] == [19, 18, 17, 16, 15, 14]
    plan = got._jdf.queryExecution().executedPlan().toString()
    read = plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "2000-05" in read and "2000-04" in read and "2000-03" not in read
    assert monthly.newest(spark, laid, "payments", [F.desc("transaction_date")], 50).count() == 20


def test_daily_sums_keep_the_next_midnight(spark, frame, tmp_path):
    rides = frame([dict(ride_id=i, pickup_location_id=i % 2) for i in range(5)], "rides")
    places = frame([dict(location_id=0, city="A"), dict(location_id=1, city="a ")], "locations")
    times = [dt.datetime(2000, 1, 1), dt.datetime(2000, 1, 31, 23), dt.datetime(2000, 2, 1), dt.datetime(2000, 2, 1, 1), None]
    paid = frame([dict(payment_id=i, ride_id=i, amount=D(1 + i), pay_method="card", pay_status="paid", transaction_date=w) for i, w in enumerate(times)], "payments")
    t = {"payments": paid, "rides": rides, "locations": places}
    daily.refresh(spark, str(tmp_path), t)
    sums = daily.load(spark, str(tmp_path))
    for half_open in (False, True):
        assert daily.in_range(sums, "2000-01-01", "2000-01-31", "paid", half_open).first() == revenue.revenue_in_range(
            t, "2000-01-01", "2000-01-31", half_open).first()
    assert [tuple(r) for r in daily.per_city(sums).collect()] == [tuple(r) for r in revenue.revenue_per_city(t).collect()]
    daily.refresh(spark, str(tmp_path), {**t, "payments": paid.filter("payment_id < 2")}, spark.createDataFrame([("2000-02-01",)], "day STRING"))
    assert daily.in_range(daily.load(spark, str(tmp_path)), "2000-01-01", "2000-02-09", "paid").first()["count"] == 2


def test_a_delete_needs_every_linked_table(frame):
    t = {n: frame([], n) for n in schema.COLUMNS}
    t["users"] = frame([dict(user_id=1)], "users")
    t["admin_notifications"] = frame([dict(notification_id=5, related_user_id=1)], "admin_notifications")
    t["drivers"] = frame([dict(driver_id=2, user_id=1)], "drivers")
    t["vehicles"] = frame([dict(vehicle_id=3, driver_id=2)], "vehicles")
    keys = frame([dict(user_id=1), dict(user_id=1)], ddl="user_id BIGINT")
    got = {(r["table"], r["key"], r["action"]) for r in constraints.propagate_delete(t, "users", keys).collect()}
    assert got == {("users", "1", "delete"), ("drivers", "2", "delete"), ("vehicles", "3", "delete"), ("admin_notifications", "5", "set_null")}
    del t["admin_notifications"]
    with pytest.raises(KeyError, match="admin_notifications"):
        constraints.propagate_delete(t, "users", keys)


def test_daily_sums_ask_for_no_other_table(spark, frame, tmp_path):
    """Tables may be derived when first asked for, so the correction of a day must not ask for all of them."""
    from collections.abc import Mapping

    class Lazy(Mapping):
        def __getitem__(self, name):
            made = {"rides": lambda: frame([dict(ride_id=1, pickup_location_id=1)], "rides"),
                    "locations": lambda: frame([dict(location_id=1, city="A")], "locations"),
                    "payments": lambda: frame([dict(payment_id=1, ride_id=1, amount=D(3), pay_method="card", pay_status="paid",
                                                    transaction_date=dt.datetime(2000, 1, 1))], "payments")}
            assert name in made, f"{name} is not needed"
            return made[name]()

        def __iter__(self):
            return iter([*schema.COLUMNS])

        def __len__(self):
            return len(schema.COLUMNS)
    daily.refresh(spark, str(tmp_path), Lazy())
    daily.refresh(spark, str(tmp_path), Lazy(), spark.createDataFrame([("2000-01-01",)], "day STRING"))
    assert [tuple(r) for r in daily.by_method(daily.load(spark, str(tmp_path))).collect()] == [("card", D("3.00"), 1)]
