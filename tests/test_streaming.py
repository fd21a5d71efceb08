"""Streams over several micro-batches: repeats, late events, alerts and restarts."""

import datetime as dt
import time
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from cabledger.streaming import jobs

T0 = dt.datetime(2000, 1, 1)


@pytest.fixture
def feed(spark, tmp_path):
    """A file stream that takes one file per micro-batch, and a way to add files."""
    source = tmp_path / "in"
    source.mkdir()

    class Feed:
        checkpoint, out = str(tmp_path / "checkpoint"), str(tmp_path / "out")
        files = 0

        def add(self, rows, ddl):
            staged = tmp_path / f"staged{self.files}"
            spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(staged))
            part = next(staged.glob("part-*.parquet"))
            (source / f"{self.files:03}.parquet").write_bytes(part.read_bytes())
            self.files += 1
            self.ddl = ddl
            time.sleep(0.05)  # files are taken in order of their time

        def stream(self):
            return spark.readStream.schema(self.ddl).option("maxFilesPerTrigger", 1).parquet(str(source))

        def run(self, query):
            assert query.awaitTermination(240)
            return spark.read.parquet(self.out)
    Feed.spark = spark
    return Feed()


RATING = "rating_id BIGINT, rated_user_id BIGINT, score INT, rated_at TIMESTAMP_NTZ"


FAR = dt.datetime(9000, 1, 1)


def rating(i, minute, score, user=9):
    return (i, user, score, T0 + dt.timedelta(minutes=minute))


def test_alert_for_every_fall_and_late_ratings(feed, spark):
    feed.add([rating(1, 1, 5), rating(2, 2, 5), rating(3, 3, 1), rating(4, 4, 1)], RATING)   # 5, 5, 3.67, 3.00: alert at 4
    feed.add([rating(4, 4, 1), rating(5, 6, 5), rating(6, 5, 5)], RATING)                    # back above at 5; 4 sent again
    feed.add([rating(7, 30, 1), rating(8, 31, 1), rating(9, 32, 1)], RATING)                 # 3.29 at 7: alert again
    feed.add([rating(10, 7, 5), rating(11, 33, 5, user=8)], RATING)                          # 10 is late: 7 < 32 - 10
    feed.add([(None, None, None, FAR)], RATING)
    base = spark.createDataFrame([(8, 1, 1)], "rated_user_id BIGINT, score_sum BIGINT, n BIGINT")
    written = feed.run(jobs.stream_driver_ratings(feed.stream(), feed.checkpoint, feed.out, once=True, start_from=base, delay="10 minutes"))
    alerts = jobs.rating_alerts(written).select("rating_id", "n", "mean").orderBy("rating_id").collect()
    assert [tuple(r) for r in alerts] == [(4, 4, D("3.00")), (7, 7, D("3.29"))]
    assert [tuple(r) for r in jobs.late_ratings(written).select("rating_id", "score").collect()] == [(10, 5)]
    totals = jobs.rating_totals(written).select("rated_user_id", "score_sum", "n", "mean", "low").orderBy("rated_user_id").collect()
    assert [tuple(r) for r in totals] == [(8, 6, 2, D("3.00"), True), (9, 25, 9, D("2.78"), True)]


def brute_alerts(rows):
    found, sums = set(), {}
    for i, user, score, _ in sorted(set(rows), key=lambda r: (r[3], r[0])):
        total, n = sums.get(user, (0, 0))
        low = n and D(total) / n < D("3.495")
        total, n = total + score, n + 1
        if D(total) / n < D("3.495") and not low:
            found.add((user, i, n))
        sums[user] = total, n
    return found


@pytest.mark.parametrize("lots", [1, 3])
def test_alerts_do_not_hang_on_the_cut(feed, lots):
    import random
    rng = random.Random(1)
    rows = [rating(i, rng.randint(1, 500), rng.choice([1, 3, 4, 5]), user=rng.randint(1, 4)) for i in range(1, 200)]
    dealt = rows + rows[:20]
    rng.shuffle(dealt)
    for i in range(lots):
        feed.add(dealt[i::lots], RATING)
    feed.add([(None, None, None, FAR)], RATING)
    written = feed.run(jobs.stream_driver_ratings(feed.stream(), feed.checkpoint, feed.out, once=True, delay="1 day"))
    want = brute_alerts(rows)
    assert {tuple(r) for r in jobs.rating_alerts(written).select("rated_user_id", "rating_id", "n").collect()} == want and len(want) > 4


CHANGE = "ride_id BIGINT, driver_id BIGINT, status STRING, changed_at TIMESTAMP_NTZ"


def test_trip_counts_drop_repeats_and_keep_late_events(feed, frame, spark):
    def change(ride, minute, status="completed", driver=1):
        return (ride, driver, status, T0 + dt.timedelta(minutes=minute))
    feed.add([change(1, 500), change(2, 501), change(3, 502, "cancelled"), change(4, 503, driver=None)], CHANGE)
    feed.add([change(1, 504), change(5, 505)], CHANGE)
    feed.add([change(6, 10)], CHANGE)        # hours late
    feed.add([change(7, 506, driver=2)], CHANGE)
    written = feed.run(jobs.stream_trip_counts(feed.stream(), feed.checkpoint, feed.out, once=True))
    assert {(r["driver_id"], r["total_trips"]) for r in jobs.latest(written, "driver_id").collect()} == {(1, 4), (2, 1)}
    base = feed.run(jobs.stream_trip_counts(feed.stream(), feed.checkpoint + "2", feed.out + "2", once=True,
                                            start_from=lambda: frame([dict(driver_id=1, total_trips=10)], "drivers")))
    assert base is not None
    written = spark.read.parquet(feed.out + "2")
    assert {(r["driver_id"], r["total_trips"]) for r in jobs.latest(written, "driver_id").collect()} == {(1, 14), (2, 1)}


EVENT = "event_id BIGINT, ride_id BIGINT, kind STRING, happened_at TIMESTAMP_NTZ"


def test_closures_first_one_counts(feed, frame):
    import inspect
    assert "read.parquet" not in inspect.getsource(jobs) and ".out" not in inspect.getsource(jobs.stream_ride_closures)
    rides = frame([dict(ride_id=i, status="cancelled" if i == 2 else "completed", fare=D(i)) for i in range(1, 5)], "rides")
    history = frame([dict(ride_id=3, outcome="completed", final_fare=D(3))], "ride_history")
    feed.add([(1, 1, "paid", T0), (2, 2, "paid", T0), (3, 3, "paid", T0)], EVENT)
    feed.add([(4, 2, "cancelled", T0), (5, 1, "paid", T0), (6, 4, "cancelled", T0), (7, 4, "paid", T0 + dt.timedelta(1))], EVENT)

    def run():
        return feed.run(jobs.stream_ride_closures(feed.stream(), lambda: rides, history, feed.checkpoint, feed.out,
                                                  "2000-01-02 00:00:00", once=True))
    want = {(1, "completed", D("1.00")), (2, "cancelled", D("2.00")), (4, "cancelled", D("4.00"))}
    assert {tuple(r)[:3] for r in run().select("ride_id", "outcome", "final_fare").collect()} == want
    feed.add([(8, 1, "cancelled", T0)], EVENT)   # restart goes on behind what is done
    assert {tuple(r)[:3] for r in run().select("ride_id", "outcome", "final_fare").collect()} == want


TRIP = "trip_id BIGINT, submitted_at TIMESTAMP_NTZ, ride_id BIGINT, distance STRING, duration STRING"
END = (None, FAR, None, None, None)


def form(trip, minute, ride, distance):
    return (trip, T0 + dt.timedelta(minutes=minute), ride, distance, "5")


def fares_of(feed, frame, rides, **options):
    return feed.run(jobs.stream_rate_fares(feed.stream(), lambda: rides, lambda: frame([], "fare_rules"),
                                           feed.checkpoint, feed.out, once=True, **options))


def test_first_form_counts_in_any_order(feed, frame):
    rides = frame([dict(ride_id=i, rider_id=1, driver_id=1) for i in (1, 2)], "rides")
    feed.add([form(1, 9, 1, "99"), form(2, 5, 2, "1.5"), form(3, 1, 2, "0"), form(None, 2, 3, "4")], TRIP)
    feed.add([form(4, 3, 1, "10"), form(5, 5, 2, "99"), form(1, 9, 1, "99")], TRIP)  # 4 comes later but is earlier than 1
    feed.add([END], TRIP)
    written = fares_of(feed, frame, rides)
    assert sorted(tuple(r) for r in jobs.refused_forms(written).select("trip_id", "reason").collect()) == [
        (1, "repeated_form"), (3, "distance_not_positive"), (5, "repeated_form")]
    fares = jobs.rated_fares(written).select("ride_id", F.col("fare").cast("int").alias("fare"))
    assert {tuple(r) for r in fares.collect()} == {(1, 260), (2, 90)}
    assert jobs.refused_forms(written, "late").count() == 0


def test_late_forms_go_to_a_batch_run(feed, frame, spark):
    """On time and late forms are all forms, and a batch run over the late ones repeats nothing the stream has done."""
    from cabledger.plans.fares import finish_trips
    rides = frame([dict(ride_id=i, rider_id=1, driver_id=1, status="in_progress") for i in (1, 2, 3)], "rides")
    feed.add([form(1, 10, 1, "10"), form(2, 100, 2, "1.5")], TRIP)
    feed.add([form(1, 10, 1, "10"), form(3, 11, 1, "20"), form(4, 12, 3, "7")], TRIP)   # behind 100 - 60: late
    feed.add([END], TRIP)
    written = fares_of(feed, frame, rides)
    late = jobs.refused_forms(written, "late").drop("reason")
    assert sorted(r["trip_id"] for r in late.collect()) == [1, 3, 4]
    state = {"rides": rides, "fare_rules": frame([], "fare_rules"), "drivers": frame([dict(driver_id=1, user_id=9, total_trips=0)], "drivers"),
             "wallet": frame([dict(user_id=9, balance=D(0))], "wallet"), "payments": frame([], "payments"),
             "driver_earnings": frame([], "driver_earnings"), "ride_history": frame([], "ride_history")}
    new = finish_trips(late, state, "2000-01-02 00:00:00", jobs.stream_ledger(written))
    assert [r["ride_id"] for r in new["rated"].collect()] == [3]
    assert [tuple(r) for r in new["rejected"].select("trip_id", "reason").collect()] == [(3, "repeated_form")]


def test_state_does_not_grow_with_the_stream(feed, frame):
    rides = frame([dict(ride_id=i, rider_id=1, driver_id=1) for i in range(400)], "rides")
    for lot in range(8):
        feed.add([form(lot * 50 + i, lot * 120 + i % 60 + 1, lot * 50 + i, "5") for i in range(50)], TRIP)
    feed.add([END], TRIP)
    query = jobs.stream_rate_fares(feed.stream(), lambda: rides, lambda: frame([], "fare_rules"), feed.checkpoint, feed.out, once=True)
    assert jobs.rated_fares(feed.run(query)).count() == 400
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    # A waiting form has four rows (form, timer, two indexes of it), a finished ride as many; only some two lots are held.
    assert max(rows) <= 3 * 50 * 5 and max(rows[4:]) <= max(rows[:4]) * 1.5


class Calls:
    """State of one bucket in memory, with the number of calls on it."""

    def __init__(self):
        self.rows, self.value, self.timers, self.n = [], None, [], 0

    def getListState(self, name, schema):
        return List(self)

    def getValueState(self, name, schema):
        return Value(self)

    def registerTimer(self, ms):
        self.n += 1
        self.timers.append(ms)

    def deleteTimer(self, ms):
        self.n += 1
        self.timers.remove(ms)


class List:
    def __init__(self, calls):
        self.calls, self.rows = calls, []

    def get(self):
        self.calls.n += 1
        return iter(list(self.rows))

    def put(self, rows):
        self.calls.n += 1
        self.rows = list(rows)

    def appendList(self, rows):
        self.calls.n += 1
        self.rows += rows

    def clear(self):
        self.put([])


class Value:
    def __init__(self, calls):
        self.calls, self.value = calls, None

    def get(self):
        self.calls.n += 1
        return self.value

    def update(self, value):
        self.calls.n += 1
        self.value = value

    def clear(self):
        self.update(None)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_bucket_of_rides_takes_few_state_calls():
    import pandas as pd

    from cabledger.streaming.state import ROW, FirstForms
    state, forms = Calls(), FirstForms(keep_ms=60)
    forms.init(state)

    def sent(rows, watermark):
        frame = pd.DataFrame([(ride, f"#{n}", ms * 1000, n, "", "{}") for n, ride, ms in rows], columns=ROW)
        return [tuple(r) for out in forms.handleInputRows((0,), iter([frame]), Watermark(watermark)) for r in out.itertuples(index=False)]

    def passed(watermark):
        assert state.timers.pop() < watermark and not state.timers
        return [tuple(r) for out in forms.handleExpiredTimer((0,), Watermark(watermark), None) for r in out.itertuples(index=False)]

    assert sent([(i, i % 1000, 100 + i % 2) for i in range(1000)] * 2 + [(5000, 7, 102)], 0) == []
    out = passed(100)    # a row at the watermark is ripe
    assert len(out) == 500 and {r[:3] for r in out} == {(i, "rated", f"#{i}") for i in range(0, 1000, 2)}
    out = passed(102)
    assert len(out) == 501 and (7, "rejected", "#5000", "repeated_form", "{}") in out
    assert sent([(6000, 8, 102), (6001, 8, 103), (6001, 8, 104), (6002, 9, 170)], 102) == [(8, "late", "#6000", None, "{}")]
    assert passed(103) == [(8, "rejected", "#6001", "repeated_form", "{}")]
    assert passed(161) == [] and passed(170) == [(9, "rated", "#6002", None, "{}")]    # ride 9 was forgotten at 161
    assert state.n < 70


def test_closures_keep_their_state_without_a_group_per_ride(feed, frame):
    """The state is an aggregate of the engine; it also tells the order of two kinds within a batch, and rides of the history."""
    rides = frame([dict(ride_id=i, status="completed", fare=D(i)) for i in range(1, 5)], "rides")
    history = frame([dict(ride_id=3, outcome="completed", final_fare=D(3))], "ride_history")
    day = dt.timedelta(1)
    feed.add([(1, 1, "paid", T0), (2, 1, "cancelled", T0 - day), (3, 2, "cancelled", T0), (4, 2, "paid", T0 - day)], EVENT)
    feed.add([(5, 3, "cancelled", T0), (6, 4, "paid", T0), (7, 4, "cancelled", T0), (8, None, "paid", T0), (9, 1, "lost", T0)], EVENT)
    query = jobs.stream_ride_closures(feed.stream(), lambda: rides, history, feed.checkpoint, feed.out, "2000-01-02 00:00:00", once=True)
    found = feed.run(query).select("ride_id", "outcome").collect()
    assert sorted(tuple(r) for r in found) == [(1, "cancelled"), (2, "completed"), (4, "completed")]
    assert {o["operatorName"] for p in query.recentProgress for o in p["stateOperators"]} == {"stateStoreSave"}
