"""Matching equals the walk ride by ride, whatever the number of drivers matched at a time."""

import datetime as dt
import random

import pytest

from cabledger.operators import matching

T0 = dt.datetime(2000, 1, 1)


def walk(rides, drivers, refused):
    free, out = sorted(drivers, key=lambda d: (d[1], d[0])), set()
    for ride, at, kind in sorted(rides, key=lambda r: (r[1], r[0])):
        for d in free:
            if kind in d[2] and (ride, d[0]) not in refused:
                out.add((ride, d[0]))
                free.remove(d)
                break
    return out


def frames(spark, rides, drivers, refused):
    return (spark.createDataFrame(rides, "ride_id long, created_at timestamp_ntz, kind string"),
            spark.createDataFrame(drivers, "driver_id long, place int, kinds array<string>"),
            spark.createDataFrame(sorted(refused), "ride_id long, driver_id long"))


@pytest.mark.parametrize("seed,chunk", [(1, 1000), (2, 7), (3, 2), (4, 30)])
def test_equals_the_walk(spark, seed, chunk):
    rng = random.Random(seed)
    rides = [(i, T0 + dt.timedelta(minutes=rng.randint(0, 30)), rng.choice("aaabbc")) for i in range(60)]
    drivers = [(100 + i, rng.randint(0, 5), rng.sample("abc", rng.randint(1, 3))) for i in range(25 if seed % 2 else 70)]
    refused = {(rng.randrange(60), 100 + rng.randrange(70)) for _ in range(150)}
    refused |= {(r, 100) for r in range(55)} | {(5, 100 + d) for d in range(70)}   # a driver who refused nearly all, a ride refused by all
    got = matching.match(*frames(spark, rides, drivers, refused), chunk)
    assert sorted(tuple(r) for r in got.collect()) == sorted(walk(rides, drivers, refused))


def test_rounds_follow_the_drivers_not_the_refusals(spark, monkeypatch):
    """A chain: every ride is refused by all drivers that are better than the one it gets."""
    n, tasks = 24, []
    rides = [(i, T0 + dt.timedelta(minutes=i), "a") for i in range(n)]
    drivers = [(i, i, ["a"]) for i in range(n)]
    refused = {(r, d) for r in range(n) for d in range(n - 1 - r)}
    real = matching._walked
    monkeypatch.setattr(matching, "_walked", lambda *a: tasks.append(1) or real(*a))
    got = matching.match(*frames(spark, rides, drivers, refused), 30)
    assert {tuple(r) for r in got.collect()} == walk(rides, drivers, refused) and len(tasks) == 1


def test_nothing_to_match(spark):
    rides, drivers, refused = frames(spark, [(1, T0, "a")], [(1, 1, ["a"])], {(1, 1)})
    assert matching.match(rides, drivers, refused).count() == 0
    assert matching.match(rides.limit(0), drivers, refused).count() == 0 == matching.match(rides, drivers.limit(0), refused).count()
