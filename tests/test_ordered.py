"""Running values and spending order, with every key forced through the spread form."""

import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cabledger.operators.ordered import numbered, previous, running_sum
from cabledger.operators.pick import first_per_key, last_per_key, top_per_key
from cabledger.operators.spending import allow_in_order
from cabledger.plans.accounts import first_come

DDL = "k BIGINT, ts TIMESTAMP_NTZ, id BIGINT, v BIGINT"


def skewed(n, seed):
    """Rows of which a third share one key, with repeated times."""
    import datetime as dt
    rnd = random.Random(seed)
    start = dt.datetime(2000, 1, 1)
    return [(0 if i % 3 == 0 else rnd.randrange(1, 20), start + dt.timedelta(minutes=rnd.randrange(40)), i,
             rnd.randrange(-50, 50)) for i in range(n)]


def by_key(rows):
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        groups[r[0]].append(r)
    return groups


@pytest.mark.parametrize("hot_rows", [10_000, 100, 0])
def test_running_values(spark, hot_rows):
    rows = skewed(900, 1)
    df = spark.createDataFrame(rows, DDL)
    want_sum, want_rn, want_prev = {}, {}, {}
    for group in by_key(rows).values():
        total, before = 0, None
        for n, r in enumerate(group, 1):
            total += r[3]
            want_sum[r[2]], want_rn[r[2]], want_prev[r[2]] = total, n, before
            before = r[3]
    got = running_sum(df, ["k"], ["ts", "id"], F.col("v"), "out", hot_rows)
    assert {r["id"]: r["out"] for r in got.collect()} == want_sum
    assert {r["id"]: r["out"] for r in numbered(df, ["k"], ["ts", "id"], "out", hot_rows).collect()} == want_rn
    assert {r["id"]: r["out"] for r in previous(df, ["k"], ["ts", "id"], "v", "out", hot_rows).collect()} == want_prev


def test_picks(spark):
    rows = skewed(300, 2)
    df = spark.createDataFrame(rows, DDL)
    groups = by_key(rows)
    assert {tuple(r) for r in first_per_key(df, ["k"], ["ts", "id"]).collect()} == {g[0] for g in groups.values()}
    assert {tuple(r) for r in last_per_key(df, ["k"], ["ts", "id"]).collect()} == {g[-1] for g in groups.values()}
    top = top_per_key(df, ["k"], [F.desc("ts"), F.desc("id")], 3)
    assert {tuple(r) for r in top.collect()} == {r for g in groups.values() for r in g[-3:]}
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def brute_spending(spendings, balances):
    left, out = dict(balances), {}
    for user, ts, id, amount in sorted(spendings, key=lambda r: (r[0], r[1], r[2])):
        out[id] = user in left and amount <= left[user]
        if out[id]:
            left[user] -= amount
    return out


@pytest.mark.parametrize("hot_rows", [10_000, 20, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_spending_in_order(spark, hot_rows, seed):
    rnd = random.Random(seed)
    sizes = [1, 5, 50, 3000, 100_000]
    spendings = [(r[0], r[1], r[2], Decimal(rnd.choice([0, 1, rnd.randrange(1, 64), rnd.randrange(1, rnd.choice(sizes) * 100)])) / 100)
                 for r in skewed(800, seed)]
    balances = [(u, Decimal(rnd.choice([0, 1, 63, 64, 65, 5000, 200_000, 10**9 - 1])) / 100) for u in range(18)]
    df = spark.createDataFrame(spendings, "user_id BIGINT, ts TIMESTAMP_NTZ, id BIGINT, amount DECIMAL(10,2)")
    bal = spark.createDataFrame(balances, "user_id BIGINT, balance DECIMAL(10,2)")
    got = {r["id"]: r["allowed"] for r in allow_in_order(df, bal, hot_rows=hot_rows).collect()}
    assert got == brute_spending(spendings, balances)


def test_spending_small_steps(spark):
    """A falling sequence between small spendings, which needs many refusals, still takes few rounds."""
    import datetime as dt
    t0 = dt.datetime(2000, 1, 1)
    amounts = [a for i in range(200) for a in (1, 1000 - i)]
    spendings = [(1, t0, i, Decimal(a) / 100) for i, a in enumerate(amounts)]
    df = spark.createDataFrame(spendings, "user_id BIGINT, ts TIMESTAMP_NTZ, id BIGINT, amount DECIMAL(10,2)")
    bal = spark.createDataFrame([(1, Decimal("10.00"))], "user_id BIGINT, balance DECIMAL(10,2)")
    got = {r["id"]: r["allowed"] for r in allow_in_order(df, bal, hot_rows=0).collect()}
    assert got == brute_spending(spendings, {1: Decimal("10.00")})


def test_first_come(spark):
    """Chains of clashes: a refused row takes no key away from later rows."""
    rnd = random.Random(3)
    rows = [(rnd.randrange(60), None if i % 7 == 0 else rnd.randrange(60), i) for i in range(200)]
    taken, want = [set(), set()], set()
    for a, b, i in rows:
        if a not in taken[0] and (b is None or b not in taken[1]):
            want.add(i)
            taken[0].add(a)
            taken[1].add(b)
    df = spark.createDataFrame(rows, "a BIGINT, b BIGINT, i BIGINT")
    assert {r["i"] for r in first_come(df, ["a", "b"], ["i"], "i").collect()} == want
