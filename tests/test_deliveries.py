"""Forms that arrive again, forms without ids, and requests that compete for codes and balances."""

import datetime as dt
import random

import pytest

from cabledger.operators import allocation
from cabledger.operators.deliveries import FORM, ledger, once

T0 = dt.datetime(2000, 1, 1)
DDL = "id BIGINT, at TIMESTAMP_NTZ, v STRING"


def test_once_per_id_or_content(frame):
    rows = [(1, 2, "b"), (1, 1, "z"), (1, 1, "a"), (2, 5, None), (2, 5, None), (None, 3, "x"), (None, 3, "x"), (None, 3, "y"), (None, None, None)]
    forms = frame([dict(id=i, at=m and T0 + dt.timedelta(minutes=m), v=v) for i, m, v in rows], ddl=DDL)
    got = once(forms, "id", ["at"])
    assert sorted(((r["id"], r["v"]) for r in got.collect()), key=str) == sorted(
        [(1, "a"), (2, None), (None, "x"), (None, "y"), (None, None)], key=str)
    assert got.select(FORM).distinct().count() == 5
    done = ledger(got.filter("v = 'x' OR id = 1"))
    assert sorted((r["id"] or 0, r["v"] or "") for r in once(forms, "id", ["at"], done).collect()) == [(0, ""), (0, "y"), (2, "")]


def walk(requests, left, balance):
    """The requests one after another."""
    left, balance, taken, out = dict(left), dict(balance), set(), {}
    for form, ts, i, user, item, code, takes, cents in sorted(requests, key=lambda r: (r[1], r[2], r[0])):
        if (user, item) in taken:
            out[form] = "item_taken"
        elif code is not None and left.get(code, 0) <= 0:
            out[form] = "code_used_up"
        elif cents is not None and balance.get(user, -1) < cents:
            out[form] = "balance_short"
        else:
            out[form] = None
            taken.add((user, item))
            if code is not None:
                left[code] -= takes
            if cents is not None:
                balance[user] -= cents
    return out


@pytest.mark.parametrize("seed,hot_rows", [(1, 1 << 30), (2, 1 << 30), (3, 0), (4, 12)])
def test_allocation_equals_the_walk(spark, seed, hot_rows):
    """Tied times, users without a wallet, codes that are used up from the start, and amounts near the balances."""
    rng = random.Random(seed)
    requests = [(f"f{i}", T0 + dt.timedelta(minutes=rng.randint(0, 40)), rng.choice([i, i, 7]), rng.randint(1, 8), rng.randint(1, 9),
                 rng.choice([None, 1, 1, 2, 3, 4]), rng.choice([0, 1, 1, 1]), rng.choice([None, 0, 5, 40, 60, 90])) for i in range(160)]
    left, balance = {1: 9, 2: 4, 3: 0, 4: 1000}, {u: 150 for u in range(1, 8)}
    frame = spark.createDataFrame(requests, "form STRING, ts TIMESTAMP_NTZ, id BIGINT, user BIGINT, item BIGINT, code BIGINT, takes INT, cents BIGINT")
    got = allocation.allocate(frame, spark.createDataFrame(list(left.items()), "code BIGINT, left BIGINT"),
                              spark.createDataFrame(list(balance.items()), "user BIGINT, cents BIGINT"), hot_rows)
    want = walk(requests, left, balance)
    assert {r["form"]: r["reason"] for r in got.collect()} == want
    assert {r["form"] for r in got.filter("granted").collect()} == {f for f, why in want.items() if why is None}
    assert len(set(want.values())) == 4


def test_a_chain_of_users_and_codes_takes_few_rounds(spark, monkeypatch):
    """Each refusal frees a use that another user's payment takes, which makes that user short, and so on."""
    n, rounds = 12, []
    requests = []
    for u in range(n):
        requests += [(f"a{u}", T0 + dt.timedelta(minutes=2 * u), 2 * u, u, 1, u, 1, 60), (f"b{u}", T0 + dt.timedelta(minutes=2 * u + 1), 2 * u + 1, u, 2, u + 1, 1, 60)]
    frame = spark.createDataFrame(requests, "form STRING, ts TIMESTAMP_NTZ, id BIGINT, user BIGINT, item BIGINT, code BIGINT, takes INT, cents BIGINT")
    left, balance = {k: 1 for k in range(n + 1)}, {u: 100 for u in range(n)}
    real = allocation._user_states
    monkeypatch.setattr(allocation, "_user_states", lambda *a: rounds.append(1) or real(*a))
    got = allocation.allocate(frame, spark.createDataFrame(list(left.items()), "code BIGINT, left BIGINT"),
                              spark.createDataFrame(list(balance.items()), "user BIGINT, cents BIGINT"))
    assert {r["form"]: r["reason"] for r in got.collect()} == walk(requests, left, balance)
    assert len(rounds) <= n + 2
