"""Every job that takes forms, over forms delivered twice and over two runs with forms that come again.

Each must give what one run over forms delivered once gives, so the SQL is that of the plain query.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from cabledger.plans import accounts, dispatch, fares, feedback, payments, promos, wallets
from cabledger.session import materialize
from cabledger.sources.star import AS_OF, star_tables

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Job:
    """A job over ``forms``; ``first`` parts them in time, ``outputs`` names the query that each new table is checked by."""

    forms: str
    first: str
    again: str
    outputs: Mapping[str, str]
    run: Callable[[DataFrame, Tables, DataFrame | None], dict[str, DataFrame]]
    #: Tables under another name than in the fixtures.
    state: Mapping[str, str] | None = None
    #: Outputs that hold new rows only, so those of two runs are put together.
    added: tuple[str, ...] = ("rejected",)


JOBS = {
    "finish_trips": Job(
        "raw_trips", "submitted_at < TIMESTAMP_NTZ '1999-12-01 00:31:00'", "ride_id % 3 = 0",
        {"rides": "complete_rides", "drivers": "complete_rides_drivers", "ride_history": "complete_rides_ride_history", "wallet": "credit_wallets",
         "driver_earnings": "post_earnings", "payments": "open_payments", "rejected": "complete_rides_rejected"},
        lambda f, t, applied: fares.finish_trips(f, t, AS_OF, applied),
        {"driver_earnings": "earnings_before", "payments": "payments_before", "ride_history": "history_before"}),
    "pay_rides": Job(
        "payment_requests", "requested_at < TIMESTAMP_NTZ '1996-01-01 00:00:00'", "ride_id % 3 = 0",
        {"payments": "settle_payments", "wallet": "settle_payments_wallet", "promo_codes": "settle_payments_promo_codes", "rejected": "pay_rides_rejected"},
        lambda f, t, applied: payments.pay_rides(f, t, AS_OF, applied)),
    "accept_ratings": Job(
        "raw_ratings", "rated_at < TIMESTAMP_NTZ '1996-01-01 00:00:00'", "ride_id % 3 = 0",
        {"ratings": "accept_ratings", "accepted": "accept_ratings_accepted", "rejected": "accept_ratings_rejected"},
        lambda f, t, applied: feedback.accept_ratings(f, t["rides"], t["ratings"], t["drivers"], applied), added=("rejected", "accepted")),
    "book_rides": Job(
        "raw_bookings", "ride_id < 20000030", "ride_id % 3 = 0",
        {"rides": "book_rides", "locations": "book_rides_locations", "rejected": "book_rides_rejected"},
        lambda f, t, applied: dispatch.book_rides(f, t["rides"], t["fare_rules"], AS_OF, t["locations"], applied), added=("rejected", "locations")),
    "register_users": Job(
        "raw_registrations", "submitted_at < TIMESTAMP_NTZ '1999-12-01 01:03:00'", "user_id % 3 = 0",
        {"users": "register_users", "drivers": "register_users_drivers", "wallet": "register_users_wallet", "rejected": "register_users_rejected"},
        lambda f, t, applied: accounts.register_users(f, t["users"], t["drivers"], AS_OF, applied), added=("rejected", "wallet")),
    "add_vehicles": Job(
        "raw_vehicles", "submitted_at < TIMESTAMP_NTZ '1999-12-01 01:03:00'", "vehicle_id % 3 = 0",
        {"vehicles": "add_vehicles", "rejected": "add_vehicles_rejected"},
        lambda f, t, applied: accounts.add_vehicles(f, t["vehicles"], AS_OF, applied)),
    "create_promos": Job(
        "raw_promos", "submitted_at < TIMESTAMP_NTZ '1999-12-01 01:03:00'", "promo_id % 3 = 0",
        {"promo_codes": "create_promos", "rejected": "create_promos_rejected"},
        lambda f, t, applied: promos.create_promos(f, t["promo_codes"], applied)),
    "top_up_wallets": Job(
        "raw_topups", "requested_at < TIMESTAMP_NTZ '1996-01-01 01:00:00'", "user_id % 3 = 0",
        {"wallet": "top_up_wallets", "rejected": "top_up_wallets_rejected"},
        lambda f, t, applied: wallets.top_up_wallets(f, t["wallet"], applied)),
}

#: Jobs over changes that need no ledger: the last change of a key stands however often it is sent.
CHANGES = {
    "accept_rides": (["rides", "drivers", "rejected"], lambda t: dispatch.accept_rides(
        t["twice_accept_attempts"], t["rides"], t["drivers"], t["vehicles"])),
    "advance_status": (["rides", "illegal"], lambda t: dispatch.advance_status(t["twice_status_changes"], t["rides_before"])),
    "apply_status_changes": (["table", "rejected"], lambda t: accounts.apply_status_changes(
        t["users"], t["twice_account_changes"], "user_id", "acc_status", ["active", "suspended", "banned"])),
}


def _state(job: Job, t: Tables) -> Tables:
    class State(dict):
        def __missing__(self, name: str) -> DataFrame:
            return t[(job.state or {}).get(name, name)]
    return State()


def twice(job: Job, t: Tables) -> dict[str, DataFrame]:
    return job.run(t[f"twice_{job.forms}"], _state(job, t), None)


def in_two_runs(job: Job, t: Tables) -> dict[str, DataFrame]:
    """A run over the first forms, then one over the rest and some of the first ones again, each delivered twice."""
    forms, state = t[f"twice_{job.forms}"], _state(job, t)
    one = job.run(forms.filter(job.first), state, None)
    kept = {k: materialize(one[k]) for k in [*job.outputs, "applied"]}
    state.update({k: v for k, v in kept.items() if k not in (*job.added, "applied")})
    two = job.run(forms.filter(f"NOT ({job.first}) OR {job.again}"), state, kept["applied"])
    return {k: kept[k].unionByName(two[k]) if k in job.added else two[k] for k in job.outputs}


def delivery_queries() -> dict[str, Callable]:
    out: dict[str, Callable] = {}
    for job in JOBS.values():
        for key, query in job.outputs.items():
            out[f"twice_{query}"] = lambda spark, sf_dir, job=job, key=key: twice(job, star_tables(spark, sf_dir))[key]
            out[f"resumed_{query}"] = lambda spark, sf_dir, job=job, key=key: in_two_runs(job, star_tables(spark, sf_dir))[key]
    for name, (keys, run) in CHANGES.items():
        for i, key in enumerate(keys):
            query = name if i == 0 else f"{name}_{key}"
            out[f"twice_{query}"] = lambda spark, sf_dir, run=run, key=key: run(star_tables(spark, sf_dir))[key]
    return out


def delivery_sql(sql: Mapping[str, str]) -> dict[str, str]:
    return {name: sql[name.split("_", 1)[1]] for name in delivery_queries()}
