"""Accounts, vehicles and status changes made by people."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cabledger import schema
from cabledger.functions.text import folded, trimmed, unfolded, whole
from cabledger.operators.deliveries import FORM, ledger, once
from cabledger.operators.forms import check_registration, check_vehicle, failed, passed
from cabledger.operators.pick import first_per_key, last_per_key
from cabledger.session import materialize
from cabledger.sources.sinks import update_join

c = F.col


def register_users(forms: DataFrame, users: DataFrame, drivers: DataFrame, as_of: str,
                   applied: DataFrame | None = None) -> dict[str, DataFrame]:
    """Valid forms become users, and driver and wallet rows with them.

    ``forms`` holds user_id, driver_id, submitted_at and the text fields. E-mail, phone, identity card and
    licence must be unused, by the tables and by forms accepted before in the same batch. Each form counts once; those in
    the ledger ``applied`` of earlier runs are left out.
    """
    checked = materialize(check_registration(once(forms, "user_id", ["submitted_at"], applied)))
    clean = passed(checked).withColumns({
        "full_name": trimmed(c("full_name")), "email": F.lower(trimmed(c("email"))), "phone": trimmed(c("phone")),
        "cnic": F.when(c("role") == "driver", trimmed(c("cnic"))),
        "license_num": F.when(c("role") == "driver", trimmed(c("license_num"))),
    })
    keys = ["email", "phone", "cnic", "license_num"]
    folds = {f"_{k}": folded(c(k)) for k in keys}
    pool = clean.withColumns(folds).select("user_id", "submitted_at", FORM, *folds)
    for column, table in [("email", users), ("phone", users), ("cnic", drivers), ("license_num", drivers)]:
        pool = pool.join(table.select(folded(c(column)).alias(f"_{column}")), f"_{column}", "left_anti")
    taken = first_come(pool, list(folds), ["submitted_at", "user_id", FORM], FORM)
    kept = clean.join(taken, FORM, "left_semi")
    refused = clean.join(taken, FORM, "left_anti").withColumn("reason", F.lit("already_registered"))
    new_users = kept.withColumn("acc_status", F.lit("active")).withColumn("registration_date", F.lit(as_of))
    new_drivers = kept.filter(c("role") == "driver").select(
        "driver_id", "user_id", "cnic", "license_num", F.lit("pending").alias("verify_status"),
        F.lit("offline").alias("avail_status"), F.lit(0).alias("avg_rating"), F.lit(0).alias("total_trips"))
    new_wallets = kept.select("user_id", F.lit(0).alias("balance"), F.lit("none").alias("payout_status"))
    return {
        "users": users.unionByName(schema.conform(new_users, "users")),
        "drivers": drivers.unionByName(schema.conform(new_drivers, "drivers")),
        "wallet": schema.conform(new_wallets, "wallet"),
        "rejected": failed(checked).select("user_id", "reason").unionByName(refused.select("user_id", "reason")),
        "applied": ledger(checked, applied),
    }


def first_come(pool: DataFrame, keys: Sequence[str], order: Sequence[str], id_col: str) -> DataFrame:
    """Ids accepted when rows are taken in order and a row is refused if any of its keys is taken.

    In rounds: a row that is the first undecided one for all of its keys is accepted, and every row sharing
    a key with it is refused. NULL keys clash with nothing. Rounds go on until no row is undecided; each
    settles the head of every chain of clashing rows.
    """
    undecided = materialize(pool.select(*keys, F.struct(*order).alias("_at"), id_col))
    accepted: DataFrame | None = None
    while accepted is None or not undecided.isEmpty():
        heads = undecided
        for key in keys:
            first = undecided.filter(c(key).isNotNull()).groupBy(key).agg(F.min("_at").alias("_first"))
            heads = heads.join(first, key, "left").filter(c("_first").isNull() | (c("_first") == c("_at"))).drop("_first")
        heads = materialize(heads.select(*keys, id_col))
        rest = undecided.join(heads.select(id_col), id_col, "left_anti")
        for key in keys:
            rest = rest.join(heads.select(key), key, "left_anti")
        accepted = heads.select(id_col) if accepted is None else accepted.unionByName(heads.select(id_col))
        undecided = materialize(rest.select(*keys, "_at", id_col))
    return accepted


def add_vehicles(forms: DataFrame, vehicles: DataFrame, as_of: str, applied: DataFrame | None = None) -> dict[str, DataFrame]:
    """Valid forms with an unused licence plate become pending vehicles; the first form of a plate wins.

    Each form counts once; those in the ledger ``applied`` of earlier runs are left out.
    """
    checked = materialize(check_vehicle(once(forms, "vehicle_id", ["submitted_at"], applied), as_of))
    good = passed(checked).withColumn("_plate", folded(F.upper(trimmed(c("license_plate")))))
    free = good.join(vehicles.select(folded(c("license_plate")).alias("_plate")), "_plate", "left_anti")
    first = first_per_key(free.select("_plate", "submitted_at", "vehicle_id", FORM), ["_plate"], ["submitted_at", "vehicle_id", FORM])
    taken = materialize(first.select(FORM))
    made = free.join(taken, FORM, "left_semi").select(
        "vehicle_id", "driver_id", trimmed(c("make")).alias("make"), trimmed(c("model")).alias("model"),
        whole(c("year")).alias("year"), trimmed(c("color")).alias("color"), unfolded(c("_plate")).alias("license_plate"),
        "vehicle_type", F.lit("pending").alias("verify_status"))
    double = good.join(taken, FORM, "left_anti").withColumn("reason", F.lit("plate_exists"))
    return {
        "vehicles": vehicles.unionByName(schema.conform(made, "vehicles")),
        "rejected": failed(checked).drop(FORM).unionByName(double.select(*forms.columns, "reason")),
        "applied": ledger(checked, applied),
    }


def apply_status_changes(table: DataFrame, changes: DataFrame, key: str, column: str,
                         allowed: Sequence[str]) -> dict[str, DataFrame]:
    """Set ``column`` from changes (change_id, key, new_status, changed_at); the last allowed one counts.

    A change delivered twice counts once.
    """
    changes = once(changes, "change_id", ["changed_at"]).drop(FORM)
    fits = F.coalesce(c("new_status").isin(list(allowed)), F.lit(False))
    last = last_per_key(changes.filter(fits).select(key, "new_status", "changed_at", "change_id"), [key],
                        ["changed_at", "change_id"])
    return {
        "table": update_join(table, last, [key], {column: c("_d_new_status")}, carry=["new_status"]),
        "rejected": changes.filter(~fits).withColumn("reason", F.lit("status_not_allowed")),
    }


def toggle_availability(drivers: DataFrame, toggles: DataFrame) -> DataFrame:
    """Apply each driver's toggles (driver_id, one row per press).

    A press takes an online driver offline and anyone else online, so only the number of presses matters.
    """
    presses = toggles.groupBy("driver_id").agg(F.count(F.lit(1)).alias("presses"))
    odd = c("_d_presses") % 2 == 1
    ends_online = F.when(c("avail_status") == "online", ~odd).otherwise(odd)
    return update_join(drivers, presses, ["driver_id"],
                       {"avail_status": F.when(ends_online, "online").otherwise("offline")}, carry=["presses"])
