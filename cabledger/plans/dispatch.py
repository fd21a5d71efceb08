"""Getting drivers to rides: booking, matching, accepting and moving a ride along."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cabledger import schema
from cabledger.functions.text import number, trimmed
from cabledger.operators.deliveries import FORM, ledger, once
from cabledger.operators.forms import check_booking
from cabledger.operators.matching import CHUNK, match
from cabledger.operators.ordered import HOT_ROWS, previous
from cabledger.operators.pick import first_per_key, last_per_key
from cabledger.plans.trips import pricing_rule_lookup, riders_with_active_ride
from cabledger.session import materialize
from cabledger.sources.sinks import update_join

c = F.col


def book_rides(requests: DataFrame, rides: DataFrame, fare_rules: DataFrame, as_of: str, locations: DataFrame | None = None,
               applied: DataFrame | None = None) -> dict[str, DataFrame]:
    """Turn booking forms into requested rides with two new places each.

    A rider with a live ride is turned away, and so is every form after a rider's first good one. Forms
    carry ride_id, rider_id and requested_at; the places get the ids 2 x ride_id and 2 x ride_id + 1, and a form whose
    places have ids that ``locations`` holds already is turned away (``place_id_taken``). Each form counts once; those in
    the ledger ``applied`` of earlier runs are left out.
    """
    checked = materialize(check_booking(once(requests, "ride_id", ["requested_at"], applied), as_of))
    busy = riders_with_active_ride({"rides": rides}).withColumn("_busy", F.lit(True))
    reason = F.coalesce("first_error", F.when(c("_busy"), "active_ride"))
    tested = checked.join(busy, "rider_id", "left")
    if locations is not None:
        held = locations.select(F.expr("location_id div 2").alias("ride_id")).join(checked.select("ride_id"), "ride_id", "left_semi").distinct()
        tested = tested.join(held.withColumn("_held", F.lit(True)), "ride_id", "left")
        reason = F.coalesce(reason, F.when(c("_held"), "place_id_taken"))
    tested = tested.withColumn("reason", reason)
    free = tested.filter(c("reason").isNull())
    first = first_per_key(free.select("rider_id", "requested_at", "ride_id", FORM), ["rider_id"], ["requested_at", "ride_id", FORM])
    ranked = materialize(tested.join(first.select(FORM, F.lit(True).alias("_first")), FORM, "left").withColumn(
        "reason", F.when(c("reason").isNull() & c("_first").isNull(), "active_ride").otherwise(c("reason"))))
    booked = pricing_rule_lookup(ranked.filter(c("reason").isNull()), fare_rules)
    made = booked.select(
        "ride_id", "rider_id", (c("ride_id") * 2).alias("pickup_location_id"),
        (c("ride_id") * 2 + 1).alias("dropoff_location_id"), "rule_id", F.lit("requested").alias("status"),
        c("scheduled_at").try_cast("timestamp_ntz").alias("scheduled_at"), c("requested_at").alias("created_at"))

    def coordinate(column: str):
        return F.coalesce(number(c(column)), F.lit(0)).cast("decimal(10,7)")

    def place(end: str, offset: int):
        return F.struct((c("ride_id") * 2 + offset).alias("location_id"), coordinate(f"{end}_lat").alias("latitude"),
                        coordinate(f"{end}_lon").alias("longitude"), trimmed(c(f"{end}_address")).alias("address"),
                        trimmed(c(f"{end}_city")).alias("city"))
    places = booked.select(F.inline(F.array(place("pickup", 0), place("dropoff", 1))))
    return {
        "rides": rides.unionByName(schema.conform(made, "rides")),
        "locations": schema.conform(places, "locations"),
        "rejected": ranked.filter(c("reason").isNotNull()).select("ride_id", "rider_id", "reason"),
        "applied": ledger(checked, applied),
    }


def first_verified_vehicle(vehicles: DataFrame) -> DataFrame:
    """The verified vehicle with the lowest id of each driver."""
    return vehicles.filter(c("verify_status") == "verified").groupBy("driver_id").agg(
        F.min("vehicle_id").alias("vehicle_id"))


def match_drivers(rides: DataFrame, fare_rules: DataFrame, drivers: DataFrame, vehicles: DataFrame,
                  rejections: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One driver and vehicle per waiting ride, each driver at most once: ride by ride, the oldest first, each takes the best-rated free
    driver (then the lowest id) with a verified vehicle of its type whom it has no refusal from.

    A driver who holds an open offer is not free. Rides without a fare rule ask for economy. ``chunk`` drivers are matched at a
    time; the result is the same for any number.
    """
    rules = fare_rules.select("rule_id", "vehicle_type")
    waiting = rides.filter((c("status") == "requested") & c("driver_id").isNull()).select(
        "ride_id", "rule_id", "created_at").join(rules, "rule_id", "left").select(
        "ride_id", "created_at", F.coalesce("vehicle_type", F.lit("economy")).alias("kind"))
    online = drivers.filter((c("avail_status") == "online") & (c("verify_status") == "verified")).select(
        "driver_id", (-F.coalesce("avg_rating", F.lit(0))).alias("place"))
    cars = vehicles.filter(c("verify_status") == "verified").groupBy("driver_id", "vehicle_type").agg(
        F.min("vehicle_id").alias("vehicle_id"))
    offered = rides.filter((c("status") == "requested") & c("driver_id").isNotNull()).select("driver_id")
    ready = materialize(online.join(offered, "driver_id", "left_anti").join(cars, "driver_id"))
    waiting = materialize(waiting)
    owners = ready.groupBy("driver_id", "place").agg(F.collect_set("vehicle_type").alias("kinds"))  # of three types
    pairs = match(waiting, owners, rejections.select("ride_id", "driver_id").distinct(), chunk)
    return (pairs.join(waiting.select("ride_id", c("kind").alias("vehicle_type")), "ride_id")
            .join(ready.select("driver_id", "vehicle_type", "vehicle_id"), ["driver_id", "vehicle_type"])
            .select("ride_id", "driver_id", "vehicle_id"))


def assign_drivers(rides: DataFrame, matched: DataFrame) -> DataFrame:
    """Offer matched rides to their drivers; they stay requested."""
    offer = rides.filter(c("status") == "requested").select("ride_id").join(matched, "ride_id")
    return update_join(rides, offer, ["ride_id"], {"driver_id": c("_d_driver_id"), "vehicle_id": c("_d_vehicle_id")},
                       carry=["driver_id", "vehicle_id"])


def accept_rides(attempts: DataFrame, rides: DataFrame, drivers: DataFrame, vehicles: DataFrame) -> dict[str, DataFrame]:
    """The first eligible attempt gets a requested ride; winners go on trip.

    ``attempts`` holds ride_id, driver_id and attempted_at. A driver must be verified and own a verified
    vehicle, of whatever type.
    """
    verified = drivers.filter(c("verify_status") == "verified").select("driver_id", F.lit(True).alias("_verified"))
    wanted = rides.filter(c("status") == "requested").select("ride_id", F.lit(True).alias("_requested"))
    tested = materialize(
        attempts.select("ride_id", "driver_id", "attempted_at").distinct()
        .join(verified, "driver_id", "left").join(first_verified_vehicle(vehicles), "driver_id", "left")
        .join(wanted, "ride_id", "left")
        .withColumn("reason", F.when(c("_verified").isNull(), "driver_not_verified")
                    .when(c("vehicle_id").isNull(), "no_verified_vehicle")
                    .when(c("_requested").isNull(), "ride_not_requested")))
    eligible = tested.filter(c("reason").isNull())
    won = first_per_key(eligible.select("ride_id", "driver_id", "vehicle_id", "attempted_at"), ["ride_id"],
                        ["attempted_at", "driver_id"])
    winner = won.select("ride_id", c("driver_id").alias("_winner"), c("attempted_at").alias("_at"))
    lost = eligible.join(winner, "ride_id").filter(
        (c("driver_id") != c("_winner")) | (c("attempted_at") != c("_at"))).withColumn("reason", F.lit("ride_taken"))
    columns = ["ride_id", "driver_id", "attempted_at", "reason"]
    return {
        "rides": update_join(rides, won, ["ride_id"], {
            "status": F.lit("accepted"), "driver_id": c("_d_driver_id"), "vehicle_id": c("_d_vehicle_id")},
            carry=["driver_id", "vehicle_id"]),
        "drivers": update_join(drivers, won.select("driver_id").distinct(), ["driver_id"],
                               {"avail_status": F.lit("on_trip")}),
        "rejected": tested.filter(c("reason").isNotNull()).select(*columns).unionByName(lost.select(*columns)),
    }


# Statuses a driver may set on a running ride.
DRIVER_STEPS = ["driver_en_route", "in_progress"]


def advance_status(changes: DataFrame, rides: DataFrame, hot_rows: int = HOT_ROWS) -> dict[str, DataFrame]:
    """Apply status changes (change_id, ride_id, new_status, changed_at); the last one counts.

    Only the two driver steps are applied. ``illegal`` lists changes that were not applied because of their
    status, and applied ones that skip a step or go back in requested, accepted, en route, in progress,
    completed. A change delivered twice counts once.
    """
    changes = materialize(once(changes, "change_id", ["changed_at"]).drop(FORM))
    allowed = F.coalesce(c("new_status").isin(DRIVER_STEPS), F.lit(False))
    good = changes.filter(allowed).select("ride_id", "change_id", "new_status", "changed_at")
    last = last_per_key(good, ["ride_id"], ["changed_at", "change_id"])
    moved = previous(good, ["ride_id"], ["changed_at", "change_id"], "new_status", "_before", hot_rows).join(
        rides.select("ride_id", "status"), "ride_id").withColumn("old_status", F.coalesce("_before", "status"))
    steps = schema.RIDE_STATES[:5]
    skips = schema.sort_rank("new_status", steps) != schema.sort_rank("old_status", steps) + 1
    columns = ["change_id", "ride_id", "old_status", "new_status", "changed_at", "reason"]
    refused = changes.filter(~allowed).join(rides.select("ride_id", c("status").alias("old_status")), "ride_id")
    return {
        "rides": update_join(rides, last, ["ride_id"], {"status": c("_d_new_status")}, carry=["new_status"]),
        "illegal": moved.filter(skips).withColumn("reason", F.lit("out_of_order")).select(*columns).unionByName(
            refused.withColumn("reason", F.lit("status_not_allowed")).select(*columns)),
    }
