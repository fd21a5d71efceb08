"""Ride reports: live rides, full trips, histories and quotes.

Per-rider and per-driver lists cover everybody at once; ``id`` narrows one to a single person and then
also sorts it newest first, as the page does. Whole-table lists are left unsorted, since a global sort of
all rides would be a shuffle nobody reads in order.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from cabledger import schema
from cabledger.functions.clock import moment
from cabledger.functions.money import after_discount, discount
from cabledger.functions.text import blank, folded, same_text, trimmed
from cabledger.operators.joins import driver_cards, with_driver, with_pickup_city, with_places, with_rider
from cabledger.operators.pick import last_per_key, top_per_key

Tables = Mapping[str, DataFrame]


def _one(df: DataFrame, column: str, id: int | None, newest: str) -> DataFrame:
    if id is None:
        return df
    return df.filter(F.col(column) == id).orderBy(F.desc(newest), F.desc("ride_id"))


def _ride_columns(*extra: str) -> list[str]:
    return schema.names("rides") + list(extra)


def active_rides(t: Tables) -> DataFrame:
    """Rides not yet completed or cancelled, with rider, driver, vehicle and both ends."""
    live = t["rides"].filter(F.col("status").isin(schema.ACTIVE_STATES))
    vehicle = t["vehicles"].select("vehicle_id", "make", "model", "license_plate", "vehicle_type")
    full = with_driver(with_rider(with_places(live, t["locations"]), t["users"]), t["drivers"], t["users"])
    return full.join(vehicle, "vehicle_id", "left").select(
        "ride_id", "status", "fare", "created_at", "rider_name", "rider_phone", "driver_name", "driver_phone",
        "driver_rating", "make", "model", "license_plate", "vehicle_type", "pickup_address", "pickup_city",
        "dropoff_address")


def full_trip_report(t: Tables) -> DataFrame:
    """Every ride with people, vehicle, both ends, payment and promo code."""
    vehicle = t["vehicles"].select("vehicle_id", "make", "model", "vehicle_type")
    promo = t["promo_codes"].select("promo_id", F.col("code").alias("promo_code"))
    pay = t["payments"].select("ride_id", "promo_id", F.col("amount").alias("payment_amount"), "pay_method",
                               "pay_status", "discount_appld").join(promo, "promo_id", "left").drop("promo_id")
    full = with_driver(with_rider(with_places(t["rides"], t["locations"]), t["users"]), t["drivers"], t["users"])
    return full.join(vehicle, "vehicle_id", "left").join(pay, "ride_id", "left").select(
        "ride_id", "status", "fare", "distance", "duration", "created_at", "completed_at", "rider_name",
        "rider_email", "driver_name", "driver_rating", "make", "model", "vehicle_type", "pickup_address",
        F.col("pickup_city").alias("city"), "dropoff_address", "payment_amount", "pay_method", "pay_status",
        "discount_appld", "promo_code")


def recent_rides(t: Tables, k: int = 10) -> DataFrame:
    """The latest ``k`` rides with names and city.

    Every ride has a rider and a pickup (required links), so the top-k is taken on rides alone and only
    k rows are joined.
    """
    newest = [F.desc("created_at"), F.desc("ride_id")]
    rides = t["rides"].select("ride_id", "status", "fare", "created_at", "rider_id", "driver_id", "pickup_location_id")
    latest = rides.orderBy(*newest).limit(k)
    full = with_driver(with_rider(with_pickup_city(latest, t["locations"]), t["users"]), t["drivers"], t["users"])
    return full.select("ride_id", "status", "fare", "created_at", "rider_name", "driver_name", "city").orderBy(*newest)


def payment_promo_history(t: Tables, ordered: bool = False) -> DataFrame:
    """Payments with rider and promo code; newest first if ``ordered``."""
    promo = t["promo_codes"].select("promo_id", F.col("code").alias("promo_code"), "discount_pct")
    full = with_rider(t["payments"].drop("rider_id").join(t["rides"].select("ride_id", "rider_id"), "ride_id"),
                      t["users"]).join(promo, "promo_id", "left")
    if ordered:
        full = full.orderBy(F.desc("transaction_date"), F.desc("payment_id"))
    return full.select("ride_id", "rider_name", "amount", "pay_method", "discount_appld", "promo_code", "discount_pct")


def rider_completed_rides(t: Tables, id: int | None = None) -> DataFrame:
    """Completed rides per rider."""
    done = t["rides"].filter(F.col("status") == "completed")
    return _one(with_places(done, t["locations"]), "rider_id", id, "completed_at").select(
        "rider_id", "ride_id", "fare", "distance", "duration", "completed_at",
        F.col("pickup_address").alias("pickup"), F.col("dropoff_address").alias("dropoff"))


def rider_recent_rides(t: Tables, id: int | None = None, k: int = 5) -> DataFrame:
    """The latest ``k`` rides of each rider; cut down to k per rider before driver and places are added."""
    rides = t["rides"] if id is None else t["rides"].filter(F.col("rider_id") == id)
    latest = top_per_key(rides, ["rider_id"], [F.desc("created_at"), F.desc("ride_id")], k)
    full = with_driver(with_places(latest, t["locations"]), t["drivers"], t["users"])
    return _one(full, "rider_id", id, "created_at").select(
        *_ride_columns("pickup_address", "pickup_city", "dropoff_address", "driver_rating", "driver_name"))


def rider_history(t: Tables, id: int | None = None) -> DataFrame:
    """All rides of each rider with driver and payment, and what the rider may do next."""
    pay = t["payments"].select("ride_id", "amount", "pay_method", "pay_status", "discount_appld")
    full = with_driver(with_places(t["rides"], t["locations"]), t["drivers"], t["users"]).join(pay, "ride_id", "left")
    has_fare = F.coalesce(F.col("fare") != 0, F.lit(False))
    unpaid = F.col("pay_status").isNull() | (F.col("pay_status") == "pending")
    can_rate = (F.col("status") == "completed") & (F.col("pay_status") == "paid") & F.col("driver_user_id").isNotNull()
    flagged = full.withColumns({
        "needs_payment": has_fare & unpaid & F.col("status").isin("completed", "in_progress", "accepted"),
        "can_rate": F.coalesce(can_rate, F.lit(False)),
    })
    return _one(flagged, "rider_id", id, "created_at").select(*_ride_columns(
        "pickup_address", "pickup_city", "dropoff_address", "driver_name", "driver_user_id", "amount", "pay_method",
        "pay_status", "discount_appld", "needs_payment", "can_rate"))


def active_promos(t: Tables, as_of: str, enforce_start: bool = False) -> DataFrame:
    """Codes a rider may use now; the start date is tested only with ``enforce_start``."""
    return t["promo_codes"].filter(usable(as_of, enforce_start))


def in_date(as_of: str, enforce_start: bool = False) -> Column:
    now = moment(as_of)
    ok = F.col("valid_until") > now
    return ok & (F.col("valid_from") <= now) if enforce_start else ok


def usable(as_of: str, enforce_start: bool = False) -> Column:
    return in_date(as_of, enforce_start) & (F.col("usage_count") < F.col("usage_limit"))


def promo_list(t: Tables, as_of: str) -> DataFrame:
    """All codes with their state, latest end date first."""
    over = (F.col("valid_until") < moment(as_of)) | (F.col("usage_count") >= F.col("usage_limit"))
    return t["promo_codes"].withColumn("promo_status", F.when(over, "Expired").otherwise("Active")).orderBy(
        F.desc("valid_until"), "promo_id")


def ride_quote(t: Tables, choices: DataFrame, as_of: str) -> DataFrame:
    """Price shown before payment: discount and total for the code chosen for each unpaid ride.

    ``choices`` holds request_id, requested_at, ride_id and promo_code; the latest choice of a ride counts, also one of no
    code. A ride with no usable choice is quoted at its full fare.
    """
    choices = last_per_key(choices.select("ride_id", "requested_at", "request_id", "promo_code"), ["ride_id"],
                           ["requested_at", "request_id"])
    due = t["rides"].filter(F.col("fare") != 0).join(
        t["payments"].filter(F.col("pay_status") == "paid").select("ride_id"), "ride_id", "left_anti")
    cards = driver_cards(t["drivers"], t["users"]).select("driver_id", "driver_name")
    placed = with_places(due, t["locations"]).select("ride_id", "driver_id", "fare")
    promos = active_promos(t, as_of).select("code", "discount_pct")
    chosen = choices.filter(~blank(trimmed(F.col("promo_code")))).select("ride_id", "promo_code")
    usable_choice = chosen.join(promos, same_text(trimmed(chosen.promo_code), promos.code)).select(
        "ride_id", "code", "discount_pct")
    quoted = placed.join(cards, "driver_id", "left").join(usable_choice, "ride_id", "left")
    off = F.coalesce(discount(F.col("fare"), F.col("discount_pct")), F.lit(0).cast("decimal(10,2)"))
    return quoted.withColumn("discount", off).select(
        "ride_id", "fare", "driver_name", "code", "discount",
        after_discount(F.col("fare"), F.col("discount")).alias("total"))


def riders_with_active_ride(t: Tables) -> DataFrame:
    """Riders who may not book another ride now."""
    return t["rides"].filter(F.col("status").isin(schema.ACTIVE_STATES)).select("rider_id").distinct()


def pricing_rule_lookup(requests: DataFrame, fare_rules: DataFrame) -> DataFrame:
    """The fare rule for each request's pickup city and vehicle type (economy unless given)."""
    wanted = requests.withColumns({
        "_city": folded(trimmed(F.col("pickup_city"))),
        "_type": F.when(blank(F.col("vehicle_type")), "economy").otherwise(F.col("vehicle_type")),
    })
    rules = fare_rules.select(folded(F.col("city")).alias("_city"), F.col("vehicle_type").alias("_type"), "rule_id")
    return wanted.join(rules, ["_city", "_type"], "left").select(*requests.columns, "rule_id")


def fare_rule_list(t: Tables, km: int = 5, minutes: int = 15) -> DataFrame:
    """Fare rules by city and type with the price of a sample trip."""
    sample = ((F.col("base_rate") + F.col("per_km_rate") * km + F.col("per_min_rate") * minutes)
              * F.col("surge_multi")).cast("decimal(10,2)")
    return t["fare_rules"].withColumn("sample_fare", sample).orderBy(
        "city", schema.sort_rank("vehicle_type", schema.VEHICLE_TYPES))


def open_requests(t: Tables, id: int | None = None) -> DataFrame:
    """Requests waiting for a driver.

    ``driver_id`` is the driver a request is offered to, NULL when it is open to everyone; with ``id``
    only those one driver sees. (Listing open requests once per driver would multiply the two tables.)
    """
    waiting = t["rides"].filter(F.col("status") == "requested")
    if id is not None:
        waiting = waiting.filter(F.col("driver_id").isNull() | (F.col("driver_id") == id))
    rule = t["fare_rules"].select("rule_id", F.col("vehicle_type").alias("requested_vehicle_type"))
    full = with_rider(with_places(waiting, t["locations"]), t["users"]).join(rule, "rule_id", "left")
    if id is not None:
        full = full.orderBy(F.desc("created_at"), F.desc("ride_id"))
    return full.select(*_ride_columns("pickup_address", "pickup_city", "dropoff_address", "rider_name",
                                      "requested_vehicle_type"))


def driver_active_rides(t: Tables, id: int | None = None) -> DataFrame:
    """Accepted, en route and running rides per driver."""
    busy = t["rides"].filter(F.col("status").isin("accepted", "driver_en_route", "in_progress")
                             & F.col("driver_id").isNotNull())
    full = with_rider(with_places(busy, t["locations"]), t["users"])
    return _one(full, "driver_id", id, "created_at").select(*_ride_columns(
        "pickup_address", "pickup_city", "dropoff_address", "rider_name"), F.col("rider_id").alias("rider_user_id"))


def driver_trips(t: Tables, id: int | None = None) -> DataFrame:
    """All rides per driver with rider, both ends and what the ride earned."""
    own = t["rides"].filter(F.col("driver_id").isNotNull())
    earned = t["driver_earnings"].select("ride_id", "gross_amount", "commission", "net_amount", "payout_status")
    full = with_rider(with_places(own, t["locations"]), t["users"]).join(earned, "ride_id", "left")
    return _one(full, "driver_id", id, "created_at").select(
        *_ride_columns("pickup_address", "pickup_city", "dropoff_address", "rider_name"),
        F.col("rider_id").alias("rider_user_id"), "gross_amount", "commission", "net_amount", "payout_status")
