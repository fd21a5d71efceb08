"""Driver and rider reports: ratings, directories, leaderboards and profiles."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

from cabledger import schema
from cabledger.functions.money import total
from cabledger.functions.text import folded
from cabledger.operators.joins import accounts_of, with_pickup_city
from cabledger.operators.pick import top_per_key
from cabledger.plans.revenue import driver_totals

Tables = Mapping[str, DataFrame]


def _completed_per_driver(t: Tables) -> DataFrame:
    done = t["rides"].filter((F.col("status") == "completed") & F.col("driver_id").isNotNull())
    return done.groupBy("driver_id").agg(F.count("ride_id").alias("n"))


def top_drivers(t: Tables, min_rating: float = 4.5) -> DataFrame:
    """Drivers rated above ``min_rating``, best first."""
    best = t["drivers"].filter(F.col("avg_rating") > F.lit(min_rating).cast("decimal(3,2)"))
    return accounts_of(best, t["users"]).select(
        "driver_id", "full_name", "email", "phone", "avg_rating", "total_trips", "avail_status", "verify_status",
    ).orderBy(F.desc("avg_rating"), "driver_id")


def driver_stats(t: Tables, id: int | None = None) -> DataFrame:
    """Rating, trips and lifetime earnings per driver; sums are NULL without earnings."""
    drivers = t["drivers"] if id is None else t["drivers"].filter(F.col("driver_id") == id)
    earned = driver_totals(t, id).drop("total_rides")
    return accounts_of(drivers, t["users"]).join(earned, "driver_id", "left").select(
        "driver_id", "full_name", "avg_rating", "total_trips", F.col("total_gross").alias("total_earned"),
        "total_commission", "total_net")


def drivers_in_city(t: Tables, city: str) -> DataFrame:
    """Drivers with any ride picked up in ``city``, best rated first."""
    # The rides are cut to those places and to distinct driver ids before they meet the drivers.
    places = t["locations"].filter(folded(F.col("city")) == folded(F.lit(city))).select(
        F.col("location_id").alias("pickup_location_id"))
    seen = t["rides"].select("driver_id", "pickup_location_id").filter(F.col("driver_id").isNotNull()).join(
        places, "pickup_location_id", "left_semi").select("driver_id").distinct()
    return accounts_of(t["drivers"].join(seen, "driver_id", "left_semi"), t["users"]).orderBy(
        F.desc("avg_rating"), "driver_id").select("full_name", "phone", "avg_rating", "total_trips", "avail_status")


def low_score_drivers(t: Tables, threshold: float = 3.5) -> DataFrame:
    """Drivers whose unrounded mean score is below ``threshold``, lowest first."""
    scores = t["ratings"].groupBy(F.col("rated_user_id").alias("user_id")).agg(
        F.sum("score").alias("_sum"), F.count("rating_id").alias("total_ratings"))
    # sum < threshold * count compares the mean without rounding it
    low = scores.filter(F.col("_sum") < F.lit(threshold).cast("decimal(3,2)") * F.col("total_ratings"))
    avg = (F.col("_sum").cast("decimal(20,0)") / F.col("total_ratings").cast("decimal(20,0)")).cast("decimal(14,4)")
    return low.join(t["drivers"].select("driver_id", "user_id"), "user_id").join(
        t["users"].select("user_id", "full_name"), "user_id").select(
        "full_name", "driver_id", avg.alias("avg_score"), "total_ratings").orderBy("avg_score", "driver_id")


def low_rated_drivers(t: Tables, threshold: float = 3.5) -> DataFrame:
    """Rated drivers whose stored rating is below ``threshold``, lowest first."""
    low = t["drivers"].filter((F.col("avg_rating") < F.lit(threshold).cast("decimal(3,2)")) & (F.col("avg_rating") > 0))
    return accounts_of(low, t["users"]).select(
        "full_name", "avg_rating", "verify_status", "avail_status", "driver_id").orderBy("avg_rating", "driver_id")


def trips_per_driver(t: Tables) -> DataFrame:
    """Completed rides per driver, drivers without any left out, most first."""
    counted = t["drivers"].select("driver_id", "user_id").join(_completed_per_driver(t), "driver_id")
    return counted.join(t["users"].select("user_id", "full_name"), "user_id").orderBy(F.desc("n"), "driver_id").select(
        "full_name", F.col("n").alias("completed_trips"))


def completed_trips_per_driver(t: Tables) -> DataFrame:
    """Completed rides of all drivers, zero included, most first."""
    counted = accounts_of(t["drivers"], t["users"]).join(_completed_per_driver(t), "driver_id", "left")
    trips = F.coalesce("n", F.lit(0).cast("bigint"))
    return counted.select("driver_id", "full_name", trips.alias("total_trips"), "avg_rating").orderBy(
        F.desc("total_trips"), "driver_id").drop("driver_id")


def rides_per_rider(t: Tables) -> DataFrame:
    """Rides of all riders, zero included, most first."""
    counts = t["rides"].groupBy(F.col("rider_id").alias("user_id")).agg(F.count("ride_id").alias("n"))
    riders = t["users"].filter(F.col("role") == "rider").select("user_id", "full_name", "email")
    return riders.join(counts, "user_id", "left").select(
        "user_id", "full_name", "email", F.coalesce("n", F.lit(0).cast("bigint")).alias("total_rides"),
    ).orderBy(F.desc("total_rides"), "user_id")


def user_directory(t: Tables, ordered: bool = True) -> DataFrame:
    """All accounts with driver state, newest first."""
    driver = t["drivers"].select("user_id", F.col("verify_status").alias("_v"), F.col("avg_rating").alias("_r"))
    full = t["users"].join(driver, "user_id", "left")
    if ordered:
        full = full.orderBy(F.desc("registration_date"), "user_id")
    return full.select(*schema.names("users"), F.coalesce("_v", F.lit("N/A")).alias("driver_verify"),
                       F.coalesce("_r", F.lit(0)).cast("decimal(3,2)").alias("driver_rating"))


def driver_directory(t: Tables, ordered: bool = True) -> DataFrame:
    """All drivers with account and number of vehicles, best rated first."""
    owned = t["vehicles"].groupBy("driver_id").agg(F.count("vehicle_id").alias("n"))
    full = accounts_of(t["drivers"], t["users"]).join(owned, "driver_id", "left")
    if ordered:
        full = full.orderBy(F.desc("avg_rating"), "driver_id")
    return full.select(*schema.names("drivers"), "full_name", "email", "phone", "acc_status",
                       F.coalesce("n", F.lit(0).cast("bigint")).alias("vehicle_count"))


def vehicle_review_queue(t: Tables, ordered: bool = True) -> DataFrame:
    """Vehicles with owner: pending first, then verified, then rejected."""
    owner = accounts_of(t["drivers"].select("driver_id", "user_id"), t["users"]).select(
        "driver_id", F.col("full_name").alias("driver_name"))
    full = t["vehicles"].join(owner, "driver_id")
    if ordered:
        full = full.orderBy(schema.sort_rank("verify_status", schema.VERIFY_STATES), "vehicle_id")
    return full.select(*schema.names("vehicles"), "driver_name")


def driver_profile(t: Tables, id: int | None = None) -> DataFrame:
    """Drivers with account, one row per vehicle (vehicle columns NULL without one)."""
    drivers = t["drivers"] if id is None else t["drivers"].filter(F.col("driver_id") == id)
    cars = t["vehicles"].withColumnRenamed("verify_status", "vehicle_verify_status")
    full = accounts_of(drivers, t["users"]).join(cars, "driver_id", "left")
    return full.select(*schema.names("drivers"), "full_name", "email", "phone", "vehicle_id", "make", "model", "year",
                       "color", "license_plate", "vehicle_type", "vehicle_verify_status")


def _with_ride_date(t: Tables, earnings: DataFrame) -> DataFrame:
    return earnings.join(t["rides"].select("ride_id", F.col("created_at").alias("ride_date"), "pickup_location_id"),
                         "ride_id")


def driver_recent_earnings(t: Tables, id: int | None = None, k: int = 5) -> DataFrame:
    """The latest ``k`` earnings of each driver; the cut is made before rides are joined."""
    earnings = t["driver_earnings"] if id is None else t["driver_earnings"].filter(F.col("driver_id") == id)
    latest = top_per_key(earnings, ["driver_id"], [F.desc("earned_at"), F.desc("earning_id")], k)
    full = _with_ride_date(t, latest)
    if id is not None:
        full = full.orderBy(F.desc("earned_at"), F.desc("earning_id"))
    return full.select(*schema.names("driver_earnings"), "ride_date")


def driver_earning_detail(t: Tables, id: int | None = None) -> DataFrame:
    """Every earning with ride date and pickup city."""
    earnings = t["driver_earnings"] if id is None else t["driver_earnings"].filter(F.col("driver_id") == id)
    full = with_pickup_city(_with_ride_date(t, earnings), t["locations"])
    if id is not None:
        full = full.orderBy(F.desc("earned_at"), F.desc("earning_id"))
    return full.select(*schema.names("driver_earnings"), "ride_date", "city")


def primary_cities(t: Tables) -> DataFrame:
    """The city where each driver completed most rides; all of them on a tie."""
    done = t["rides"].filter((F.col("status") == "completed") & F.col("driver_id").isNotNull())
    exact = with_pickup_city(done.select("driver_id", "pickup_location_id"), t["locations"]).groupBy(
        "driver_id", "city").agg(F.count(F.lit(1)).alias("n"))
    merged = exact.groupBy("driver_id", folded(F.col("city")).alias("_city")).agg(
        F.min("city").alias("city"), F.sum("n").alias("n"))
    # One row per driver and city is left here, so this window holds at most one row per city.
    best = F.max("n").over(Window.partitionBy("driver_id"))
    return merged.withColumn("_best", best).filter(F.col("n") == F.col("_best")).select("driver_id", "city")


# What the first three ranks of a city are shown as.
MEDALS = {1: "🥇", 2: "🥈", 3: "🥉"}


def city_leaderboard(t: Tables) -> DataFrame:
    """Verified, rated drivers ranked by rating within their primary city; equal ratings share a rank.

    A rank is one more than the number of better-rated drivers. Ratings have at most 501 values, so the
    counts behind the ranks are summed over that many rows per city, however many drivers it has.
    """
    eligible = t["drivers"].filter((F.col("verify_status") == "verified") & (F.col("avg_rating") > 0))
    listed = eligible.join(primary_cities(t), "driver_id").withColumn("_city", folded(F.col("city")))
    per_rating = listed.groupBy("_city", "avg_rating").agg(F.count(F.lit(1)).alias("_n"))
    better = Window.partitionBy("_city").orderBy(F.desc("avg_rating")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = per_rating.select("_city", "avg_rating", (F.coalesce(F.sum("_n").over(better), F.lit(0)) + 1)
                              .cast("int").alias("city_rank"))
    medal = F.concat(F.lit("#"), F.col("city_rank").cast("string"))
    for place, sign in MEDALS.items():
        medal = F.when(F.col("city_rank") == place, sign).otherwise(medal)
    named = accounts_of(listed.join(ranks, ["_city", "avg_rating"]), t["users"])
    return named.orderBy("city", F.desc("avg_rating"), "driver_id").select(
        "full_name", "phone", "avg_rating", "total_trips", "avail_status", "city", "city_rank", medal.alias("medal"))
