"""The joins nearly every report needs.

No side is broadcast by hint: Catalyst and AQE broadcast a side whose size they know to be under
``spark.sql.autoBroadcastJoinThreshold`` and otherwise sort-merge, splitting skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_places(rides: DataFrame, locations: DataFrame, dropoff: bool = True) -> DataFrame:
    """Pickup address and city, and the drop-off address. Rides without a known place are dropped."""
    pick = locations.select(F.col("location_id").alias("pickup_location_id"),
                            F.col("address").alias("pickup_address"), F.col("city").alias("pickup_city"))
    out = rides.join(pick, "pickup_location_id")
    if dropoff:
        drop = locations.select(F.col("location_id").alias("dropoff_location_id"),
                                F.col("address").alias("dropoff_address"))
        out = out.join(drop, "dropoff_location_id")
    return out


def with_pickup_city(rides: DataFrame, locations: DataFrame) -> DataFrame:
    pick = locations.select(F.col("location_id").alias("pickup_location_id"), "city")
    return rides.join(pick, "pickup_location_id")


def driver_cards(drivers: DataFrame, users: DataFrame) -> DataFrame:
    """One row per driver with the account fields shown next to a ride."""
    account = users.select("user_id", F.col("full_name").alias("driver_name"), F.col("phone").alias("driver_phone"))
    return (drivers.select("driver_id", "user_id", F.col("avg_rating").alias("driver_rating"))
            .join(account, "user_id", "left").withColumnRenamed("user_id", "driver_user_id"))


def with_driver(rides: DataFrame, drivers: DataFrame, users: DataFrame) -> DataFrame:
    """Driver name, phone, rating and account, NULL while a ride has no driver."""
    return rides.join(driver_cards(drivers, users), "driver_id", "left")


def with_rider(rides: DataFrame, users: DataFrame) -> DataFrame:
    account = users.select(F.col("user_id").alias("rider_id"), F.col("full_name").alias("rider_name"),
                           F.col("phone").alias("rider_phone"), F.col("email").alias("rider_email"))
    return rides.join(account, "rider_id")


def accounts_of(drivers: DataFrame, users: DataFrame) -> DataFrame:
    """Drivers with the name, mail, phone and state of their account."""
    return drivers.join(users.select("user_id", "full_name", "email", "phone", "acc_status"), "user_id")
