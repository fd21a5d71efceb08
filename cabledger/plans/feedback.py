"""Ratings: accepting them, rolling them up per driver and flagging low averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cabledger import schema
from cabledger.functions.clock import moment
from cabledger.functions.text import trimmed, whole
from cabledger.operators.deliveries import FORM, ledger, once
from cabledger.operators.forms import check_rating
from cabledger.session import materialize
from cabledger.sources.sinks import update_join

c = F.col
LOWEST_GOOD = 3.5


def accept_ratings(forms: DataFrame, rides: DataFrame, ratings: DataFrame, drivers: DataFrame,
                   applied: DataFrame | None = None) -> dict[str, DataFrame]:
    """Add valid ratings; at most one per ride and rater. Each form counts once; those in the ledger ``applied`` are left out.

    ``forms`` holds rating_id, ride_id, rated_by, rated_user_id, rater_role, score (text), comment, rated_at.
    Riders rate their own completed rides; drivers may rate any ride. The rated user is taken as given;
    ``target_mismatch`` marks ratings whose target was not the other side of the ride.
    """
    checked = materialize(check_rating(once(forms, "rating_id", ["rated_at"], applied)))
    trip = rides.select("ride_id", "rider_id", "status", "driver_id")
    sides = drivers.select("driver_id", c("user_id").alias("_driver_user"))
    done = ratings.select("ride_id", "rated_by", F.lit(True).alias("_rated"))
    joined = (checked.join(trip, "ride_id", "left").join(sides, "driver_id", "left")
              .join(done, ["ride_id", "rated_by"], "left"))
    rider = c("rater_role") == "rider"
    reason = F.coalesce(
        "first_error",
        F.when(c("rider_id").isNull() | (rider & (c("rider_id") != c("rated_by"))), "not_own_ride")
        .when(rider & (c("status") != "completed"), "ride_not_completed")
        .when(c("_rated"), "already_rated")
        .when(c("rated_by") == c("rated_user_id"), "self_rating"))
    tested = joined.withColumn("reason", reason)
    good = tested.filter(c("reason").isNull())
    place = F.struct("rated_at", "rating_id", FORM)
    first = good.groupBy("ride_id", "rated_by").agg(F.min(place).alias("_first"))
    # A rating is looked at for its target only where no earlier one was accepted.
    later = (c("reason").isNull() | (c("reason") == "self_rating")) & (place > c("_first"))
    ranked = materialize(tested.join(first, ["ride_id", "rated_by"], "left").withColumn(
        "reason", F.when(later, "already_rated").otherwise(c("reason"))).drop("_first"))
    kept = ranked.filter(c("reason").isNull())
    other_side = F.when(rider, c("_driver_user")).otherwise(c("rider_id"))
    accepted = kept.withColumn("score", whole(c("score"))).withColumn(
        "comment", F.nullif(trimmed(c("comment")), F.lit("")))
    return {
        "ratings": ratings.unionByName(schema.conform(accepted, "ratings")),
        "accepted": kept.select("rating_id", "ride_id", "rated_by", "rated_user_id",
                                (~F.coalesce(c("rated_user_id") == other_side, F.lit(False))).alias("target_mismatch")),
        "rejected": ranked.filter(c("reason").isNotNull()).select("rating_id", "ride_id", "rated_by", "reason"),
        "applied": ledger(checked, applied),
    }


def mean_score(total: Column, count: Column) -> Column:
    """Mean rounded to two places, exact in decimals."""
    return F.round(total.cast("decimal(20,0)") / count.cast("decimal(20,0)"), 2).cast("decimal(3,2)")


def driver_rating_rollup(ratings: DataFrame, drivers: DataFrame) -> DataFrame:
    """Store the mean of all scores a driver's user received; unrated drivers keep what they have."""
    means = ratings.groupBy(c("rated_user_id").alias("user_id")).agg(
        mean_score(F.sum("score"), F.count("score")).alias("mean"))
    return update_join(drivers, means, ["user_id"], {"avg_rating": c("_d_mean")}, carry=["mean"])


def alert_text(name: Column, driver_id: Column, mean: Column) -> Column:
    """Fixed value: the wording of a low-rating alert."""
    return F.concat(
        F.lit('ALERT: Driver "'), name, F.lit('" (driver_id='), driver_id.cast("string"),
        F.lit(") has been auto-suspended. Average rating dropped to "), mean.cast("string"),
        F.lit(" (below 3.5). Please review."))


def flag_low_rated(drivers: DataFrame, users: DataFrame, as_of: str, threshold: float = LOWEST_GOOD) -> dict[str, DataFrame]:
    """Suspend rated drivers whose stored mean is below ``threshold``, with one alert each."""
    low = drivers.filter((c("avg_rating") > 0) & (c("avg_rating") < F.lit(threshold).cast("decimal(3,2)")))
    named = low.join(users.select("user_id", "full_name"), "user_id")
    # Unique per user and second, as long as user ids have 32 bits and the year is before 2038.
    number = F.unix_seconds(F.lit(as_of).cast("timestamp_ntz").cast("timestamp")) * (1 << 32) + c("user_id")
    alerts = named.select(
        number.alias("notification_id"),
        F.lit("low_rating_flag").alias("type"),
        alert_text(c("full_name"), c("driver_id"), c("avg_rating")).alias("message"),
        c("user_id").alias("related_user_id"), F.lit(False).alias("is_read"), moment(as_of).alias("created_at"))
    return {
        "users": update_join(users, low.select("user_id"), ["user_id"], {"acc_status": F.lit("suspended")}),
        "admin_notifications": schema.conform(alerts, "admin_notifications"),
    }
