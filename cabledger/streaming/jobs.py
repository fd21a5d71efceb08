"""Fares, ratings, ride closures and trip counts as events arrive.

Fares and ratings are taken in order of event time once the watermark has passed them, so results do not depend on how the
input is cut into batches; what comes later than that is put out as late, for the next batch run. No job reads
what it wrote before: what must be known lies in keyed state (use RocksDB). ``start_from`` tables hold what was counted before
the stream began. Outputs lie in one folder per micro-batch; where a job has several, ``kind`` tells them apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from cabledger.functions.clock import moment
from cabledger.operators.deliveries import form_key
from cabledger.operators.forms import check_trip_completion
from cabledger.operators.pick import last_per_key
from cabledger.plans.fares import rate_fares, split_commission
from cabledger.plans.feedback import LOWEST_GOOD
from cabledger.session import materialize
from cabledger.streaming.sinks import keep_once, start
from cabledger.streaming.state import FirstForms, Ratings

c = F.col
Table = Callable[[], DataFrame]
#: How late an event may be, and how long a finished ride is remembered.
DELAY, KEEP = "1 hour", "1 hour"
#: Groups that the keys of a stream are dealt to. A bucket's waiting rows are handled in one go, so raise it with the rows that wait
#: (some thousands a bucket are fine). As with the shuffle partitions, a checkpoint keeps the number it began with.
BUCKETS = 4096


def _timed(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """``stream`` with a watermark on ``time`` and the time in microseconds as ``at``."""
    return stream.withColumn("_time", c(time).cast("timestamp")).withWatermark("_time", delay).withColumn("at", F.unix_micros("_time")).drop("_time")


def _bucket(key: str, buckets: int) -> Column:
    """The group of a key; rows without one have their own."""
    return F.when(c(key).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).alias("bucket")


def stream_rate_fares(trips: DataFrame, rides: Table, fare_rules: Table, checkpoint: str, out: str, once: bool = False,
                      delay: str = DELAY, keep: str = KEEP, buckets: int = BUCKETS) -> StreamingQuery:
    """Rate finished trips (trip_id, submitted_at, ride_id, distance and duration as text), each ride once.

    The first good form of a ride by submitted_at, then trip_id, counts. Forms are judged when the watermark has passed them
    (``rated``, or ``rejected`` with a reason, such as ``repeated_form``). Forms later than ``delay`` are put out as
    ``late``; ``stream_ledger`` tells a batch run over them what the stream has dealt with. A form sent twice counts once while it
    waits; after that its repeat is late. A ride is remembered for ``keep`` of event time after its first form, so state is bounded.
    ``rides`` and ``fare_rules`` are read anew for every batch, and joined there, where AQE can broadcast whichever side is small.
    """
    sent = trips.select(FORM_FIELDS)
    payload = F.to_json(F.struct(FORM_FIELDS))
    checked = check_trip_completion(_timed(sent.filter(c("submitted_at").isNotNull()), "submitted_at", delay))
    rows = checked.select(_bucket("ride_id", buckets), c("ride_id").alias("key"), form_key(sent, ["trip_id"]).alias("form"), "at",
                          F.coalesce("trip_id", F.lit(-(1 << 63))).alias("tie"), F.coalesce("first_error", F.lit("")).alias("error"),
                          payload.alias("payload"))
    judged = rows.groupBy("bucket").transformWithStateInPandas(
        FirstForms(_millis(trips.sparkSession, keep)), outputStructType=FirstForms.schema, outputMode="Append", timeMode="EventTime")
    fields = StructType([trips.schema[n] for n in FORM_FIELDS])

    def each(batch: DataFrame, batch_id: int) -> DataFrame:
        batch = materialize(batch.withColumn("sent", F.from_json("payload", fields)).select("kind", "form", "reason", "sent.*"))
        rated = split_commission(rate_fares(batch.filter("kind = 'rated'"), rides(), fare_rules()))
        rated = rated.withColumns({n: c(n).cast("string") for n in ("distance", "duration")})  # as in the forms of other kinds
        keys = batch.filter("kind = 'rated'").select("ride_id", "form", "trip_id", "submitted_at")
        return batch.filter("kind <> 'rated'").unionByName(
            rated.join(keys, "ride_id").withColumn("kind", F.lit("rated")), allowMissingColumns=True)
    return start(judged, each, checkpoint, out, once=once)


FORM_FIELDS = ["trip_id", "submitted_at", "ride_id", "distance", "duration"]
RATED_OUT = ["ride_id", "driver_id", "rider_id", "distance", "duration", "fare", "commission", "net_amount"]


def _millis(spark: SparkSession, length: str) -> int:
    return int(spark.sql(f"SELECT unix_millis(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {length})").first()[0])


def rated_fares(written: DataFrame) -> DataFrame:
    """Rated rides of what ``stream_rate_fares`` wrote."""
    return written.filter("kind = 'rated'").select(
        *(c(n).cast({"distance": "decimal(8,2)", "duration": "int"}.get(n, written.schema[n].dataType)).alias(n) for n in RATED_OUT))


def refused_forms(written: DataFrame, kind: str = "rejected") -> DataFrame:
    """Refused (or ``late``) forms of what ``stream_rate_fares`` wrote."""
    return written.filter(c("kind") == kind).select(*FORM_FIELDS, "reason")


def stream_ledger(written: DataFrame) -> DataFrame:
    """What the stream has dealt with, as the ledger of ``finish_trips``: hand it to a run over the late forms."""
    return written.filter("kind <> 'late'").select(
        "form", F.when(c("kind") == "rated", c("ride_id").cast("string")).alias("subject"))


def stream_driver_ratings(ratings: DataFrame, checkpoint: str, out: str, once: bool = False,
                          start_from: DataFrame | None = None, delay: str = DELAY, buckets: int = BUCKETS) -> StreamingQuery:
    """Running rating of every rated user (``total``), and an ``alert`` for every rating that takes it below the limit.

    Ratings (rating_id, rated_user_id, score, rated_at) count by rated_at, then rating_id, when the watermark has passed them; a
    rating sent twice counts once while it waits. Ratings later than ``delay`` are put out as ``late`` and don't count.
    ``start_from`` (rated_user_id, score_sum, n) is what the totals begin with. Rows without a user only carry the watermark on.
    """
    sound = c("rated_user_id").isNull() | (c("rating_id").isNotNull() & c("score").isNotNull())
    timed = _timed(ratings.select("rating_id", "rated_user_id", "score", "rated_at").filter(c("rated_at").isNotNull() & sound), "rated_at", delay)
    rows = timed.select(_bucket("rated_user_id", buckets), c("rated_user_id").alias("key"), c("rating_id").cast("string").alias("form"), "at", c("rating_id").alias("tie"),
                        F.lit("").alias("error"), c("score").cast("string").alias("payload")).fillna({"tie": 0, "form": ""})
    first = None if start_from is None else start_from.select(c("rated_user_id").cast("bigint").alias("key"), "score_sum", "n").filter(
        c("key").isNotNull()).groupBy("key").agg(F.sum("score_sum").cast("bigint").alias("score_sum"), F.sum("n").cast("bigint").alias("n")).select(
        _bucket("key", buckets), "key", "score_sum", "n").groupBy("bucket")
    told = rows.groupBy("bucket").transformWithStateInPandas(
        Ratings(int(LOWEST_GOOD * 100)), outputStructType=Ratings.schema, outputMode="Append", timeMode="EventTime", initialState=first)

    def each(batch: DataFrame, batch_id: int) -> DataFrame:
        mean = (c("mean_cents").cast("decimal(20,0)") / 100).cast("decimal(3,2)")
        return batch.select("kind", "rated_user_id", "rating_id", c("score").cast("int").alias("score"),
                            F.timestamp_micros("rated_at_us").cast("timestamp_ntz").alias("rated_at"), "score_sum", "n",
                            mean.alias("mean"), (mean < LOWEST_GOOD).alias("low"))
    return start(told, each, checkpoint, out, once=once)


def rating_totals(written: DataFrame) -> DataFrame:
    """The newest total of every user that ``stream_driver_ratings`` wrote."""
    totals = written.filter("kind = 'total'").select("rated_user_id", "score_sum", "n", "mean", "low", "batch_id")
    return latest(totals, "rated_user_id")


def rating_alerts(written: DataFrame) -> DataFrame:
    return written.filter("kind = 'alert'").select("rated_user_id", "rating_id", "rated_at", "score_sum", "n", "mean")


def late_ratings(written: DataFrame) -> DataFrame:
    return written.filter("kind = 'late'").select("rating_id", "rated_user_id", "score", "rated_at")


def stream_ride_closures(events: DataFrame, rides: Table, ride_history: DataFrame, checkpoint: str, out: str, as_of: str,
                         once: bool = False) -> StreamingQuery:
    """Archive rides as payments turn paid or rides turn cancelled.

    ``events`` holds event_id, ride_id, kind ('paid' or 'cancelled') and happened_at. The first closure of
    a ride counts, within a batch and over all of them; a paid event of a cancelled ride archives nothing. Rides that
    ``ride_history`` holds when the stream first starts are known from the state: their ids are kept beside the checkpoint and
    read with the first batch. The state holds the first event of either kind with its batch time, which the checkpoint keeps;
    what this batch brought has the batch's own. ``rides`` is read anew for every batch.
    """
    spark = events.sparkSession
    known = keep_once(ride_history.select("ride_id").filter(c("ride_id").isNotNull()), f"{checkpoint}-known")
    rows = events.filter(c("ride_id").isNotNull() & c("kind").isin("paid", "cancelled")).select(
        "ride_id", "kind", F.struct(F.unix_micros(c("happened_at").cast("timestamp")).alias("at"), "event_id").alias("order"))
    before = spark.readStream.schema(known.schema).parquet(f"{checkpoint}-known").select(
        "ride_id", F.lit("known").alias("kind"), F.lit(None).cast(rows.schema["order"].dataType).alias("order"))
    came = rows.unionByName(before).withColumn("came", F.struct(F.current_timestamp().alias("batch"), "order"))
    first = came.groupBy("ride_id").agg(*(F.min(F.when(c("kind") == kind, c("came"))).alias(kind) for kind in ("paid", "cancelled", "known")))
    fresh = first.filter("known is null").select("ride_id", F.explode(F.array(*(F.struct(
        F.lit(kind).alias("kind"), F.col(kind)["batch"].alias("batch"), earlier.alias("place")) for kind, earlier in (
            ("paid", F.when(c("cancelled") <= c("paid"), 2).otherwise(1)), ("cancelled", F.when(c("paid") < c("cancelled"), 2).otherwise(1)))))).alias("event"))
    fresh = fresh.select("ride_id", "event.*").filter(c("batch") == F.current_timestamp())

    def each(batch: DataFrame, batch_id: int) -> DataFrame:
        batch = materialize(batch)
        # Ride ids grow with time, so the batch's id range lets the scan of the rides skip most row groups.
        lowest, highest = batch.agg(F.min("ride_id"), F.max("ride_id")).first()
        near = rides().filter(c("ride_id").between(lowest, highest)).select("ride_id", "status", "fare")
        counts = F.when(c("status") == "cancelled", c("kind") == "cancelled").otherwise(c("place") == 1)
        return batch.join(near, "ride_id").filter(counts).select(
            "ride_id", F.when(c("kind") == "paid", "completed").otherwise("cancelled").alias("outcome"),
            F.coalesce("fare", F.lit(0)).cast("decimal(10,2)").alias("final_fare"), moment(as_of).alias("archived_at"))
    return start(fresh, each, checkpoint, out, mode="update", once=once)


def stream_trip_counts(changes: DataFrame, checkpoint: str, out: str, once: bool = False,
                       start_from: Table | None = None) -> StreamingQuery:
    """Completed rides per driver; ``changes`` holds ride_id, driver_id, status and changed_at.

    A ride counts once. ``start_from`` (driver_id, total_trips) is added to the counts.
    """
    done = changes.filter((c("status") == "completed") & c("driver_id").isNotNull()).select("ride_id", "driver_id")
    counts = done.dropDuplicates(["ride_id"]).groupBy("driver_id").agg(F.count(F.lit(1)).alias("total_trips"))

    def each(batch: DataFrame, batch_id: int) -> DataFrame:
        if start_from is None:
            return batch
        base = start_from().select("driver_id", c("total_trips").alias("_base"))
        return batch.join(base, "driver_id", "left").select(
            "driver_id", (c("total_trips") + F.coalesce("_base", F.lit(0))).alias("total_trips"))
    return start(counts, each, checkpoint, out, mode="update", once=once)


def latest(written: DataFrame, key: str) -> DataFrame:
    """The newest row per key of what a stream wrote."""
    return last_per_key(written, [key], ["batch_id"]).drop("batch_id")
