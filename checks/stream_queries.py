"""The streams, run to the end over the derived tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cabledger.session import materialize, shared_dir
from cabledger.sources.star import AS_OF, star_tables
from cabledger.streaming import jobs

LOTS = 4
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Run:
    """A session with the stream settings and fresh folders for one run."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.t = star_tables(spark, sf_dir)
        self.session = spark.newSession()
        self.session.conf.set("spark.sql.session.timeZone", "UTC")
        self.session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
        self.base, self.checkpoint, self.out = base, f"{base}/checkpoint", f"{base}/out"
        self.spark = spark

    def source(self, table: str, lot: Column | None = None, last: str | None = None) -> DataFrame:
        """The table in ``LOTS`` files, one per micro-batch: by a hash, so that times run across all of them, or by ``lot``
        from 0 on. ``last`` names a time column: a row with nothing else than a far time ends the stream, so that all others' time comes."""
        rows, folder = self.t[table], f"{self.base}/{table}"
        lot = F.pmod(F.xxhash64(*rows.columns), F.lit(LOTS)) if lot is None else lot
        dealt = materialize(rows.withColumn("_lot", lot))
        for i in range(LOTS):
            dealt.filter(F.col("_lot") == i).drop("_lot").coalesce(1).write.mode("append").parquet(folder)
            time.sleep(0.05)  # files are taken in order of their time
        if last:
            end = [F.lit("9000-01-01").cast(f.dataType).alias(f.name) if f.name == last else F.lit(None).cast(f.dataType).alias(f.name)
                   for f in rows.schema]
            self.spark.range(1).select(*end).coalesce(1).write.mode("append").parquet(folder)
        return self.session.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)

    def table(self, name: str) -> Callable[[], DataFrame]:
        schema = self.t[name].schema
        return lambda: self.session.read.schema(schema).parquet(f"{self.t.root}/{name}")

    def finish(self, query) -> DataFrame:
        query.awaitTermination()
        return self.spark.read.parquet(self.out)


#: A delay that covers the whole table, whatever the cut, and shorter ones for cuts that leave some events late.
ANY, DAYS, MINUTES = "4000 days", 400, 4


def _trips(spark: SparkSession, sf_dir: str, lot: Column | None, delay: str) -> DataFrame:
    run = _Run(spark, sf_dir)
    return run.finish(jobs.stream_rate_fares(run.source("trip_events", lot, "submitted_at"), run.table("rides"), run.table("fare_rules"),
                                             run.checkpoint, run.out, once=True, delay=delay))


def _ratings(spark: SparkSession, sf_dir: str, lot: Column | None, delay: str) -> DataFrame:
    run = _Run(spark, sf_dir)
    return run.finish(jobs.stream_driver_ratings(run.source("rating_events", lot, "rated_at"), run.checkpoint, run.out, once=True, delay=delay))


def _in_time(column: str, cuts: list[str]) -> Column:
    """Lots one after another in time."""
    return sum(((F.col(column) >= F.lit(x).cast("timestamp_ntz")).cast("int") for x in cuts), F.lit(0))


BY_MINUTE = _in_time, ("submitted_at", ["1999-12-01 00:26:00", "1999-12-01 00:30:00", "1999-12-01 00:33:00"])
BY_YEAR = _in_time, ("rated_at", ["1993-06-01", "1995-01-01", "1996-06-01"])


def _closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _Run(spark, sf_dir)
    query = jobs.stream_ride_closures(run.source("closure_events"), run.table("rides"), run.t["history_before"],
                                      run.checkpoint, run.out, AS_OF, once=True)
    return run.finish(query).drop("batch_id")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _Run(spark, sf_dir)
    written = run.finish(jobs.stream_trip_counts(run.source("trip_changes"), run.checkpoint, run.out, once=True))
    return jobs.latest(written, "driver_id")


def stream_queries():
    def fares(view, lot=None, delay=ANY):
        return lambda spark, sf_dir: view(_trips(spark, sf_dir, lot() if lot else None, delay))

    def ratings(view, lot=None, delay=ANY):
        return lambda spark, sf_dir: view(_ratings(spark, sf_dir, lot() if lot else None, delay))
    refused = lambda w: jobs.refused_forms(w).drop("submitted_at")
    late = lambda w: jobs.refused_forms(w, "late").drop("reason")
    by_minute, by_year = (lambda f=f, a=a: f(*a) for f, a in (BY_MINUTE, BY_YEAR))
    by_trip, by_rating = lambda: F.col("trip_id") % LOTS, lambda: F.col("rating_id") % LOTS
    return {
        "stream_rate_fares": fares(jobs.rated_fares), "stream_rate_fares_rejected": fares(refused),
        "stream_rate_forms": fares(jobs.rated_fares, by_minute, "2 minutes"),
        "stream_rate_forms_rejected": fares(refused, by_minute, "2 minutes"),
        "stream_timely_fares": fares(jobs.rated_fares, by_trip, f"{MINUTES} minutes"),
        "stream_late_forms": fares(late, by_trip, f"{MINUTES} minutes"),
        "stream_driver_ratings": ratings(jobs.rating_totals), "stream_rating_alerts": ratings(jobs.rating_alerts),
        "stream_rating_alerts_by_year": ratings(jobs.rating_alerts, by_year, "1 hour"),
        "stream_timely_alerts": ratings(jobs.rating_alerts, by_rating, f"{DAYS} days"),
        "stream_late_ratings": ratings(jobs.late_ratings, by_rating, f"{DAYS} days"),
        "stream_ride_closures": _closures, "stream_trip_counts": _counts,
    }
