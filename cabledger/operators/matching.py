"""One driver per waiting ride: the oldest ride takes the best driver that is left to it.

Rides agree on which driver is better and drivers on which ride is older, so the walk over rides has the same result as the walk over
drivers: the best driver takes the oldest ride that it may take, then the next one, and so on. The latter is done here, the ``chunk``
best free drivers at a time. A driver of a chunk looks at the rides that earlier ones took and those it refused itself, so the
oldest ``chunk`` rides of a kind, and as many more as a driver of the chunk has refused, are all a task needs to see: it is bounded
whatever the number of rides and drivers. A driver that has refused more rides than a chunk holds is matched alone, by an aggregate
over all rides. Rounds grow with the drivers divided by ``chunk``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cabledger.session import materialize

c = F.col
CHUNK = 100_000
PAIR = "ride_id bigint, driver_id bigint"


def match(rides: DataFrame, drivers: DataFrame, refused: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(ride_id, driver_id) of the matched pairs.

    ``rides`` has ride_id, created_at and kind, ``drivers`` driver_id, place (the least is the best, then the least id) and kinds (the
    kinds it may take), ``refused`` pairs (ride_id, driver_id) that are left out; all are read more than once.
    """
    spark = rides.sparkSession
    counts = refused.join(drivers.select("driver_id"), "driver_id").groupBy("driver_id").agg(F.count(F.lit(1)).alias("no"))
    free = materialize(drivers.join(counts, "driver_id", "left").select("driver_id", "place", "kinds", F.coalesce("no", F.lit(0)).alias("no")))
    kinds = sorted(r["k"] for r in free.select(F.explode("kinds").alias("k")).distinct().collect())  # a handful of words
    open_rides, found, order = rides.select("ride_id", "created_at", "kind"), [], ["place", "driver_id"]
    while True:
        best = materialize(free.orderBy(*order).limit(chunk))
        size, most = best.agg(F.count(F.lit(1)), F.max("no")).first()
        if not size or not kinds:
            break
        if most > chunk:  # up to the first driver with so many refusals, or that one alone
            heavy = best.filter(c("no") > chunk).agg(F.min(F.struct(*order)).alias("at")).first()["at"]
            part = materialize(best.filter(~_beyond(heavy) & (c("driver_id") != heavy["driver_id"])))
            best = best.filter(c("driver_id") == heavy["driver_id"]) if part.isEmpty() else part
            most = best.agg(F.max("no")).first()[0]
        pairs = _alone(open_rides, best, refused) if most > chunk else _walked(open_rides, best, refused, kinds, chunk + most)
        pairs = materialize(pairs)
        found.append(pairs)
        last = best.agg(F.max(F.struct(*order)).alias("at")).first()["at"]
        free = free.filter(_beyond(last))
        if size < chunk and most <= chunk and free.isEmpty():
            break
        open_rides = materialize(open_rides.join(pairs, "ride_id", "left_anti"))
    out = spark.createDataFrame([], PAIR)
    for pairs in found:
        out = out.unionByName(pairs)
    return out


def _beyond(driver) -> Column:
    """Drivers that come after one in order."""
    return (c("place") > F.lit(driver["place"])) | ((c("place") == F.lit(driver["place"])) & (c("driver_id") > F.lit(driver["driver_id"])))


def _alone(rides: DataFrame, driver: DataFrame, refused: DataFrame) -> DataFrame:
    """The oldest ride that one driver may take."""
    legal = rides.join(F.broadcast(driver.select("driver_id", "kinds")), F.array_contains("kinds", c("kind"))).join(
        refused, ["ride_id", "driver_id"], "left_anti")  # one row is broadcast
    first = legal.groupBy("driver_id").agg(F.min(F.struct("created_at", "ride_id")).alias("ride"))
    return first.select("ride.ride_id", "driver_id")


def _walked(rides: DataFrame, drivers: DataFrame, refused: DataFrame, kinds: list[str], window: int) -> DataFrame:
    """The walk over a chunk of drivers and the oldest ``window`` rides of each kind, in one task."""
    seen = None
    for kind in kinds:
        oldest = rides.filter(c("kind") == kind).orderBy("created_at", "ride_id").limit(window)
        seen = oldest if seen is None else seen.unionByName(oldest)
    seen = materialize(seen)
    no = refused.join(drivers.select("driver_id"), "driver_id", "left_semi").join(seen.select("ride_id"), "ride_id", "left_semi").distinct()
    none = F.lit(None)

    def rows(df: DataFrame, what: int, ride, driver, at, place, kind, types) -> DataFrame:
        return df.select(F.lit(what).alias("what"), ride.cast("bigint").alias("ride_id"), driver.cast("bigint").alias("driver_id"),
                         at.cast("timestamp_ntz").alias("created_at"), place.cast("decimal(20,6)").alias("place"),
                         kind.cast("string").alias("kind"), types.cast("array<string>").alias("kinds"))
    tagged = (rows(seen, 0, c("ride_id"), none, c("created_at"), none, c("kind"), none)
              .unionByName(rows(no, 1, c("ride_id"), c("driver_id"), none, none, none, none))
              .unionByName(rows(drivers, 2, none, c("driver_id"), none, c("place"), none, c("kinds"))))
    ordered = tagged.coalesce(1).sortWithinPartitions("what", "created_at", "place", "ride_id", "driver_id").drop("created_at", "place")
    return ordered.mapInArrow(_walker(), PAIR)


def _walker():
    """The walk as a local function, so that it is sent to workers that do not have this package."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queues: dict[str, list[int]] = {}       # per kind, places of its rides, oldest first
        skip: dict[str, list[int]] = {}         # per kind and position, the next position that may be free
        ids: list[int] = []
        no: dict[int, set[int]] = {}

        def free(jumps: list[int], i: int) -> int:
            end = i
            while jumps[end] != end:
                end = jumps[end]
            while jumps[i] != end:
                jumps[i], i = end, jumps[i]
            return end

        for batch in batches:
            pairs = []
            for what, ride, driver, kind, kinds in zip(*(batch.column(n).to_pylist() for n in ("what", "ride_id", "driver_id", "kind", "kinds"))):
                if what == 0:
                    queues.setdefault(kind, []).append(len(ids))
                    ids.append(ride)
                elif what == 1:
                    no.setdefault(driver, set()).add(ride)
                else:
                    best, refused = None, no.get(driver, ())
                    for k in kinds:
                        queue = queues.get(k, [])
                        jumps = skip.setdefault(k, list(range(len(queue) + 1)))
                        at = free(jumps, 0)
                        while at < len(queue) and ids[queue[at]] in refused:
                            at = free(jumps, at + 1)
                        if at < len(queue) and (best is None or queue[at] < best[0]):
                            best = queue[at], jumps, at
                    if best is not None:
                        best[1][best[2]] = best[2] + 1
                        pairs.append((ids[best[0]], driver))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["ride_id", "driver_id"])
    return walk
