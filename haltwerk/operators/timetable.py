"""Timetable: latest snapshot per trip, expansion to stops, scheduled times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haltwerk.functions.ordered import keep_first

SEGMENTS = T.ArrayType(T.StructType([T.StructField("ort_nr", T.LongType()), T.StructField("lenkzeit", T.LongType())]))


def latest_snapshot(raw: DataFrame) -> DataFrame:
    """Newest record per trip; trips whose newest stop list is empty are left out."""
    newest = keep_first(raw, ["fahrt_id"], [F.col("tst_iso").cast("timestamp").desc(), F.col("zp_abfahrt").desc()])
    return newest.filter(F.col("segmente") != "[]")


def expand_segments(snapshot: DataFrame) -> DataFrame:
    """One row per trip and stop position; text that is no stop list is skipped."""
    parsed = snapshot.withColumn("_list", F.from_json("segmente", SEGMENTS))
    return parsed.select(
        F.col("fahrt_id").cast("long").alias("fahrt_id"),
        F.col("zp_abfahrt").cast("long").alias("zp_abfahrt"),
        "_list",
        F.posexplode("_list").alias("stop_index", "_seg"),
    ).select(
        "fahrt_id",
        "zp_abfahrt",
        "_list",
        F.col("stop_index").cast("long").alias("stop_index"),
        F.col("_seg.ort_nr").alias("ort_nr"),
        F.coalesce("_seg.lenkzeit", F.lit(0)).alias("lenkzeit"),
    )


def expand_timetable(raw: DataFrame, inclusive: bool = True) -> DataFrame:
    """Scheduled arrival per trip and stop.

    ``inclusive``: a driving time counts for its own stop (arrival after the
    segment); otherwise it counts from the next stop on.  Running sums stay
    inside one trip's list, whose length is that of one record; the list is
    summed before it is spread, so no shuffle follows the choice of snapshot.
    """
    stops = F.from_json("segmente", SEGMENTS)
    zero = F.array().cast("array<bigint>")
    driving = F.transform(F.col("_list"), lambda s: F.coalesce(s["lenkzeit"], F.lit(0).cast("long")))
    sums = F.aggregate(
        F.col("_driving"),
        F.struct(F.lit(0).cast("long").alias("total"), zero.alias("sums")),
        lambda acc, x: F.struct((acc["total"] + x).alias("total"), F.array_append(acc["sums"], acc["total"] + x).alias("sums")),
        lambda acc: acc["sums"],
    )
    listed = (
        latest_snapshot(raw)
        .withColumn("_list", stops)
        .withColumn("_driving", driving)
        .withColumn("_sums", sums)
        .select(
            F.col("fahrt_id").cast("long").alias("fahrt_id"),
            F.col("zp_abfahrt").cast("long").alias("zp_abfahrt"),
            F.posexplode(F.arrays_zip("_list", "_driving", "_sums")).alias("stop_index", "_s"),
        )
    )
    offset = F.col("_s._sums") if inclusive else F.col("_s._sums") - F.col("_s._driving")
    return listed.select(
        "fahrt_id",
        F.col("stop_index").cast("long").alias("stop_index"),
        F.col("_s._list.ort_nr").alias("ort_nr"),
        (F.col("zp_abfahrt") + offset).alias("scheduled_arrival_unix"),
        F.timestamp_seconds(F.col("zp_abfahrt") + offset).alias("scheduled_arrival_time"),
    )


def timetable_stats(timetable: DataFrame) -> DataFrame:
    """Trips, distinct stops, range of times and distribution of stops per trip."""
    per_trip = timetable.groupBy("fahrt_id").agg(
        F.count(F.lit(1)).alias("stops"),
        F.min("scheduled_arrival_time").alias("first_time"),
        F.max("scheduled_arrival_time").alias("last_time"),
    )
    trips = per_trip.agg(
        F.count(F.lit(1)).alias("n_trips"),
        F.sum("stops").alias("n_rows"),
        F.avg("stops").alias("mean_stops"),
        F.stddev_samp("stops").alias("std_stops"),
        F.min("stops").alias("min_stops"),
        F.max("stops").alias("max_stops"),
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
    )
    stops = timetable.select("ort_nr").distinct().agg(F.count(F.lit(1)).alias("n_stops"))
    return trips.withColumn("n_stops", stops.scalar())


def planned_route(timetable: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Stops of a trip with the offset from its departure; use the exclusive expansion."""
    window = Window.partitionBy("fahrt_id")
    listed = timetable.withColumn("offset_sec", F.col("scheduled_arrival_unix") - F.min("scheduled_arrival_unix").over(window))
    if names is not None:
        listed = listed.join(names, "ort_nr", "left").withColumn(
            "stop_name", F.coalesce("stop_name", F.concat(F.lit("ort_nr="), F.col("ort_nr").cast("string")))
        )
    return listed.withColumn(
        "offset_text",
        F.concat(
            F.lit("+"),
            F.expr("offset_sec div 60").cast("string"),
            F.lit(":"),
            F.lpad((F.col("offset_sec") % 60).cast("string"), 2, "0"),
        ),
    )
