"""Speeds from odometer and position, and runs without motion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltwerk.functions.ordered import Series, neighbours, running, unsliced
from haltwerk.functions.scalars import EARTH_RADIUS_M, count_where, false, haversine_m, share, true, whole_seconds_between
from haltwerk.operators.detect import DROP_THRESHOLD, PING_SERIES


def with_steps(pings: DataFrame, series: Series = PING_SERIES, keep_slices: bool = False) -> DataFrame:
    """Distance step, seconds and door transition since the vehicle's previous ping."""
    lag = {"_distanz": "distanz", "_time": series.time}
    if "tuerkriterium" in pings.columns:
        lag["_door"] = "tuerkriterium"
    if "pos_lat" in pings.columns:
        lag |= {"lat_prev": "pos_lat", "lon_prev": "pos_lon"}
    linked = neighbours(pings, series, lag=lag, keep_slices=keep_slices)
    columns = {
        "delta": F.col("distanz") - F.col("_distanz"),
        "dt": whole_seconds_between(series.time, "_time"),
    }
    if "_door" in linked.columns:
        columns["opens"] = false("_door") & true("tuerkriterium")
        columns["closes"] = true("_door") & false("tuerkriterium")
    return linked.withColumns(columns).drop("_distanz", "_time", "_door")


def odometer_speed(stepped: DataFrame, drop_threshold: float = DROP_THRESHOLD) -> DataFrame:
    """Speed in m/s; -1 at a drop, NULL for small falls, first rows and equal times."""
    speed = (
        F.when(F.col("delta") < -drop_threshold, F.lit(-1.0))
        .when(F.col("delta") < 0, F.lit(None))
        .when(F.col("dt").isNull() | (F.col("dt") == 0), F.lit(None))
        .otherwise(F.try_divide(F.col("delta").cast("double"), F.col("dt").cast("double")))
    )
    return stepped.withColumn("speed_ms", speed)


def gps_speed(stepped: DataFrame, radius: float = EARTH_RADIUS_M) -> DataFrame:
    """Great-circle distance to the previous ping and the speed from it."""
    distance = haversine_m(F.col("lat_prev"), F.col("lon_prev"), F.col("pos_lat"), F.col("pos_lon"), radius)
    return stepped.withColumn("gps_dist_m", distance).withColumn(
        "gps_speed_ms", F.when(F.col("dt") > 0, F.col("gps_dist_m") / F.col("dt"))
    )


def speed_classes(speeds: DataFrame) -> DataFrame:
    """Drops, unknown and normal rows of the odometer speed; one row."""
    return speeds.agg(
        count_where(F.col("speed_ms") == -1).alias("drops"),
        count_where(F.col("speed_ms").isNull()).alias("unknown"),
        count_where(F.col("speed_ms") >= 0).alias("normal"),
        count_where(F.col("speed_ms") == 0).alias("standing"),
    )


def speed_agreement(speeds: DataFrame) -> DataFrame:
    """How often the two speeds agree on standing still; one row."""
    both = speeds.filter(F.col("gps_speed_ms").isNotNull() & (F.col("speed_ms") >= 0))
    g, d = F.col("gps_speed_ms"), F.col("speed_ms")
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        count_where((g == 0) & (d == 0)).alias("both_zero"),
        count_where((g == 0) & (d > 0)).alias("only_odometer_moves"),
        count_where((g > 0) & (d == 0)).alias("only_gps_moves"),
    )


def speed_at_door(speeds: DataFrame, speed_col: str, thresholds: Sequence[float] = (0.5, 1.0, 2.0)) -> DataFrame:
    """Speed at door openings and closings: standing, moving, and shares below thresholds."""
    kind = F.when(F.col("opens"), "open").when(F.col("closes"), "close")
    at_door = speeds.select(kind.alias("door"), F.col(speed_col).alias("v")).filter("door is not null")
    counted = at_door.groupBy("door").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("v").alias("known"),
        count_where(F.col("v") == -1).alias("at_drop"),
        count_where(F.col("v") == 0).alias("standing"),
        count_where(F.col("v") > 0).alias("moving"),
        *[count_where(F.col("v") < t).alias(f"below_{i}") for i, t in enumerate(thresholds)],
    )
    return counted.withColumn("standing_share", share(F.col("standing"), F.col("known")))


def stationary_runs(pings: DataFrame, drop_threshold: float = DROP_THRESHOLD, series: Series = PING_SERIES) -> DataFrame:
    """Runs of zero speed: rows and seconds.  An unknown speed does not end a run."""
    speeds = odometer_speed(with_steps(pings, series, keep_slices=True), drop_threshold)
    # an unknown speed has no break flag to add
    breaks = F.when(F.col("speed_ms") != 0, 1).when(F.col("speed_ms") == 0, 0)
    numbered = running(speeds, series, sums={"run": breaks}, keep_slices=True)
    return (
        unsliced(numbered)
        .filter("speed_ms = 0")
        .groupBy(*series.keys, "run")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("dt").alias("duration_sec"))
    )
