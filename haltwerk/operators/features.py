"""Derived features of stop events and the feature matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haltwerk.functions.scalars import clip, iso_weekday, local_time, status_code

# fixed values: clip bounds in seconds, fill for stops without a door signal
DWELL_CLIP = (0, 120)
TRAVEL_CLIP = (10, 600)
NO_DOOR_FILL = 40

# fixed values: the model's features and the sets that are compared
FEATURES = (
    "dwell_time",
    "delay_calculated_sec",
    "stop_index",
    "besetztgrad",
    "linie",
    "ort_nr_start",
    "stop_status",
    "is_peak_hour",
    "is_workday",
    "hour_of_day",
    "day_of_week",
)

FEATURE_SETS = {
    "Full": FEATURES,
    "No-location": tuple(f for f in FEATURES if f != "ort_nr_start"),
    "Ops-only": tuple(f for f in FEATURES if f not in ("ort_nr_start", "stop_index")),
}
CATEGORICAL = ("linie", "ort_nr_start", "stop_status")


def is_peak_hour(moment: Column) -> Column:
    """07–09 and 16–19 o'clock."""
    hour = F.hour(moment)
    return (((hour >= 7) & (hour < 9)) | ((hour >= 16) & (hour < 19))).cast("tinyint")


def add_binary_features(df: DataFrame, tz: str = "UTC", workday_max_iso: int = 5) -> DataFrame:
    """Peak hour, workday, and a typed NULL for the traffic signal.

    ``workday_max_iso`` 5 means Monday to Friday; 4 gives Monday to Thursday.
    """
    moment = local_time("arrival_time", tz)
    return df.withColumns(
        {
            "is_peak_hour": is_peak_hour(moment),
            "is_workday": (iso_weekday(moment) <= workday_max_iso).cast("tinyint"),
            "has_traffic_signal": F.lit(None).cast("tinyint"),
        }
    )


def local_time_features(df: DataFrame, tz: str = "Europe/Berlin") -> DataFrame:
    """Local service date, hour and ISO weekday of the arrival."""
    moment = local_time("arrival_time", tz)
    return df.withColumns(
        {
            "service_date": F.to_date(moment),
            "hour_of_day": F.hour(moment),
            "day_of_week": iso_weekday(moment),
        }
    )


def sentinel_fill(df: DataFrame, no_door: str = "fill40", fill: float = NO_DOOR_FILL) -> DataFrame:
    """Treat the -1 dwell of stops without a door: fill it or drop the row."""
    if no_door == "drop":
        return df.filter(F.col("dwell_time") >= 0)
    if no_door != "fill40":
        raise ValueError("no_door is 'fill40' or 'drop'")
    return df.filter(F.col("dwell_time") >= -1).withColumn(
        "dwell_time", F.when(F.col("dwell_time") == -1, F.lit(float(fill))).otherwise(F.col("dwell_time"))
    )


def next_travel_time(df: DataFrame, keys: Sequence[str] = ("fahrt_id", "service_date")) -> DataFrame:
    """Travel time of the trip's next stop as ``target``; rows without one are dropped.

    After matching, a trip has one row per vehicle, stop and date, so a group
    here is bounded by the trip's stop list.
    """
    window = Window.partitionBy(*keys).orderBy("stop_index", "arrival_time", "fzg_id", "drop_row_idx")
    return df.withColumn("target", F.lead("travel_time").over(window)).filter("target is not null")


def clip_outliers(df: DataFrame) -> DataFrame:
    columns = {"dwell_time": clip("dwell_time", *DWELL_CLIP)}
    if "target" in df.columns:
        columns["target"] = clip("target", *TRAVEL_CLIP)
    return df.withColumns(columns)


def feature_matrix(core: DataFrame, tz: str = "Europe/Berlin", no_door: str = "fill40") -> DataFrame:
    """Features and target of the next-stop travel-time model."""
    prepared = sentinel_fill(local_time_features(core, tz), no_door)
    targeted = clip_outliers(next_travel_time(prepared))
    return targeted.withColumn("stop_status", status_code("stop_status")).select(
        "fahrt_id", "service_date", *FEATURES, "target"
    )
