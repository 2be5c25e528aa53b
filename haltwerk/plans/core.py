"""Telemetry and timetable to the core stop-event table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltwerk.functions.ordered import Series
from haltwerk.operators.detect import DROP_THRESHOLD, PING_SERIES, detect_stop_events, filter_stop_changed
from haltwerk.operators.features import add_binary_features
from haltwerk.operators.matching import ARRIVAL_SERIES, match_and_compute_delay
from haltwerk.operators.rescue import rescue_dwell_times
from haltwerk.operators.timetable import expand_timetable

ATTRIBUTES = ("fahrt_id", "ort_nr_start", "ort_nr_ziel", "lage", "besetztgrad")


def stop_events(
    pings: DataFrame, drop_threshold: float = DROP_THRESHOLD, series: Series = PING_SERIES, labels: bool = False
) -> DataFrame:
    """Detected and repaired events with the attributes of their drop row; one pass over the pings."""
    found = detect_stop_events(
        pings, drop_threshold=drop_threshold, series=series, carry=ATTRIBUTES, keep_rescan=True
    )
    return rescue_dwell_times(found, series=series, drop_threshold=drop_threshold, keep_labels=labels)


def core_table(
    pings: DataFrame,
    raw_timetable: DataFrame,
    drop_threshold: float = DROP_THRESHOLD,
    ping_series: Series = PING_SERIES,
    arrival_series: Series = ARRIVAL_SERIES,
    stop_signal: str | None = None,
    tz: str = "UTC",
    workday_max_iso: int = 5,
    stage: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Detection, repair, matching and features.

    ``stop_signal`` names a stop column; then only events whose drop row
    changes that column are kept.

    ``stage`` may write the stop events and read them back.  They are a tenth
    of the pings, and a written table spares the matching a second detection
    for its slice edges and any recomputation after a lost executor.
    """
    events = stop_events(pings, drop_threshold, ping_series)
    if stop_signal is not None:
        events = filter_stop_changed(events, pings, stop_col=stop_signal, series=ping_series)
    events = stage(events)
    matched = match_and_compute_delay(events, None, expand_timetable(raw_timetable), series=arrival_series)
    return add_binary_features(matched, tz=tz, workday_max_iso=workday_max_iso)


def write_core(core: DataFrame, path: str) -> None:
    """Core table as Parquet, one folder per service date.

    Rows are dealt by date and rebalanced by volume: adaptive execution gives a
    large day as many tasks and files as it needs
    (``spark.sql.adaptive.advisoryPartitionSizeInBytes`` each) and lets small
    days share a task, without a count of the rows.
    """
    from haltwerk.functions.scalars import service_date

    dated = core.withColumn("service_date", service_date(F.col("arrival_time")))
    dated.hint("rebalance", F.col("service_date")).write.mode("overwrite").partitionBy("service_date").parquet(path)
