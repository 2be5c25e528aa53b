"""Diagnostics of stop detection: windows, drop timing, stop signal, dwell, collisions, trips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haltwerk.functions.ordered import Series, keep_first, neighbours, running, unsliced
from haltwerk.functions.ranks import quantiles
from haltwerk.functions.scalars import count_where, false, local_time, share, true, whole_seconds_between
from haltwerk.functions.stats import trimmed
from haltwerk.operators.detect import DROP_THRESHOLD, PING_SERIES, index_pings, transitions

TIMETABLE_KEY = ("fahrt_id", "ort_nr_start", "scheduled_arrival_time")


# -- window size --------------------------------------------------------------


def rows_to_close(pings: DataFrame, drop_threshold: float = DROP_THRESHOLD, series: Series = PING_SERIES) -> DataFrame:
    """Per drop: rows until the last door closing before the next drop, and the drop's size.

    One aggregate per drop segment; the segment is named by its drop row.
    """
    used = dict.fromkeys([*series.keys, *series.order, "distanz", "tuerkriterium"])
    indexed = transitions(index_pings(pings.select(*used), series, keep_slices=True))
    falls = F.coalesce(F.col("delta") < -drop_threshold, F.lit(False))
    row = F.col("row_idx")
    marked = unsliced(running(indexed, series, latest={"_prev": F.when(falls, row)}, keep_slices=True))
    segment = F.when(falls, row).otherwise(F.col("_prev"))
    per_drop = marked.withColumn("drop_row_idx", segment).filter("drop_row_idx is not null")
    grouped = per_drop.groupBy(*series.keys, "drop_row_idx").agg(
        F.max(F.when(F.col("closes"), row)).alias("last_close"),
        F.max(F.when(row == F.col("drop_row_idx"), F.abs("delta"))).alias("drop_size"),
    )
    return grouped.select(
        *series.keys, "drop_row_idx", (F.col("last_close") - F.col("drop_row_idx")).alias("rows_to_close"), "drop_size"
    )


def window_coverage(closings: DataFrame, sizes: Sequence[int] = tuple(range(1, 41))) -> DataFrame:
    """Share of closings that a window of n rows after the drop would see."""
    counted = closings.agg(
        F.count("rows_to_close").alias("n_close"),
        *[count_where(F.col("rows_to_close") <= n).alias(f"_n{n}") for n in sizes],
    )
    entries = F.array(*[F.struct(F.lit(n).cast("long").alias("n"), F.col(f"_n{n}").alias("covered")) for n in sizes])
    return counted.withColumn("_e", F.explode(entries)).select(
        "_e.n", "_e.covered", share(F.col("_e.covered"), F.col("n_close")).alias("coverage")
    )


def drop_size_by_close(closings: DataFrame, qs: Sequence[float] = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)) -> DataFrame:
    """Quantiles of the drop size with and without a closing."""
    classed = closings.select(F.col("rows_to_close").isNotNull().alias("has_close"), "drop_size")
    return quantiles(classed, "drop_size", qs, ["has_close"])


# -- drop timing --------------------------------------------------------------


def door_at_drop(events: DataFrame, indexed: DataFrame) -> DataFrame:
    """Events with a door, the door state at their drop row and the drop type."""
    door = indexed.select("fzg_id", F.col("row_idx").alias("drop_row_idx"), F.col("tuerkriterium").alias("door_at_drop"))
    joined = events.filter("stop_status <> 'no_door'").join(door, ["fzg_id", "drop_row_idx"], "left")
    return joined.withColumn("drop_type", F.when(true("door_at_drop"), "arrival").otherwise("departure"))


def line_drop_type(doors: DataFrame, line_col: str = "linie") -> DataFrame:
    """Arrival and departure drops per line, in percent."""
    counted = doors.groupBy(line_col).agg(
        F.count(F.lit(1)).alias("total"),
        count_where(true("door_at_drop")).alias("arrival_drops"),
        count_where(false("door_at_drop")).alias("departure_drops"),
    )
    return counted.withColumns(
        {
            "pct_arrival": F.round(F.col("arrival_drops") / F.col("total") * 100, 1),
            "pct_departure": F.round(F.col("departure_drops") / F.col("total") * 100, 1),
        }
    )


def line_drop_class(by_line: DataFrame, hi: float = 70, lo: float = 30) -> DataFrame:
    """Class of a line by its share of arrival drops."""
    return by_line.withColumn(
        "drop_category",
        F.when(F.col("pct_arrival") > hi, "arrival-drop")
        .when(F.col("pct_arrival") < lo, "departure-drop")
        .otherwise("mixed"),
    )


def line_consistency(doors: DataFrame, min_events: int = 5, line_col: str = "linie") -> DataFrame:
    """Spread over vehicles of the share of arrival drops, per line."""
    per_vehicle = (
        doors.groupBy("fzg_id", line_col)
        .agg(F.count(F.lit(1)).alias("total"), count_where(true("door_at_drop")).alias("arrival_drops"))
        .filter(F.col("total") >= min_events)
        .withColumn("pct", F.col("arrival_drops") / F.col("total") * 100)
    )
    return per_vehicle.groupBy(line_col).agg(
        F.count(F.lit(1)).alias("n_vehicles"),
        F.round(F.avg("pct"), 1).alias("mean_pct_arrival"),
        F.round(F.stddev_samp("pct"), 1).alias("std_pct_arrival"),
        F.round(F.min("pct"), 1).alias("min_pct_arrival"),
        F.round(F.max("pct"), 1).alias("max_pct_arrival"),
    )


# -- stop signal --------------------------------------------------------------


def stop_signal(
    pings: DataFrame,
    stop_col: str = "ort_nr_start_vvo",
    drop_threshold: float = DROP_THRESHOLD,
    series: Series = PING_SERIES,
) -> DataFrame:
    """Pings with both stop signals (stop change, distance drop) and those of the rows around."""
    used = dict.fromkeys([*series.keys, *series.order, "distanz", stop_col])
    lag = {"_distanz": "distanz", "_stop": stop_col}
    linked = neighbours(pings.select(*used), series, lag=lag, index="row_idx", keep_slices=True)
    flagged = linked.withColumns(
        {
            "delta": F.col("distanz") - F.col("_distanz"),
            "ort_changed": F.when(F.col("row_idx") == 0, F.lit(False)).otherwise(F.col(stop_col) != F.col("_stop")),
        }
    )
    flagged = flagged.withColumn(
        "distanz_drop",
        F.when(F.col("row_idx") == 0, F.lit(False)).otherwise(F.col("delta") < -drop_threshold),
    ).drop("_distanz", "_stop")
    return neighbours(
        flagged, series, lag={"drop_before": "distanz_drop"}, lead={"drop_after": "distanz_drop"}
    )


def signal_alignment(signals: DataFrame) -> DataFrame:
    """How stop changes and drops line up, same row and one row apart; one row."""
    change, drop = F.col("ort_changed"), F.col("distanz_drop")
    near = change & (drop | F.col("drop_before") | F.col("drop_after"))
    return signals.agg(
        count_where(change).alias("changes"),
        count_where(drop).alias("drops"),
        count_where(change & drop).alias("both"),
        count_where(change & ~drop).alias("change_only"),
        count_where(~change & drop).alias("drop_only"),
        count_where(change & F.col("drop_before")).alias("drop_one_before"),
        count_where(change & F.col("drop_after")).alias("drop_one_after"),
        count_where(near).alias("covered"),
    )


def distance_at_change(signals: DataFrame, qs: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Distance at stop changes, and distance step at changes without a drop."""
    changed = signals.filter("ort_changed")
    at_change = changed.select(F.lit("distanz").alias("measure"), F.col("distanz").cast("double").alias("v"))
    no_drop = changed.filter(~F.col("distanz_drop")).select(
        F.lit("delta_without_drop").alias("measure"), F.col("delta").cast("double").alias("v")
    )
    return quantiles(at_change.unionByName(no_drop), "v", qs, ["measure"])


def nodoor_change_rate(events: DataFrame, signals: DataFrame) -> DataFrame:
    """How many events without a door change the stop at their drop row; one row."""
    flags = signals.select("fzg_id", F.col("row_idx").alias("drop_row_idx"), "ort_changed")
    joined = events.filter("stop_status = 'no_door'").join(flags, ["fzg_id", "drop_row_idx"], "left")
    return joined.agg(F.count(F.lit(1)).alias("n"), count_where(F.col("ort_changed")).alias("changed")).withColumn(
        "change_rate", share(F.col("changed"), F.col("n"))
    )


def event_context(events: DataFrame, pings: DataFrame, k: int = 3, series: Series = PING_SERIES) -> DataFrame:
    """Pings up to k rows around the drop of each given event.

    Each event asks for its 2k+1 rows by (vehicle, row), which spreads evenly
    over tasks even if one vehicle holds most rows.
    """
    rows = events.select(
        *series.keys, "drop_row_idx", F.explode(F.sequence(F.lit(-k).cast("long"), F.lit(k).cast("long"))).alias("offset")
    ).withColumn("row_idx", F.col("drop_row_idx") + F.col("offset"))
    return rows.join(pings, [*series.keys, "row_idx"])


def hash_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """A repeatable sample of n rows: the first in the order of a seeded hash of their key, the same in any engine."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary")), *keys).limit(n)


# -- dwell --------------------------------------------------------------------


def dwell_split(core: DataFrame) -> DataFrame:
    """Negative, zero and positive dwell times of events with a door; one row."""
    d = F.col("dwell_time")
    return core.agg(
        F.count(F.lit(1)).alias("total"),
        count_where(F.col("stop_status") == "no_door").alias("no_door"),
        count_where((F.col("stop_status") != "no_door") & (d < 0)).alias("negative"),
        count_where((F.col("stop_status") != "no_door") & (d == 0)).alias("zero"),
        count_where((F.col("stop_status") != "no_door") & (d > 0)).alias("positive"),
    )


def zero_dwell_by_line(core: DataFrame, line_col: str = "linie") -> DataFrame:
    """Zero and positive dwell times per line with the median of the positive ones."""
    doors = core.filter("stop_status <> 'no_door'")
    counted = doors.groupBy(line_col).agg(
        F.count(F.lit(1)).alias("total"),
        count_where(F.col("dwell_time") == 0).alias("n_zero"),
        count_where(F.col("dwell_time") > 0).alias("n_positive"),
    )
    medians = quantiles(doors.filter("dwell_time > 0"), "dwell_time", [0.5], [line_col]).select(
        F.col(line_col).alias("_line"), F.col("value").alias("median_pos")
    )
    joined = counted.join(medians, F.col(line_col).eqNullSafe(F.col("_line")), "left").drop("_line")
    return joined.withColumn("pct_zero", F.round(F.col("n_zero") / F.col("total") * 100, 1))


def zero_dwell_cause(core: DataFrame, indexed: DataFrame) -> DataFrame:
    """Remaining zero dwells by whether an opening had been found."""
    times = indexed.select("fzg_id", F.col("row_idx").alias("drop_row_idx"), F.col("tst_iso").alias("drop_time"))
    zero = core.filter("stop_status <> 'no_door' and dwell_time = 0").join(times, ["fzg_id", "drop_row_idx"], "left")
    reason = F.when(F.col("arrival_time") == F.col("drop_time"), "no_opening").otherwise("no_closing")
    return zero.groupBy(reason.alias("zero_reason")).agg(F.count(F.lit(1)).alias("count"))


# -- collisions ---------------------------------------------------------------


def collision_records(core: DataFrame, key: Sequence[str] = TIMETABLE_KEY) -> DataFrame:
    """Timetable records that two or more events were matched to."""
    per_record = core.filter("scheduled_arrival_time is not null").groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min("fzg_id").alias("_v_lo"),
        F.max("fzg_id").alias("_v_hi"),
        F.collect_set("stop_status").alias("_statuses"),
        F.min("arrival_time").alias("first_arrival"),
        F.max("arrival_time").alias("last_arrival"),
    )
    hit = per_record.filter("n_events > 1")
    return hit.select(
        *key,
        "n_events",
        F.when(F.col("_v_lo") == F.col("_v_hi"), "same_vehicle").otherwise("diff_vehicle").alias("collision_type"),
        F.array_join(F.array_sort("_statuses"), "/").alias("stop_statuses"),
        whole_seconds_between("last_arrival", "first_arrival").alias("gap_sec"),
    )


def collisions(core: DataFrame, key: Sequence[str] = TIMETABLE_KEY) -> DataFrame:
    """Records, records hit more than once and the events on them; one row."""
    per_record = (
        core.filter("scheduled_arrival_time is not null").groupBy(*key).agg(F.count(F.lit(1)).alias("n_events"))
    )
    return per_record.agg(
        F.count(F.lit(1)).alias("records"),
        count_where(F.col("n_events") > 1).alias("colliding_records"),
        F.coalesce(F.sum(F.when(F.col("n_events") > 1, F.col("n_events"))), F.lit(0)).alias("colliding_events"),
    )


def collision_semi(core: DataFrame, key: Sequence[str] = TIMETABLE_KEY) -> DataFrame:
    """The events that share their timetable record with another event."""
    hit = core.groupBy(*key).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").drop("_c")
    return core.join(hit, list(key), "left_semi")


# -- trips --------------------------------------------------------------------


def trip_summary(core: DataFrame, tz: str = "UTC") -> DataFrame:
    """Stops, first vehicle, time span and mean delay per line, local day and trip."""
    arrival = local_time("arrival_time", tz)
    return (
        core.withColumn("arrival_local", arrival)
        .groupBy("linie", "fahrt_id", F.to_date("arrival_local").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("n_stops"),
            F.min_by("fzg_id", F.struct("arrival_time", "drop_row_idx")).alias("fzg_id"),
            F.min("arrival_local").alias("start_time"),
            F.max("arrival_local").alias("end_time"),
            F.round(F.avg("delay_calculated_sec"), 1).alias("avg_delay_s"),
        )
    )


def line_hours(trips: DataFrame) -> DataFrame:
    """Trips, range of stops and operating time per line and day."""
    return trips.groupBy("linie", "day").agg(
        F.count(F.lit(1)).alias("n_trips"),
        F.min("n_stops").alias("min_stops"),
        F.max("n_stops").alias("max_stops"),
        F.min("start_time").alias("first_start"),
        F.max("end_time").alias("last_end"),
    )


def longest_trips(trips: DataFrame) -> DataFrame:
    """The trip with most stops per line, day and half-day."""
    half = F.when(F.hour("start_time") < 12, "morning").otherwise("afternoon")
    halved = trips.withColumn("half", half)
    return keep_first(halved, ["linie", "day", "half"], [F.col("n_stops").desc(), F.col("fahrt_id")])


def trip_listing(core: DataFrame, names: DataFrame, tz: str = "Europe/Berlin") -> DataFrame:
    """Planned and actual local time per stop of each trip, with the stop's name."""
    named = core.join(names.withColumnRenamed("ort_nr", "ort_nr_start"), "ort_nr_start", "left")
    label = F.coalesce("stop_name", F.concat(F.lit("ort_nr="), F.col("ort_nr_start").cast("string")))
    return named.select(
        "linie",
        "fahrt_id",
        "fzg_id",
        "drop_row_idx",
        "stop_index",
        label.alias("stop"),
        F.date_format(local_time("scheduled_arrival_time", tz), "HH:mm:ss").alias("planned"),
        F.date_format(local_time("arrival_time", tz), "HH:mm:ss").alias("actual"),
        "delay_calculated_sec",
        "stop_status",
    )


def occupancy_by_hour(pings: DataFrame, tz: str = "UTC", missing: int = -1) -> DataFrame:
    """Mean occupancy per hour, readings of ``missing`` left out."""
    known = pings.filter(F.col("besetztgrad") != missing)
    return known.groupBy(F.hour(local_time("tst_iso", tz)).alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("besetztgrad").alias("mean_besetztgrad")
    )


def gps_outside(df: DataFrame, lat: tuple[Column | float, Column | float], lon: tuple[Column | float, Column | float]) -> DataFrame:
    """Rows outside a bounding box."""
    return df.filter(
        (F.col("pos_lat") < lat[0]) | (F.col("pos_lat") > lat[1]) | (F.col("pos_lon") < lon[0]) | (F.col("pos_lon") > lon[1])
    )


def gps_outside_adaptive(df: DataFrame, low: float = 0.001, high: float = 0.999) -> DataFrame:
    """Rows outside the box of two quantiles of the valid coordinates."""
    valid = df.filter("pos_lat > 1 and pos_lon > 1")
    return trimmed(valid, ["pos_lat", "pos_lon"], low, high, inside=False)
