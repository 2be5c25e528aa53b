"""Matching of stop events to the timetable; delay, dwell and travel time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haltwerk.functions.ordered import Series, keep_first, neighbours, running, slice_columns, sliced, spread_hot
from haltwerk.functions.scalars import seconds_between, service_date

MATCH_KEYS = ("fahrt_id", "ort_nr_start", "service_date")
ARRIVAL_SERIES = Series(keys=("fzg_id",), time="arrival_time", ties=("drop_row_idx",))

CORE_COLUMNS = (
    "fzg_id",
    "drop_row_idx",
    "arrival_time",
    "departure_time",
    "linie",
    "fahrt_id",
    "ort_nr_start",
    "stop_index",
    "stop_status",
    "scheduled_arrival_time",
    "delay_calculated_sec",
    "delay_recorded_sec",
    "dwell_time",
    "travel_time",
    "besetztgrad",
)


def drop_row_attributes(events: DataFrame, pings: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Attributes of the drop row, fetched by (vehicle, row); pings need ``row_idx``."""
    rows = pings.select("fzg_id", F.col("row_idx").alias("drop_row_idx"), *columns)
    return events.join(rows, ["fzg_id", "drop_row_idx"], "left")


def schedule_lists(timetable: DataFrame, keys: Sequence[str] = MATCH_KEYS, cutoff_hours: int = 4) -> DataFrame:
    """Candidate arrivals per key as one sorted list.

    A list holds the times one trip calls at one stop on one service date, so it
    is no longer than the trip's own stop list.
    """
    dated = timetable.withColumn("service_date", service_date("scheduled_arrival_time", cutoff_hours))
    renamed = dated.withColumnRenamed("ort_nr", "ort_nr_start")
    call = F.struct("scheduled_arrival_time", "stop_index")
    return renamed.groupBy(*keys).agg(F.array_sort(F.collect_list(call)).alias("candidates"))


def match_nearest(
    events: DataFrame,
    timetable: DataFrame,
    keys: Sequence[str] = MATCH_KEYS,
    time_col: str = "arrival_time",
    cutoff_hours: int = 4,
) -> DataFrame:
    """Attach the scheduled call nearest in time; ties go to the lower stop index.

    With the service date among the keys, each event meets one list of
    candidates and picks from it in place, so neither candidate pairs nor a
    second shuffle by event arise.  Without it a list would hold the calls of all
    days; then events and calls are merged by time (:func:`nearest_by_merge`).
    """
    if "service_date" not in keys:
        found = nearest_by_merge(events, timetable, keys, time_col)
        return found.withColumn("service_date", service_date(time_col, cutoff_hours))
    dated = events.withColumn("service_date", service_date(time_col, cutoff_hours))
    lists = schedule_lists(timetable, keys, cutoff_hours)
    moment = F.unix_micros(F.col(time_col))
    ranked = F.transform(
        "candidates",
        lambda c: F.struct(
            F.abs(moment - F.unix_micros(c["scheduled_arrival_time"])).alias("gap"),
            c["stop_index"].alias("stop_index"),
            c["scheduled_arrival_time"].alias("scheduled_arrival_time"),
        ),
    )
    # merged, never broadcast: the planner sizes the lists by the trips they are spread from, a few bytes each
    joined = dated.join(lists.hint("merge"), list(keys), "left").withColumn("_best", F.array_min(ranked))
    return joined.withColumns(
        {
            "scheduled_arrival_time": F.col("_best.scheduled_arrival_time"),
            "stop_index": F.col("_best.stop_index"),
            "n_candidates": F.coalesce(F.size("candidates"), F.lit(0)).cast("long"),
        }
    ).drop("_best", "candidates")


def nearest_by_merge(
    events: DataFrame, timetable: DataFrame, keys: Sequence[str], time_col: str = "arrival_time", rows_per_slice: int = 2_000_000, task_rows: int = 500_000
) -> DataFrame:
    """Attach the scheduled call nearest in time by an as-of merge; ties go to the lower stop index.

    Events and calls of a key stand in one series by time; running values give
    each event the last call up to it and the first one from it on, and the
    nearer one wins.  No task holds a list of calls, and keys of more than
    ``rows_per_slice`` rows are cut.  An event's columns are one struct in the
    series, so that a call, of which there are many more, is a few numbers; a
    count first deals the series to tasks of about ``task_rows`` rows.  Events with a NULL key or time match
    nothing; ``n_candidates`` is the number of calls of the key.
    """
    call = timetable.withColumnRenamed("ort_nr", "ort_nr_start").dropna(subset=[*keys, "scheduled_arrival_time"])
    # one call per instant, the one with the lower stop index, a missing one first; plain numbers stay in the hash path
    known = F.count("stop_index") == F.count(F.lit(1))
    calls = call.groupBy(*keys, F.col("scheduled_arrival_time").alias("_at")).agg(
        F.when(known, F.min("stop_index")).alias("_stop"), F.count(F.lit(1)).alias("_calls")
    )
    numbers = calls.groupBy(*[F.col(k).alias(f"_n_{k}") for k in keys]).agg(F.sum("_calls").alias("n_candidates"))
    kept = [c for c in events.columns if c not in ("stop_index", "scheduled_arrival_time", "n_candidates")]
    apart = F.shiftrightunsigned(F.xxhash64(*[F.col(c) for c in kept]), 1)  # 0 and up; calls come before events of their instant
    asked = events.select(*keys, F.struct(*kept).alias("_event"), F.col(time_col).alias("_at"), apart.alias("_tie"), F.lit(True).alias("_asks"))
    merged = asked.unionByName(calls.drop("_calls").withColumns({"_tie": F.lit(-1).cast("long"), "_asks": F.lit(False)}), allowMissingColumns=True)
    series = Series(keys=tuple(keys), time="_at", ties=("_tie",))
    cut = spread_hot(merged.select(*keys, "_at", "_tie"), series, rows_per_slice)
    tasks = max(1, -(-(call.count() + events.count()) // task_rows))
    dealt = sliced(merged, cut).repartition(tasks, *slice_columns(cut))
    at = F.unix_micros("_at")
    mark = F.when(~F.col("_asks"), F.struct(at.alias("t"), F.col("_stop").alias("stop")))
    linked = running(dealt, cut, latest={"_before": mark}, upcoming={"_after": mark}).filter("_asks")

    def choice(side: str, gap: Column) -> Column:
        return F.when(F.col(side).isNotNull() & F.col("_at").isNotNull(), F.struct(gap.alias("gap"), F.col(f"{side}.stop").alias("stop"), F.col(f"{side}.t").alias("t")))

    best = F.least(choice("_before", at - F.col("_before.t")), choice("_after", F.col("_after.t") - at))
    picked = linked.withColumn("_best", best).join(numbers, [F.col(k) == F.col(f"_n_{k}") for k in keys], "left")
    return picked.select(
        *[F.col("_event")[c].alias(c) for c in kept],
        F.timestamp_micros("_best.t").alias("scheduled_arrival_time"),
        F.col("_best.stop").alias("stop_index"),
        F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"),
    )


def add_delays(matched: DataFrame, time_col: str = "arrival_time", recorded_col: str = "lage") -> DataFrame:
    """Calculated delay (actual minus scheduled, seconds) and the delay the vehicle reports."""
    return matched.withColumns(
        {
            "delay_calculated_sec": seconds_between(time_col, "scheduled_arrival_time"),
            "delay_recorded_sec": F.col(recorded_col),
        }
    )


def collision_dedup(matched: DataFrame) -> DataFrame:
    """Best event per (vehicle, trip, stop, service date): normal, then multi_door, then no_door."""
    priority = F.when(F.col("stop_status") == "normal", 0).when(F.col("stop_status") == "multi_door", 1).otherwise(2)
    keys = ["fzg_id", "fahrt_id", "ort_nr_start", "service_date"]
    return keep_first(matched, keys, [priority, F.col("arrival_time"), F.col("drop_row_idx")])


def crossday_filter(matched: DataFrame, delay_max: float = 3600, disagree_max: float = 3000) -> DataFrame:
    """Drop matches to another day; the unknown delay of unmatched rows fails the test too."""
    disagreement = F.abs(F.col("delay_calculated_sec") - F.col("delay_recorded_sec"))
    return matched.filter(~((F.col("delay_calculated_sec") > delay_max) & (disagreement > disagree_max)))


def add_dwell_time(events: DataFrame) -> DataFrame:
    """Seconds between departure and arrival; -1 where no door was seen."""
    return events.withColumn(
        "dwell_time",
        F.when(F.col("stop_status") == "no_door", F.lit(-1.0)).otherwise(seconds_between("departure_time", "arrival_time")),
    )


def add_travel_time(events: DataFrame, series: Series = ARRIVAL_SERIES) -> DataFrame:
    """Seconds since the departure of the same vehicle's previous event."""
    linked = neighbours(events, series, lag={"_left": "departure_time"})
    return linked.withColumn("travel_time", seconds_between("arrival_time", "_left")).drop("_left")


def match_and_compute_delay(
    events: DataFrame,
    pings: DataFrame | None,
    timetable: DataFrame,
    keys: Sequence[str] = MATCH_KEYS,
    time_col: str = "arrival_time",
    cutoff_hours: int = 4,
    delay_max: float = 3600,
    disagree_max: float = 3000,
    carry: Sequence[str] = (),
    series: Series = ARRIVAL_SERIES,
) -> DataFrame:
    """Core table: matched events with delay, dwell and travel time.

    ``pings`` (with ``row_idx``) are only read if the events do not carry the
    attributes of the drop row already.
    """
    wanted = [c for c in ("fahrt_id", "ort_nr_start", "lage", "besetztgrad", *carry) if c not in events.columns]
    if wanted:
        if pings is None:
            raise ValueError(f"events lack {wanted} and no pings were given")
        events = drop_row_attributes(events, pings, wanted)
    events = events.withColumns({c: F.col(c).cast("long") for c in ("fahrt_id", "ort_nr_start")})
    matched = add_delays(match_nearest(events, timetable, keys, time_col, cutoff_hours), time_col)
    kept = crossday_filter(collision_dedup(matched), delay_max, disagree_max)
    timed = add_travel_time(add_dwell_time(kept), series)
    return timed.filter("scheduled_arrival_time is not null").select(*CORE_COLUMNS, *carry)


def match_report(events: DataFrame, core: DataFrame, cutoff_hours: int = 4) -> DataFrame:
    """Events, matched and unmatched counts, extreme delays, service-date mismatches; one row."""
    counted = core.agg(
        F.count(F.lit(1)).alias("matched"),
        F.count(F.when(F.col("delay_calculated_sec") > 3600, 1)).alias("extreme_late"),
        F.count(F.when(F.col("delay_calculated_sec") < -180, 1)).alias("extreme_early"),
        F.count(
            F.when(service_date("arrival_time", cutoff_hours) != service_date("scheduled_arrival_time", cutoff_hours), 1)
        ).alias("date_mismatch"),
    )
    total = events.agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("total", total.scalar()).withColumns(
        {
            "unmatched": F.col("total") - F.col("matched"),
            "matched_pct": F.try_divide(100.0 * F.col("matched"), F.col("total").cast("double")),
        }
    )


def same_day_filter(core: DataFrame) -> DataFrame:
    """Events whose arrival and scheduled arrival share the calendar date."""
    return core.filter(F.to_date("arrival_time") == F.to_date("scheduled_arrival_time"))
