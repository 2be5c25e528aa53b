"""Queries: sources, projection and filters, joins, detection, repair, timetable."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from contextlib import suppress
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haltwerk.functions.ordered import Series, keep_first, neighbours
from haltwerk.functions.scalars import clip, service_date, status_code
from haltwerk.operators import detect, diagnostics, enrich, features, increments, matching, quality, rescue, timetable
from haltwerk.plans import core as core_plan
from haltwerk.plans import oracle
from haltwerk.plans.registry import query
from haltwerk.session import checkpoint_folder, delete_at_exit, delete_folder, newest_change
from haltwerk.sources import files
from haltwerk.sources.driver_tables import GappyFeed, SharedTrips, Tables


def scratch(t: Tables, name: str) -> str:
    """A fresh folder in the shared checkpoint location."""
    return f"{checkpoint_folder(t.spark)}/haltwerk-{name}-{uuid.uuid4().hex}"


def indexed(t: Tables) -> DataFrame:
    return detect.index_pings(t.telemetry, t.pings)


def detected(t: Tables) -> DataFrame:
    return detect.detect_stop_events(t.telemetry, series=t.pings, carry=core_plan.ATTRIBUTES, keep_rescan=True)


def rescued(t: Tables) -> DataFrame:
    return core_plan.stop_events(t.telemetry, series=t.pings)


def schedule(t: Tables, inclusive: bool = True) -> DataFrame:
    return timetable.expand_timetable(t.raw_timetable, inclusive)


def nearest(t: Tables) -> DataFrame:
    return matching.add_delays(matching.match_nearest(rescued(t), schedule(t)))


def timed(t: Tables) -> DataFrame:
    kept = matching.crossday_filter(matching.collision_dedup(nearest(t)))
    return matching.add_travel_time(matching.add_dwell_time(kept), t.arrivals)


def written(t: Tables, df: DataFrame, name: str) -> DataFrame:
    path = scratch(t, name)
    files.write_parquet(df, path)
    return t.spark.read.parquet(path)


def fresh_core(t: Tables) -> DataFrame:
    return core_plan.core_table(t.telemetry, t.raw_timetable, ping_series=t.pings, arrival_series=t.arrivals)


_STORED: dict[tuple, str] = {}


def _forget(spark: SparkSession, application: str) -> None:
    """Delete the stored tables of an application when Python ends; its session may be stopped by then."""
    for key in [k for k in _STORED if k[0] == application]:
        with suppress(Exception):
            delete_folder(spark, _STORED.pop(key))


def stored_folder(t: Tables, name: str, write: Callable[[str], object], source: str = "events") -> str:
    """A folder that ``write`` fills once per state of the source table's files."""
    application = t.spark.sparkContext.applicationId
    key = (application, t.folder, name, newest_change(t.spark, f"{t.folder}/{source}.parquet"))
    if key not in _STORED:
        if not any(k[0] == application for k in _STORED):
            atexit.register(_forget, t.spark, application)
        path = scratch(t, name)
        write(path)
        for old in [k for k in _STORED if k[:3] == key[:3]]:
            delete_folder(t.spark, _STORED.pop(old))
        _STORED[key] = path
    return _STORED[key]


def stored(t: Tables, name: str, build: Callable[[], DataFrame], source: str = "events") -> DataFrame:
    """A table written once per state of the source table's files, then read.

    Analyses of the core table pass over it several times, so they read the
    written table, as one would in production.
    """
    return t.spark.read.parquet(stored_folder(t, name, lambda path: files.write_parquet(build(), path), source))


def core(t: Tables) -> DataFrame:
    """The written core table."""
    return stored(t, "core", lambda: fresh_core(t))


def clean_core(t: Tables) -> DataFrame:
    return matching.same_day_filter(core(t))


# -- sources and sinks --------------------------------------------------------


@query("load_telemetry", "SELECT ping_id, fzg_id, tst_iso, distanz, row_idx FROM pings")
def _(t):
    return indexed(t).select("ping_id", "fzg_id", "tst_iso", "distanz", "row_idx")


@query("scan_pruned", "SELECT user_id AS fzg_id, ts AS tst_iso, value AS distanz FROM events")
def _(t):
    return t.telemetry.select("fzg_id", "tst_iso", "distanz")


@query("scan_filtered", "SELECT event_id, user_id, value FROM events WHERE user_id = 7 AND value > 10")
def _(t):
    return t.events.filter("user_id = 7 and value > 10").select("event_id", "user_id", "value")


@query("csv_roundtrip", "SELECT linie, count(*) AS n, sum(lage) :: BIGINT AS lage_sum FROM telemetry GROUP BY linie")
def _(t):
    path = scratch(t, "csv")
    columns = "ping_id bigint, fzg_id bigint, tst_iso timestamp, linie bigint, lage bigint"
    rows = t.telemetry.select("ping_id", "fzg_id", "tst_iso", "linie", "lage")
    files.write_report_csv(rows, path)
    back = files.read_csv(t.spark, path, columns)
    return back.groupBy("linie").agg(F.count(F.lit(1)).alias("n"), F.sum("lage").alias("lage_sum"))


@query("regular_lines", "SELECT linie, count(*) AS n FROM telemetry WHERE linie IN (1,2,3,4,6,7,8,9,10,11,12) GROUP BY 1")
def _(t):
    path = scratch(t, "lines")
    files.write_report_csv(t.telemetry.select("ping_id", "linie"), path)
    scanned = files.read_csv(t.spark, path, "ping_id bigint, linie bigint")
    return files.regular_lines(scanned).groupBy("linie").agg(F.count(F.lit(1)).alias("n"))


@query(
    "load_telemetry_csv",
    """SELECT fzg_id, tst_iso, linie, fahrt_id, distanz, tuerkriterium, lage, status_text, pos_lat, topic
       FROM (SELECT *, 'feed' AS topic FROM telemetry)""",
)
def _(t):
    """25 columns in another order than the schema's, three of them unknown to it."""
    feed = t.telemetry.drop("ping_id", "k").withColumns(
        {
            "zieltext": F.lit("to, town"),
            "ort_nr_ziel_vvo": F.lit("V9"),
            "topic": F.lit("feed"),
            "qos": F.lit(0),
            "retain": F.lit(False),
            "payloadlen": F.length("status_text"),
            "extra_1": F.lit("x"),
            "extra_2": F.lit(None).cast("string"),
            "extra_3": F.lit('say "no"'),
        }
    )
    path = scratch(t, "feed")
    exact = {"header": True, "escape": '"', "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    feed.select(*sorted(feed.columns, reverse=True)).write.options(**exact).csv(path)
    rows = files.read_telemetry_csv(t.spark, path)
    return rows.select("fzg_id", "tst_iso", "linie", "fahrt_id", "distanz", "tuerkriterium", "lage", "status_text", "pos_lat", "topic")


@query("load_telemetry_text", "SELECT fzg_id, tst_iso, distanz, row_idx FROM pings")
def _(t):
    """Times as ISO text with a zone, parsed and numbered."""
    path = scratch(t, "telemetry")
    text = F.date_format(F.from_utc_timestamp("tst_iso", "Europe/Berlin"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+01:00'")
    files.write_parquet(t.telemetry.select("fzg_id", text.alias("tst_iso"), "ping_id", "distanz"), path)
    series = Series(keys=("fzg_id",), time="tst_iso", ties=("ping_id",))
    return files.load_telemetry(t.spark, path, series).select("fzg_id", "tst_iso", "distanz", "row_idx")


@query("load_timetable_csv", "SELECT fahrt_id, stop_index, ort_nr, scheduled_arrival_unix FROM schedule")
def _(t):
    path = scratch(t, "timetable")
    plan = t.raw_timetable.select("tst_iso", "segmente", F.lit("seen").alias("note"), "fahrt_id", "zp_abfahrt")
    plan.write.options(header=True, quote='"', escape='"').csv(path)
    return timetable.expand_timetable(files.load_timetable(t.spark, path)).select("fahrt_id", "stop_index", "ort_nr", "scheduled_arrival_unix")


@query("weather_clean", "SELECT * FROM weather")
def _(t):
    path = scratch(t, "weather")
    t.weather_text.write.options(header=True, sep=";", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return files.load_weather(t.spark, path)


@query("load_special_days", "SELECT * FROM special_days")
def _(t):
    path = scratch(t, "days")
    files.write_report_csv(t.special_days_text, path)
    return files.load_special_days(t.spark, path)


@query(
    "parquet_roundtrip",
    """SELECT CAST(arrival_time - INTERVAL 4 HOURS AS DATE) AS service_date, count(*) AS n,
       round(sum(dwell_time), 6) AS dwell_sum FROM core GROUP BY 1""",
)
def _(t):
    path = scratch(t, "core")
    core_plan.write_core(fresh_core(t), path)
    back = t.spark.read.parquet(path)
    return back.groupBy("service_date").agg(F.count(F.lit(1)).alias("n"), F.sum("dwell_time").alias("dwell_sum"))


@query("report_csv", "SELECT linie, count(*) AS total_rows, count(*) FILTER (n5) AS n5_count FROM noise GROUP BY linie")
def _(t):
    path = scratch(t, "report")
    flagged = quality.noise_flags(t.telemetry, series=t.trips)
    files.write_report_csv(quality.noisy_by_line(flagged).select("linie", "total_rows", "n5_count"), path)
    return files.read_csv(t.spark, path, "linie bigint, total_rows bigint, n5_count bigint")


@query("summary_json", "SELECT count(*) AS total_rows, count(*) FILTER (gap_sec > 86400) AS trip_gap_count FROM trip_steps")
def _(t):
    path = scratch(t, "summary")
    files.write_summary_json(quality.gap_summary(t.telemetry, 86_400, t.trips), path)
    return t.spark.read.schema("total_rows bigint, trip_gap_count bigint").json(path)


@query(
    "mode_split",
    """SELECT CASE WHEN linie IN (1,2,3,4,6,7,8,9,10,11,12,13,20) THEN 'tram' ELSE 'bus' END AS mode, count(*) AS n,
       count(DISTINCT linie) AS lines FROM telemetry GROUP BY 1""",
)
def _(t):
    path = scratch(t, "modes")
    files.write_modes(t.telemetry.select("ping_id", "linie"), path)
    back = t.spark.read.parquet(path)
    return back.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("linie").alias("lines"))


# -- projection and filters ---------------------------------------------------


@query(
    "project_core",
    "SELECT fzg_id AS vehicle, fahrt_id AS trip, ort_nr_start AS stop, stop_status, round(dwell_time, 6) AS dwell FROM core",
)
def _(t):
    return core(t).selectExpr("fzg_id as vehicle", "fahrt_id as trip", "ort_nr_start as stop", "stop_status", "dwell_time as dwell")


@query("mode_rows", "SELECT ping_id, linie FROM telemetry WHERE linie NOT IN (1,2,3,4,6,7,8,9,10,11,12,13,20)")
def _(t):
    return files.split_mode(t.telemetry.select("ping_id", "linie")).filter("mode = 'bus'").drop("mode")


@query(
    "week_slice",
    """SELECT ping_id, tst, FALSE AS outside FROM telemetry WHERE substr(tst, 1, 10) BETWEEN '2024-01-08' AND '2024-01-14'
       UNION ALL SELECT ping_id, tst, TRUE FROM telemetry WHERE substr(tst, 1, 10) NOT BETWEEN '2024-01-08' AND '2024-01-14'""",
)
def _(t):
    rows = t.telemetry.select("ping_id", "tst")
    inside = files.week_slice(rows, "2024-01-08", "2024-01-14").withColumn("outside", F.lit(False))
    return inside.unionByName(files.outside_week(rows, "2024-01-08", "2024-01-14").withColumn("outside", F.lit(True)))


@query("real_vehicles", "SELECT fzg_id, fzg_nr, typ FROM numbered")
def _(t):
    return enrich.real_vehicles(t.vehicles).select("fzg_id", "fzg_nr", "typ")


@query(
    "gps_bbox_fixed",
    """SELECT ping_id, round(pos_lat, 6) AS pos_lat, round(pos_lon, 6) AS pos_lon FROM telemetry
       WHERE pos_lat < 50.9 OR pos_lat > 51.05 OR pos_lon < 13.5 OR pos_lon > 13.72""",
)
def _(t):
    return diagnostics.gps_outside(t.telemetry, (50.9, 51.05), (13.5, 13.72)).select("ping_id", "pos_lat", "pos_lon")


@query(
    "gps_bbox_adaptive",
    """, valid AS (SELECT *, row_number() OVER (ORDER BY pos_lat) - 1 AS ra, row_number() OVER (ORDER BY pos_lon) - 1 AS ro,
         count(*) OVER () AS n FROM telemetry WHERE pos_lat > 1 AND pos_lon > 1),
       box AS (SELECT min(pos_lat) FILTER (ra = floor(0.001 * (n - 1) + 0.5)) AS a0,
         min(pos_lat) FILTER (ra = floor(0.999 * (n - 1) + 0.5)) AS a1,
         min(pos_lon) FILTER (ro = floor(0.001 * (n - 1) + 0.5)) AS o0,
         min(pos_lon) FILTER (ro = floor(0.999 * (n - 1) + 0.5)) AS o1 FROM valid)
       SELECT ping_id, round(pos_lat, 6) AS pos_lat, round(pos_lon, 6) AS pos_lon FROM valid, box
       WHERE pos_lat < a0 OR pos_lat > a1 OR pos_lon < o0 OR pos_lon > o1""",
)
def _(t):
    return diagnostics.gps_outside_adaptive(t.telemetry).select("ping_id", "pos_lat", "pos_lon")


@query(
    "core_completeness",
    """SELECT count(*) AS total_rows, count(*) FILTER (full_row) AS complete_rows, round(count(*) FILTER (full_row) / count(*), 6) AS core_completeness_rate
       FROM (SELECT distanz IS NOT NULL AND tuerkriterium IS NOT NULL AND fahrt_id IS NOT NULL AND ort_nr_start IS NOT NULL AS full_row FROM telemetry)""",
    views=oracle.GAPPY_FEED,
)
def _(t):
    return quality.core_completeness(GappyFeed(t.spark, t.folder, t.hot_rows).telemetry)


@query("stop_status_rule", "SELECT fzg_id, drop_row_idx, stop_status FROM detected")
def _(t):
    return detected(t).select(
        "fzg_id",
        "drop_row_idx",
        detect.classify(F.col("door_open_count"), F.col("door_near_drop"), F.col("is_true_multi_door")).alias("stop_status"),
    )


@query(
    "clip_outliers",
    """SELECT fzg_id, drop_row_idx, round(CAST(greatest(0, least(120, dwell_time)) AS DOUBLE), 6) AS dwell_time,
       CASE WHEN travel_time IS NOT NULL THEN round(CAST(greatest(10, least(600, travel_time)) AS DOUBLE), 6) END AS travel_time
       FROM core""",
)
def _(t):
    return features.clip_outliers(core(t)).select(
        "fzg_id", "drop_row_idx", "dwell_time", clip("travel_time", *features.TRAVEL_CLIP).alias("travel_time")
    )


@query(
    "sentinel_fill",
    """SELECT fzg_id, drop_row_idx, round(CASE WHEN dwell_time = -1 THEN 40 ELSE dwell_time END, 6) AS dwell_time,
       nullif(besetztgrad, -1) AS occupancy FROM core WHERE dwell_time >= -1""",
)
def _(t):
    return features.sentinel_fill(core(t)).select(
        "fzg_id", "drop_row_idx", "dwell_time", F.nullif(F.col("besetztgrad"), F.lit(-1)).alias("occupancy")
    )


@query(
    "status_code",
    """SELECT fzg_id, drop_row_idx, stop_status,
       CASE stop_status WHEN 'normal' THEN 0 WHEN 'multi_door' THEN 1 ELSE 2 END :: BIGINT AS code FROM core""",
)
def _(t):
    return core(t).select("fzg_id", "drop_row_idx", "stop_status", status_code("stop_status").alias("code"))


@query(
    "crossday_filter",
    "SELECT fzg_id, drop_row_idx, round(delay_calculated_sec, 6) AS delay_calculated_sec, delay_recorded_sec FROM same_days",
)
def _(t):
    kept = matching.crossday_filter(matching.collision_dedup(nearest(t)))
    return kept.select("fzg_id", "drop_row_idx", "delay_calculated_sec", "delay_recorded_sec")


@query("same_day_filter", "SELECT fzg_id, drop_row_idx, arrival_time, scheduled_arrival_time FROM clean_core")
def _(t):
    return clean_core(t).select("fzg_id", "drop_row_idx", "arrival_time", "scheduled_arrival_time")


# -- joins --------------------------------------------------------------------


@query("drop_row_attrs", "SELECT fzg_id, drop_row_idx, fahrt_id, ort_nr_start, lage, besetztgrad FROM rescued")
def _(t):
    plain = detect.detect_stop_events(t.telemetry, series=t.pings).select("fzg_id", "drop_row_idx")
    return matching.drop_row_attributes(plain, indexed(t), ["fahrt_id", "ort_nr_start", "lage", "besetztgrad"])


@query(
    "match_service_date",
    "SELECT fzg_id, drop_row_idx, service_date, count(stop_index) AS n_candidates FROM candidates GROUP BY 1, 2, 3",
)
def _(t):
    return matching.match_nearest(rescued(t), schedule(t)).select("fzg_id", "drop_row_idx", "service_date", "n_candidates")


@query(
    "match_trip_stop",
    """SELECT e.fzg_id, e.drop_row_idx, s.stop_index, s.scheduled_arrival_time,
       round((epoch_us(e.drop_time) - epoch_us(s.scheduled_arrival_time)) / 1e6, 6) AS delay_calculated_sec
       FROM rescued e JOIN schedule_from s ON s.fahrt_id = e.fahrt_id AND s.ort_nr = e.ort_nr_start
       QUALIFY row_number() OVER (PARTITION BY e.fzg_id, e.drop_row_idx
         ORDER BY abs(epoch_us(e.drop_time) - epoch_us(s.scheduled_arrival_time)), s.stop_index) = 1""",
)
def _(t):
    events = stored(t, "rescued", lambda: rescued(t))  # read for the cut, the edges and the merge
    matched = matching.match_nearest(
        events, schedule(t, inclusive=False), keys=("fahrt_id", "ort_nr_start"), time_col="drop_time"
    ).filter("scheduled_arrival_time is not null")
    return matching.add_delays(matched, "drop_time").select(
        "fzg_id", "drop_row_idx", "stop_index", "scheduled_arrival_time", "delay_calculated_sec"
    )


@query("nearest_schedule", "SELECT fzg_id, drop_row_idx, stop_index, scheduled_arrival_time FROM nearest")
def _(t):
    return nearest(t).select("fzg_id", "drop_row_idx", "stop_index", "scheduled_arrival_time")


@query(
    "join_weather",
    """SELECT fzg_id, drop_row_idx, arrival_time, TMK, TXK, TNK, TGK, RSK, RSKF, SDK, SHK_TAG, FM
       FROM core LEFT JOIN weather ON MESS_DATUM = CAST(arrival_time AS DATE)""",
)
def _(t):
    joined = enrich.join_weather(core(t), enrich.clean_weather(t.weather_text))
    return joined.select("fzg_id", "drop_row_idx", "arrival_time", *enrich.WEATHER_COLUMNS)


@query(
    "join_vehicle",
    """SELECT core.fzg_id, drop_row_idx, fahrzueg_type, "fahrgasttüren", "länge_m", "sitzplätze", "stehplätze", v.kapazitaet
       FROM core LEFT JOIN vehicle_table v USING (fzg_id)""",
)
def _(t):
    joined = enrich.join_vehicle_info(core(t), enrich.vehicle_info(t.vehicles, t.vehicle_ranges))
    return joined.select("fzg_id", "drop_row_idx", *enrich.VEHICLE_COLUMNS)


@query(
    "join_special_days",
    """SELECT fzg_id, drop_row_idx, event_type, location AS event_location, round(latitude, 6) AS event_latitude,
       longitude AS event_longitude, event_type IS NOT NULL AS has_special_event
       FROM core LEFT JOIN special_days ON date = CAST(arrival_time AS DATE)""",
)
def _(t):
    joined = enrich.join_special_days(core(t), enrich.clean_special_days(t.special_days_text))
    return joined.select(
        "fzg_id", "drop_row_idx", "event_type", "event_location", "event_latitude", "event_longitude", "has_special_event"
    )


def _numbered(t: Tables) -> DataFrame:
    chosen = enrich.real_vehicles(t.vehicles).select("fzg_id", "fzg_nr", "typ")
    return chosen.withColumn("fzg_nr_int", enrich.vehicle_number("fzg_nr"))


_RANGE_SQL = """SELECT fzg_id, fzg_nr_int, fahrzueg_type, fzg_nr_from, fzg_nr_to FROM numbered {how} JOIN ranges
                ON fzg_nr_int BETWEEN fzg_nr_from AND fzg_nr_to"""


@query("range_lookup", _RANGE_SQL.format(how=""))
def _(t):
    ranges = t.vehicle_ranges.drop("typ")
    found = enrich.range_lookup(_numbered(t), "fzg_nr_int", ranges, "fzg_nr_from", "fzg_nr_to", how="inner")
    return found.select("fzg_id", "fzg_nr_int", "fahrzueg_type", "fzg_nr_from", "fzg_nr_to")


@query("range_lookup_left", _RANGE_SQL.format(how="LEFT"))
def _(t):
    ranges = t.vehicle_ranges.drop("typ")
    found = enrich.range_lookup(_numbered(t), "fzg_nr_int", ranges, "fzg_nr_from", "fzg_nr_to")
    return found.select("fzg_id", "fzg_nr_int", "fahrzueg_type", "fzg_nr_from", "fzg_nr_to")


def shared_core(t: Tables) -> DataFrame:
    """The written core table of a feed in which vehicles share trips."""
    return stored(t, "shared-core", lambda: fresh_core(SharedTrips(t.spark, t.folder, t.hot_rows)))


@query(
    "collision_semi",
    """SELECT fzg_id, drop_row_idx, fahrt_id, ort_nr_start, scheduled_arrival_time FROM core
       QUALIFY count(*) OVER (PARTITION BY fahrt_id, ort_nr_start, scheduled_arrival_time) > 1""",
    views=oracle.SHARED_TRIPS,
)
def _(t):
    return diagnostics.collision_semi(shared_core(t)).select(
        "fzg_id", "drop_row_idx", "fahrt_id", "ort_nr_start", "scheduled_arrival_time"
    )


@query("unmatched_vehicles", "SELECT fzg_id, fzg_nr, fzg_nr_int FROM vehicle_table WHERE fahrzueg_type IS NULL")
def _(t):
    numbered = _numbered(t)
    found = enrich.range_lookup(numbered, "fzg_nr_int", t.vehicle_ranges.drop("typ"), "fzg_nr_from", "fzg_nr_to", "inner")
    return enrich.unmatched_vehicles(numbered, found).select("fzg_id", "fzg_nr", "fzg_nr_int")


_TWO_TYPES_SQL = """
    , listed AS (SELECT user_id AS fzg_id, CASE WHEN event_type = 'view' THEN CAST(user_id % 5 AS VARCHAR)
                   ELSE event_type END AS typ FROM events)
    SELECT fzg_id, typ, count(*) AS n FROM listed WHERE regexp_matches(typ, '^[0-9]+$')
      AND fzg_id IN (SELECT fzg_id FROM listed WHERE regexp_matches(typ, 'click|purchase')) GROUP BY 1, 2"""


@query("named_and_numeric", "WITH" + _TWO_TYPES_SQL.strip()[1:])
def _(t):
    listed = t.events.select(
        F.col("user_id").alias("fzg_id"),
        F.when(F.col("event_type") == "view", (F.col("user_id") % 5).cast("string")).otherwise(F.col("event_type")).alias("typ"),
    )
    both = enrich.named_and_numeric(listed, "click|purchase")
    return both.groupBy("fzg_id", "typ").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stop_changed_filter",
    """SELECT r.fzg_id, r.drop_row_idx, r.stop_status, p.ort_nr_ziel AS ort_nr_end FROM rescued r
       JOIN pings p ON p.fzg_id = r.fzg_id AND p.row_idx = r.drop_row_idx
       WHERE p.row_idx > 0 AND p.ort_nr_start <> p.stop_before""",
)
def _(t):
    kept = detect.filter_stop_changed(rescued(t), t.telemetry, series=t.pings)
    return kept.select("fzg_id", "drop_row_idx", "stop_status", "ort_nr_end")


@query("patch_merge", "SELECT fzg_id, drop_row_idx, arrival_time, departure_time, stop_status FROM rescued")
def _(t):
    labelled = core_plan.stop_events(t.telemetry, series=t.pings, labels=True)
    keys, columns = ["fzg_id", "drop_row_idx"], ["arrival_time", "departure_time", "stop_status"]
    updates = labelled.filter("is_patched").select(*keys, *columns)
    return rescue.patch_merge(detected(t).select(*keys, *columns), updates, keys, columns)


@query("stop_names", "SELECT ort_nr, stop_name FROM names")
def _(t):
    return enrich.stop_names(t.stop_geometry)


@query(
    "event_context",
    """SELECT r.fzg_id, r.drop_row_idx, p.row_idx - r.drop_row_idx AS "offset", p.tst_iso, p.distanz, p.tuerkriterium
       FROM rescued r JOIN pings p ON p.fzg_id = r.fzg_id AND abs(p.row_idx - r.drop_row_idx) <= 3
       WHERE r.stop_status = 'no_door'""",
)
def _(t):
    chosen = rescued(t).filter("stop_status = 'no_door'").select("fzg_id", "drop_row_idx")
    around = diagnostics.event_context(chosen, indexed(t), k=3, series=t.pings)
    return around.select("fzg_id", "drop_row_idx", "offset", "tst_iso", "distanz", "tuerkriterium")


# -- detection ----------------------------------------------------------------


@query("row_delta", "SELECT ping_id, fzg_id, row_idx, round(delta, 6) + 0 AS delta FROM pings")
def _(t):
    return indexed(t).select("ping_id", "fzg_id", "row_idx", "delta")


@query("drops", "SELECT fzg_id, drop_row_idx AS row_idx, drop_time, round(delta_at_drop, 6) AS delta FROM falls")
def _(t):
    falls = detect.drops(t.telemetry, series=t.pings)
    return falls.select("fzg_id", "row_idx", F.col("tst_iso").alias("drop_time"), "delta")


@query("window_size", "SELECT n FROM size_n")
def _(t):
    return detect.window_size(detect.row_intervals(t.telemetry, series=t.pings))


@query(
    "window_size_by_vehicle",
    """SELECT fzg_id, CAST(trunc(greatest(3, least(10, median(drop_row_idx - prev_drop) / 2))) AS BIGINT) AS n
       FROM falls WHERE prev_drop IS NOT NULL GROUP BY fzg_id""",
)
def _(t):
    return detect.window_size_by_vehicle(detect.drop_intervals(t.telemetry, series=t.pings))


@query("window_bounds", "SELECT fzg_id, drop_row_idx, lo AS window_lo, hi AS window_hi FROM bounds")
def _(t):
    return detected(t).select("fzg_id", "drop_row_idx", "window_lo", "window_hi")


@query("door_counts", "SELECT fzg_id, drop_row_idx, door_open_count, door_close_count FROM detected")
def _(t):
    return detected(t).select("fzg_id", "drop_row_idx", "door_open_count", "door_close_count")


@query("arrival_departure", "SELECT fzg_id, drop_row_idx, drop_time, arrival_time, departure_time FROM detected")
def _(t):
    return detected(t).select("fzg_id", "drop_row_idx", "drop_time", "arrival_time", "departure_time")


@query("door_near_drop", "SELECT fzg_id, drop_row_idx, door_near_drop FROM detected")
def _(t):
    return detected(t).select("fzg_id", "drop_row_idx", "door_near_drop")


@query("multi_door", "SELECT fzg_id, drop_row_idx, door_open_count, is_true_multi_door FROM detected WHERE door_open_count >= 2")
def _(t):
    return detected(t).filter("door_open_count >= 2").select(
        "fzg_id", "drop_row_idx", "door_open_count", "is_true_multi_door"
    )


@query(
    "window_diag",
    """SELECT fzg_id, drop_row_idx, round(delta_at_drop, 6) AS delta_at_drop, min_distanz, max_distanz, lo AS window_lo,
       hi AS window_hi FROM detected""",
)
def _(t):
    return detected(t).select(
        "fzg_id", "drop_row_idx", "delta_at_drop", "min_distanz", "max_distanz", "window_lo", "window_hi"
    )


_EVENT_SQL = """fzg_id, drop_row_idx, drop_time, linie, lo AS window_lo, hi AS window_hi, arrival_time, departure_time,
    stop_status, door_open_count, door_close_count, door_near_drop, is_true_multi_door,
    round(delta_at_drop, 6) AS delta_at_drop, min_distanz, max_distanz"""


@query("stop_events", f"SELECT {_EVENT_SQL} FROM detected")
def _(t):
    return detect.detect_stop_events(t.telemetry, series=t.pings)


_HALVES_AT = "2024-01-16"


@query("stop_events_by_halves", f"SELECT {_EVENT_SQL} FROM detected", views={"size_n": "SELECT 5 AS n"})
def _(t):
    """The second half of the feed with the state that the first half leaves behind, and the first half's final events."""
    early, late = (t.telemetry.filter(f"tst_iso {side} TIMESTAMP '{_HALVES_AT}'") for side in ("<", ">="))
    first = increments.increment_events(early, None, 5, series=t.pings).filter("is_final")
    state = written(t, increments.next_state(early, None, series=t.pings), "state")
    second = increments.increment_events(late, state, 5, series=t.pings)
    return first.unionByName(second).select("fzg_id", *detect.EVENT_COLUMNS)


@query("stop_events_clustered", f"SELECT {_EVENT_SQL} FROM detected")
def _(t):
    """Detection over a store that is bucketed by vehicle and sorted by time."""
    name = f"haltwerk_pings_{uuid.uuid4().hex}"
    path = delete_at_exit(t.spark, scratch(t, "clustered"))
    pings = files.write_clustered(t.telemetry, name, path, ["fzg_id"], ["tst_iso", "ping_id"], buckets=8)
    return detect.detect_stop_events(pings, series=t.pings)


# -- repair -------------------------------------------------------------------


@query(
    "drop_neighbours",
    "SELECT fzg_id, drop_row_idx, prev_drop, next_drop, max_row FROM falls JOIN max_rows USING (fzg_id)",
)
def _(t):
    falls = detect.drops(t.telemetry, series=t.pings).select(
        "fzg_id", F.col("row_idx").alias("drop_row_idx"), F.col("tst_iso").alias("drop_time")
    )
    linked = rescue.drop_neighbours(falls, t.drops).join(rescue.last_rows(t.telemetry), "fzg_id")
    return linked.select("fzg_id", "drop_row_idx", "prev_drop", "next_drop", "max_row")


@query("rescue_cases", "SELECT fzg_id, drop_row_idx, rescue_case :: BIGINT AS rescue_case FROM cased")
def _(t):
    return rescue.rescue_cases(detected(t)).select("fzg_id", "drop_row_idx", "rescue_case")


_CASE_SQL = """SELECT fzg_id, drop_row_idx, arrival_time, departure_time, stop_status, is_patched FROM rescued
               WHERE rescue_case = {case}"""


def _case(t: Tables, case: int) -> DataFrame:
    labelled = core_plan.stop_events(t.telemetry, series=t.pings, labels=True)
    return labelled.filter(F.col("rescue_case") == case).select(
        "fzg_id", "drop_row_idx", "arrival_time", "departure_time", "stop_status", "is_patched"
    )


@query("rescue_case2", _CASE_SQL.format(case=2))
def _(t):
    return _case(t, 2)


@query("rescue_case1", _CASE_SQL.format(case=1))
def _(t):
    return _case(t, 1)


@query("rescued_stop_events", f"SELECT {_EVENT_SQL} FROM rescued")
def _(t):
    return rescued(t).select("fzg_id", *detect.EVENT_COLUMNS)


@query(
    "rescue_counts",
    """SELECT count(*) FILTER (rescue_case = 1) AS case_1, count(*) FILTER (rescue_case = 2) AS case_2,
       count(*) FILTER (is_patched) AS patched FROM rescued""",
)
def _(t):
    return rescue.rescue_counts(core_plan.stop_events(t.telemetry, series=t.pings, labels=True))


# A clock that stands still for eight hours at a time: many pings share an instant.


def coarse_telemetry(t: Tables) -> DataFrame:
    tick = 8 * 3600 * 1_000_000
    micros = F.unix_micros("tst_iso")
    return t.telemetry.withColumn("tst_iso", F.timestamp_micros(micros - F.pmod(micros, F.lit(tick))))


@query(
    "rescued_coarse_clock",
    "SELECT fzg_id, drop_row_idx, rescue_case :: BIGINT AS rescue_case, arrival_time, departure_time, stop_status, is_patched FROM rescued",
    views=oracle.COARSE_CLOCK,
)
def _(t):
    found = core_plan.stop_events(coarse_telemetry(t), series=t.pings, labels=True)
    return found.select("fzg_id", "drop_row_idx", "rescue_case", "arrival_time", "departure_time", "stop_status", "is_patched")


@query(
    "rescan_coarse_clock",
    "SELECT fzg_id, drop_row_idx, rescue_case :: BIGINT AS rescue_case, arrival_time, departure_time, stop_status, is_patched FROM rescued",
    views=oracle.COARSE_CLOCK,
)
def _(t):
    """The same with a second look at the pings in place of the detection's own columns."""
    pings = coarse_telemetry(t)
    found = rescue.rescue_dwell_times(detect.detect_stop_events(pings, series=t.pings), pings, series=t.pings, keep_labels=True)
    return found.select("fzg_id", "drop_row_idx", "rescue_case", "arrival_time", "departure_time", "stop_status", "is_patched")


# -- timetable and measures ---------------------------------------------------


@query(
    "latest_snapshot",
    """SELECT fahrt_id, CAST(1704067200 + (fahrt_id % 10) * 864000 AS BIGINT) AS zp_abfahrt,
       '2023-12-15T06:30:00.500Z' AS tst_iso FROM trips WHERE fahrt_id % 17 <> 0""",
)
def _(t):
    return timetable.latest_snapshot(t.raw_timetable).select("fahrt_id", "zp_abfahrt", "tst_iso")


@query("expand_segments", "SELECT fahrt_id, zp_abfahrt, stop_index, ort_nr, lenkzeit FROM segments")
def _(t):
    return timetable.expand_segments(timetable.latest_snapshot(t.raw_timetable)).drop("_list")


_SCHEDULE_SQL = "SELECT fahrt_id, stop_index, ort_nr, scheduled_arrival_unix, scheduled_arrival_time FROM "


@query("schedule_inclusive", _SCHEDULE_SQL + "schedule")
def _(t):
    return schedule(t)


@query("schedule_exclusive", _SCHEDULE_SQL + "schedule_from")
def _(t):
    return schedule(t, inclusive=False)


@query("service_date", "SELECT ping_id, tst_iso, CAST(tst_iso - INTERVAL 4 HOURS AS DATE) AS service_date FROM telemetry")
def _(t):
    return t.telemetry.select("ping_id", "tst_iso", service_date("tst_iso").alias("service_date"))


@query(
    "delay",
    "SELECT fzg_id, drop_row_idx, round(delay_calculated_sec, 6) AS delay_calculated_sec, delay_recorded_sec FROM nearest",
)
def _(t):
    return nearest(t).select("fzg_id", "drop_row_idx", "delay_calculated_sec", "delay_recorded_sec")


@query("collision_dedup", "SELECT fzg_id, drop_row_idx, fahrt_id, ort_nr_start, service_date, stop_status FROM deduped")
def _(t):
    return matching.collision_dedup(nearest(t)).select(
        "fzg_id", "drop_row_idx", "fahrt_id", "ort_nr_start", "service_date", "stop_status"
    )


@query("dwell_time", "SELECT fzg_id, drop_row_idx, stop_status, round(dwell_time, 6) AS dwell_time FROM timed")
def _(t):
    return timed(t).select("fzg_id", "drop_row_idx", "stop_status", "dwell_time")


@query("travel_time", "SELECT fzg_id, drop_row_idx, round(travel_time, 6) AS travel_time FROM timed")
def _(t):
    return timed(t).select("fzg_id", "drop_row_idx", "travel_time")


@query(
    "core_stop_events",
    """SELECT fzg_id, drop_row_idx, arrival_time, departure_time, linie, fahrt_id, ort_nr_start, stop_index, stop_status,
       scheduled_arrival_time, round(delay_calculated_sec, 6) AS delay_calculated_sec, delay_recorded_sec,
       round(dwell_time, 6) AS dwell_time, round(travel_time, 6) AS travel_time, besetztgrad FROM core""",
)
def _(t):
    return fresh_core(t).select(*matching.CORE_COLUMNS)


@query(
    "match_report",
    """SELECT count(*) AS matched, count(*) FILTER (delay_calculated_sec > 3600) AS extreme_late,
       count(*) FILTER (delay_calculated_sec < -180) AS extreme_early,
       count(*) FILTER (CAST(arrival_time - INTERVAL 4 HOURS AS DATE) <>
                        CAST(scheduled_arrival_time - INTERVAL 4 HOURS AS DATE)) AS date_mismatch,
       (SELECT count(*) FROM rescued) AS total, (SELECT count(*) FROM rescued) - count(*) AS unmatched,
       round(100.0 * count(*) / (SELECT count(*) FROM rescued), 6) AS matched_pct FROM core""",
)
def _(t):
    return matching.match_report(rescued(t), core(t))


@query(
    "timetable_stats",
    """SELECT count(*) AS n_trips, CAST(sum(stops) AS BIGINT) AS n_rows, round(avg(stops), 6) AS mean_stops,
       round(stddev_samp(stops), 6) AS std_stops, min(stops) AS min_stops, max(stops) AS max_stops,
       min(a) AS first_time, max(b) AS last_time, (SELECT count(DISTINCT ort_nr) FROM schedule) AS n_stops
       FROM (SELECT fahrt_id, count(*) AS stops, min(scheduled_arrival_time) AS a, max(scheduled_arrival_time) AS b
             FROM schedule GROUP BY 1)""",
)
def _(t):
    return timetable.timetable_stats(schedule(t))


@query("vehicle_number", "SELECT fzg_id, fzg_nr, fzg_nr_int FROM numbered")
def _(t):
    return _numbered(t).select("fzg_id", "fzg_nr", "fzg_nr_int")


@query("vehicle_info", "SELECT * FROM vehicle_table")
def _(t):
    return enrich.vehicle_info(t.vehicles, t.vehicle_ranges)


@query("load_vehicle_info_csv", "SELECT * FROM vehicle_table")
def _(t):
    """Both files in another column order than the schemas'."""
    listed, ranges = scratch(t, "vehicles"), scratch(t, "ranges")
    vehicles = t.vehicles.withColumn("masse", F.lit(1.5))
    files.write_report_csv(vehicles.select(*vehicles.columns[::-1]), listed)
    files.write_report_csv(t.vehicle_ranges.select(*t.vehicle_ranges.columns[::-1]), ranges)
    return files.load_vehicle_info(t.spark, listed, ranges).select(*enrich.vehicle_info(t.vehicles, t.vehicle_ranges).columns)


@query(
    "binary_features",
    """SELECT fzg_id, drop_row_idx, is_peak_hour :: BIGINT AS is_peak_hour, is_workday :: BIGINT AS is_workday,
       CAST(NULL AS BIGINT) AS has_traffic_signal FROM core""",
)
def _(t):
    return core(t).select("fzg_id", "drop_row_idx", "is_peak_hour", "is_workday", "has_traffic_signal")


@query(
    "stop_changed",
    "SELECT fzg_id, row_idx, row_idx > 0 AND ort_nr_start <> stop_before AS ort_changed FROM pings",
)
def _(t):
    return detect.stop_changed(indexed(t), series=t.pings).select("fzg_id", "row_idx", "ort_changed")


@query("row_index", "SELECT ping_id, fahrt_id, row_number() OVER (PARTITION BY fahrt_id ORDER BY tst_iso, ping_id) - 1 AS row_idx FROM telemetry")
def _(t):
    trips = t.trips
    return neighbours(t.telemetry, trips, index="row_idx").select("ping_id", "fahrt_id", "row_idx")


@query(
    "drop_segments",
    """SELECT fzg_id, row_idx, CASE WHEN delta IS NOT NULL THEN CAST(sum(CASE WHEN is_drop THEN 1 ELSE 0 END) OVER
         (PARTITION BY fzg_id ORDER BY row_idx) AS BIGINT) END AS drop_segment FROM flagged""",
)
def _(t):
    return detect.drop_segments(t.telemetry, series=t.pings).select("fzg_id", "row_idx", "drop_segment")


# The same with keys of over 20 rows cut: the plain statements check the cut.


def _cut(t: Tables) -> Tables:
    return replace(t, hot_rows=20)


@query("row_index_sliced", "SELECT ping_id, fahrt_id, row_number() OVER (PARTITION BY fahrt_id ORDER BY tst_iso, ping_id) - 1 AS row_idx FROM telemetry")
def _(t):
    return neighbours(t.telemetry, _cut(t).trips, index="row_idx").select("ping_id", "fahrt_id", "row_idx")


@query(
    "drop_segments_sliced",
    """SELECT fzg_id, row_idx, CASE WHEN delta IS NOT NULL THEN CAST(sum(CASE WHEN is_drop THEN 1 ELSE 0 END) OVER
         (PARTITION BY fzg_id ORDER BY row_idx) AS BIGINT) END AS drop_segment FROM flagged""",
)
def _(t):
    return detect.drop_segments(t.telemetry, series=_cut(t).pings).select("fzg_id", "row_idx", "drop_segment")


@query("stop_events_sliced", f"SELECT {_EVENT_SQL} FROM detected")
def _(t):
    return detect.detect_stop_events(t.telemetry, series=_cut(t).pings)


@query("rescued_stop_events_sliced", f"SELECT {_EVENT_SQL} FROM rescued")
def _(t):
    return rescued(_cut(t)).select("fzg_id", *detect.EVENT_COLUMNS)


@query(
    "dedup_first",
    """SELECT l_orderkey, l_linenumber :: BIGINT AS l_linenumber, l_partkey, l_shipdate FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) = 1""",
)
def _(t):
    lines = t.table("lineitem")
    first = keep_first(lines, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])
    return first.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
