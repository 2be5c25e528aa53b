"""The adapter views and the pipeline restated in SQL, for checking only.

Each view is a common table expression; :func:`with_views` puts the needed
ones before a statement.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

INDEX_WINDOW = "(PARTITION BY fzg_id ORDER BY tst_iso, ping_id)"
TRIP_WINDOW = "(PARTITION BY fahrt_id ORDER BY tst_iso, ping_id)"

VIEWS: dict[str, str] = {
    "telemetry": r"""
        SELECT event_id AS ping_id, user_id AS fzg_id, ts AS tst_iso,
               strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS tst,
               value AS distanz, event_type IN ('purchase', 'click') AS tuerkriterium,
               user_id % 13 AS linie, user_id * 10 + (day(ts) - 1) // 10 AS fahrt_id, k,
               k % 5 AS ort_nr_start, (k + 1) % 5 AS ort_nr_ziel, 'V' || (k % 5) AS ort_nr_start_vvo,
               CAST(floor(value * 4) AS BIGINT) - 400 AS lage,
               CASE WHEN k % 10 = 0 THEN -1 ELSE k % 7 END AS besetztgrad,
               CASE WHEN event_id % 500 = 0 THEN CAST(0 AS DOUBLE) ELSE 51 + k / 1000 END AS pos_lat,
               CAST(13.7 AS DOUBLE) + value / 10000 AS pos_lon,
               CASE event_type WHEN 'signup' THEN 'planm' WHEN 'error' THEN 'posUnklar' WHEN 'view' THEN 'ohneFahrt'
                    WHEN 'click' THEN 'vvo' ELSE 'dispo' END AS status_text,
               CASE WHEN event_id % 50 <> 0 THEN 'L' || (user_id % 13) END AS linie_text
        FROM (SELECT *, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k FROM events)""",
    "pings": f"""
        SELECT *, row_number() OVER w - 1 AS row_idx, distanz - lag(distanz) OVER w AS delta,
               lag(tuerkriterium) OVER w AS door_before, lead(tuerkriterium) OVER w AS door_after,
               lag(tst_iso) OVER w AS time_before, lag(pos_lat) OVER w AS lat_prev, lag(pos_lon) OVER w AS lon_prev,
               lag(ort_nr_start) OVER w AS stop_before
        FROM telemetry WINDOW w AS {INDEX_WINDOW}""",
    "flagged": """
        SELECT *, coalesce(delta < -100, FALSE) AS is_drop,
               coalesce(NOT door_before AND tuerkriterium, FALSE) AS opens,
               coalesce(door_before AND NOT tuerkriterium, FALSE) AS closes
        FROM pings""",
    "max_rows": "SELECT fzg_id, max(row_idx) AS max_row FROM pings GROUP BY fzg_id",
    "falls": """
        SELECT fzg_id, row_idx AS drop_row_idx, tst_iso AS drop_time, linie, fahrt_id, ort_nr_start, ort_nr_ziel, lage,
               besetztgrad, delta AS delta_at_drop, tuerkriterium,
               coalesce(door_before, FALSE) OR coalesce(tuerkriterium, FALSE) OR coalesce(door_after, FALSE)
                   AS door_near_drop,
               lag(row_idx) OVER w AS prev_drop, lead(row_idx) OVER w AS next_drop, lag(tst_iso) OVER w AS prev_time
        FROM flagged WHERE is_drop WINDOW w AS (PARTITION BY fzg_id ORDER BY row_idx)""",
    "size_n": """
        SELECT coalesce(CAST(trunc(greatest(3, least(10, median(drop_row_idx - prev_drop) / 2))) AS BIGINT), 5) AS n
        FROM falls WHERE prev_drop IS NOT NULL""",
    "bounds": """
        SELECT f.*, n, max_row, greatest(0, drop_row_idx - n, coalesce(prev_drop + 1, 0)) AS lo,
               least(max_row, drop_row_idx + n, coalesce(next_drop - 1, max_row)) AS hi
        FROM falls f JOIN max_rows USING (fzg_id), size_n""",
    "in_window": """
        SELECT b.fzg_id, b.drop_row_idx, p.row_idx, p.tst_iso, p.distanz, p.delta, p.fahrt_id,
               p.opens AND p.row_idx > lo AS opening, p.closes AND p.row_idx > lo AS closing
        FROM bounds b JOIN flagged p ON p.fzg_id = b.fzg_id AND p.row_idx BETWEEN lo AND hi""",
    "counted": """
        SELECT fzg_id, drop_row_idx, count(*) FILTER (opening) AS door_open_count,
               count(*) FILTER (closing) AS door_close_count, min(row_idx) FILTER (opening) AS open_row,
               min(tst_iso) FILTER (opening) AS open_time, max(row_idx) FILTER (closing) AS close_row,
               max(tst_iso) FILTER (closing) AS close_time, min(distanz) AS min_distanz, max(distanz) AS max_distanz,
               count(DISTINCT fahrt_id) AS trips
        FROM in_window GROUP BY fzg_id, drop_row_idx""",
    "open_pairs": """
        SELECT fzg_id, drop_row_idx, row_idx AS a,
               lead(row_idx) OVER (PARTITION BY fzg_id, drop_row_idx ORDER BY row_idx) AS b
        FROM in_window WHERE opening""",
    "bad_events": """
        SELECT DISTINCT fzg_id, drop_row_idx FROM (
            SELECT o.fzg_id, o.drop_row_idx, a FROM open_pairs o JOIN in_window w
              ON w.fzg_id = o.fzg_id AND w.drop_row_idx = o.drop_row_idx AND w.row_idx BETWEEN a AND b
            GROUP BY o.fzg_id, o.drop_row_idx, a
            HAVING max(distanz) - min(distanz) >= 100 OR bool_or(w.row_idx > a AND delta < -30))""",
    "detected": """
        SELECT *, CASE WHEN door_open_count = 0 AND NOT door_near_drop THEN 'no_door'
                       WHEN door_open_count >= 2 AND is_true_multi_door THEN 'multi_door' ELSE 'normal' END AS stop_status
        FROM (
            SELECT b.*, c.* EXCLUDE (fzg_id, drop_row_idx), coalesce(open_time, drop_time) AS arrival_time,
                   CASE WHEN close_row > open_row THEN close_time ELSE coalesce(open_time, drop_time) END
                       AS departure_time,
                   door_open_count >= 2 AND trips = 1 AND x.fzg_id IS NULL AS is_true_multi_door
            FROM bounds b JOIN counted c USING (fzg_id, drop_row_idx)
            LEFT JOIN bad_events x ON x.fzg_id = b.fzg_id AND x.drop_row_idx = b.drop_row_idx)""",
    "cased": """
        SELECT *, CASE WHEN stop_status <> 'no_door' AND departure_time = arrival_time
                       THEN CASE WHEN arrival_time = drop_time THEN 2 ELSE 1 END ELSE 0 END AS rescue_case
        FROM detected""",
    "reopened": """
        SELECT c.fzg_id, c.drop_row_idx, min(p.tst_iso) AS first_open
        FROM cased c JOIN flagged p ON p.fzg_id = c.fzg_id AND p.opens
         AND p.row_idx > coalesce(prev_drop, -1) + 1 AND p.row_idx < coalesce(next_drop, max_row + 1)
        WHERE rescue_case = 2 GROUP BY c.fzg_id, c.drop_row_idx""",
    "following": """
        SELECT c.fzg_id, c.drop_row_idx, min(p.row_idx) AS first_after
        FROM cased c JOIN flagged p ON p.fzg_id = c.fzg_id AND p.tst_iso > c.arrival_time
        WHERE rescue_case = 1 GROUP BY c.fzg_id, c.drop_row_idx""",
    "reclosed": """
        SELECT c.fzg_id, c.drop_row_idx, max(p.tst_iso) AS last_close
        FROM cased c LEFT JOIN reopened r USING (fzg_id, drop_row_idx) LEFT JOIN following n USING (fzg_id, drop_row_idx)
        JOIN flagged p ON p.fzg_id = c.fzg_id AND (p.closes OR (p.row_idx = n.first_after AND NOT p.tuerkriterium))
         AND p.row_idx > coalesce(prev_drop, -1) AND p.row_idx < coalesce(next_drop, max_row + 1)
         AND p.tst_iso > CASE WHEN rescue_case = 2 THEN r.first_open ELSE c.arrival_time END
        WHERE rescue_case > 0 GROUP BY c.fzg_id, c.drop_row_idx""",
    "rescued": """
        SELECT c.* REPLACE (
                 CASE WHEN rescue_case = 2 THEN coalesce(first_open, drop_time) ELSE arrival_time END AS arrival_time,
                 CASE WHEN rescue_case = 2 THEN coalesce(last_close, first_open, drop_time)
                      WHEN rescue_case = 1 THEN coalesce(last_close, departure_time) ELSE departure_time END
                   AS departure_time,
                 CASE WHEN rescue_case = 2 AND first_open IS NULL THEN 'no_door' ELSE stop_status END AS stop_status),
               rescue_case = 2 OR (rescue_case = 1 AND last_close IS NOT NULL) AS is_patched
        FROM cased c LEFT JOIN reopened USING (fzg_id, drop_row_idx) LEFT JOIN reclosed USING (fzg_id, drop_row_idx)""",
    "trips": "SELECT DISTINCT fahrt_id FROM telemetry",
    "segments": """
        SELECT fahrt_id, CAST(1704067200 + (fahrt_id % 10) * 864000 AS BIGINT) AS zp_abfahrt, i AS stop_index,
               i % 4 AS ort_nr, CAST(10800 AS BIGINT) AS lenkzeit
        FROM trips, (SELECT unnest(range(0, 80)) AS i) WHERE fahrt_id % 17 <> 0""",
    "schedule": """
        SELECT fahrt_id, stop_index, ort_nr, unix AS scheduled_arrival_unix,
               make_timestamp(unix * 1000000) AS scheduled_arrival_time,
               CAST(make_timestamp(unix * 1000000) - INTERVAL 4 HOURS AS DATE) AS service_date
        FROM (SELECT *, zp_abfahrt + CAST(sum(lenkzeit) OVER (PARTITION BY fahrt_id ORDER BY stop_index) AS BIGINT)
                     AS unix FROM segments)""",
    "schedule_from": """
        SELECT fahrt_id, stop_index, ort_nr, scheduled_arrival_unix - 10800 AS scheduled_arrival_unix,
               make_timestamp((scheduled_arrival_unix - 10800) * 1000000) AS scheduled_arrival_time FROM schedule""",
    "dated": "SELECT *, CAST(arrival_time - INTERVAL 4 HOURS AS DATE) AS service_date FROM rescued",
    "candidates": """
        SELECT d.*, s.stop_index, s.scheduled_arrival_time,
               abs(epoch_us(d.arrival_time) - epoch_us(s.scheduled_arrival_time)) AS gap
        FROM dated d LEFT JOIN schedule s ON s.fahrt_id = d.fahrt_id AND s.ort_nr = d.ort_nr_start
         AND s.service_date = d.service_date""",
    "nearest": """
        SELECT *, (epoch_us(arrival_time) - epoch_us(scheduled_arrival_time)) / 1e6 AS delay_calculated_sec,
               lage AS delay_recorded_sec
        FROM candidates
        QUALIFY row_number() OVER (PARTITION BY fzg_id, drop_row_idx ORDER BY gap, stop_index) = 1""",
    "deduped": """
        SELECT * FROM nearest
        QUALIFY row_number() OVER (PARTITION BY fzg_id, fahrt_id, ort_nr_start, service_date
          ORDER BY CASE stop_status WHEN 'normal' THEN 0 WHEN 'multi_door' THEN 1 ELSE 2 END,
                   arrival_time, drop_row_idx) = 1""",
    "same_days": """
        SELECT * FROM deduped
        WHERE NOT (delay_calculated_sec > 3600 AND abs(delay_calculated_sec - delay_recorded_sec) > 3000)""",
    "timed": """
        SELECT *, CASE WHEN stop_status = 'no_door' THEN CAST(-1 AS DOUBLE)
                       ELSE (epoch_us(departure_time) - epoch_us(arrival_time)) / 1e6 END AS dwell_time,
               (epoch_us(arrival_time) - epoch_us(lag(departure_time) OVER
                 (PARTITION BY fzg_id ORDER BY arrival_time, drop_row_idx))) / 1e6 AS travel_time
        FROM same_days""",
    "core": """
        SELECT *, CASE WHEN hour(arrival_time) IN (7, 8, 16, 17, 18) THEN 1 ELSE 0 END AS is_peak_hour,
               CASE WHEN isodow(arrival_time) <= 5 THEN 1 ELSE 0 END AS is_workday
        FROM timed WHERE scheduled_arrival_time IS NOT NULL""",
    "clean_core": "SELECT * FROM core WHERE CAST(arrival_time AS DATE) = CAST(scheduled_arrival_time AS DATE)",
    "trip_steps": f"""
        SELECT *, distanz - lag(distanz) OVER w AS step, tst_iso - lag(tst_iso) OVER w AS gap,
               (epoch_us(tst_iso) - epoch_us(lag(tst_iso) OVER w)) // 1000000 AS gap_sec
        FROM telemetry WINDOW w AS {TRIP_WINDOW}""",
    "noise": """
        SELECT *, pos_lat = 0 OR pos_lon = 0 AS n1, coalesce(step > 300, FALSE) AS n2,
               coalesce(step < 0 AND distanz - step < 50, FALSE) AS n3, abs(lage) > 900 AS n4,
               lage = 0 AND status_text <> 'planm' AS n5,
               status_text IN ('posUnklar', 'ohneFahrt', 'keinFunk') AS n6
        FROM trip_steps""",
    "speeds": """
        SELECT *, CASE WHEN delta < -100 THEN CAST(-1 AS DOUBLE) WHEN delta < 0 THEN NULL
                       WHEN dt IS NULL OR dt = 0 THEN NULL ELSE delta / dt END AS speed_ms,
               CASE WHEN dt > 0 THEN gps_dist_m / dt END AS gps_speed_ms
        FROM (SELECT *, (epoch_us(tst_iso) - epoch_us(time_before)) // 1000000 AS dt,
                     2 * 6371000 * asin(sqrt(pow(sin(radians(pos_lat - lat_prev) / 2), 2) + cos(radians(lat_prev))
                       * cos(radians(pos_lat)) * pow(sin(radians(pos_lon - lon_prev) / 2), 2))) AS gps_dist_m
              FROM flagged)""",
    "closings": """
        SELECT f.fzg_id, f.drop_row_idx, max(p.row_idx) - f.drop_row_idx AS rows_to_close, -any_value(delta_at_drop)
                 AS drop_size
        FROM falls f LEFT JOIN flagged p ON p.fzg_id = f.fzg_id AND p.closes AND p.row_idx >= f.drop_row_idx
         AND (f.next_drop IS NULL OR p.row_idx < f.next_drop)
        GROUP BY f.fzg_id, f.drop_row_idx""",
    "doors": """
        SELECT c.*, tuerkriterium AS door_at_drop, CASE WHEN tuerkriterium THEN 'arrival' ELSE 'departure' END
                 AS drop_type
        FROM core c WHERE stop_status <> 'no_door'""",
    "by_line": """
        SELECT linie, count(*) AS total, count(*) FILTER (door_at_drop) AS arrival_drops,
               count(*) FILTER (NOT door_at_drop) AS departure_drops,
               round(count(*) FILTER (door_at_drop) / count(*) * 100, 1) AS pct_arrival,
               round(count(*) FILTER (NOT door_at_drop) / count(*) * 100, 1) AS pct_departure
        FROM doors GROUP BY linie""",
    "signals": """
        SELECT *, coalesce(lag(distanz_drop) OVER w, FALSE) AS drop_before,
               coalesce(lead(distanz_drop) OVER w, FALSE) AS drop_after
        FROM (SELECT *, row_idx > 0 AND ort_nr_start <> stop_before AS ort_changed,
                     row_idx > 0 AND delta < -100 AS distanz_drop FROM pings)
        WINDOW w AS (PARTITION BY fzg_id ORDER BY row_idx)""",
    "weather": """
        SELECT CASE WHEN day(d) <= 25 THEN d ELSE CAST(d + INTERVAL 100 YEARS AS DATE) END AS MESS_DATUM,
               CASE WHEN day(d) % 7 <> 3 THEN CAST((n % 300) / 10 AS DOUBLE) END AS TMK,
               CAST((n % 350) / 10 AS DOUBLE) AS TXK, CAST((top % 90) / 10 AS DOUBLE) AS TNK,
               round((top % 70) / 10 - 3, 1) AS TGK,
               CASE WHEN day(d) % 5 <> 0 THEN CAST((users % 40) / 10 AS DOUBLE) END AS RSK,
               CAST(n % 9 AS DOUBLE) AS RSKF, CAST((users % 110) / 10 AS DOUBLE) AS SDK,
               CAST(top % 4 AS DOUBLE) AS SHK_TAG, CAST((n % 80) / 10 AS DOUBLE) AS FM
        FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n, max(event_id) AS top, count(DISTINCT user_id) AS users
              FROM events GROUP BY 1)""",
    "special_days": """
        SELECT CAST(day(d) * 10 + i AS BIGINT) AS event_id,
               CASE WHEN day(d) IN (5, 12, 26) THEN d ELSE CAST(d + INTERVAL 100 YEARS AS DATE) END AS date,
               'type' || i AS event_type,
               'place' || day(d) AS location, CAST(51 + i / 10 AS DOUBLE) AS latitude, CAST(13.7 AS DOUBLE) AS longitude
        FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), (SELECT unnest([1, 2]) AS i)
        WHERE day(d) = 5 OR i = 1""",
    "vehicles": """
        SELECT p_partkey AS fzg_id,
               CASE WHEN p_partkey % 7 = 0 THEN NULL
                    WHEN p_partkey % 3 = 0 THEN '232 9' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '-' || (p_partkey % 10)
                    ELSE lpad(CAST(400 + p_size AS VARCHAR), 3, '0') || ' 001-' || (p_partkey % 10) END AS fzg_nr,
               CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_brand END AS typ, p_type AS typ_text,
               CAST(p_size AS BIGINT) AS typ_nr, CAST(p_size * 5 AS BIGINT) AS kapazitaet, p_retailprice AS laenge
        FROM part""",
    "ranges": """
        SELECT g || c AS typ, CAST(CASE g WHEN 'T' THEN 2900 + lo ELSE CAST(400 + lo AS BIGINT) * 1000 END AS BIGINT) AS fzg_nr_from,
               CAST(CASE g WHEN 'T' THEN 2900 + hi ELSE CAST(400 + hi AS BIGINT) * 1000 + 999 END AS BIGINT) AS fzg_nr_to,
               'kind' || g AS fahrzueg_type, CAST(c + 2 AS BIGINT) AS "fahrgasttüren",
               CAST(10 + c * 2.5 AS DOUBLE) AS "länge_m", CAST(30 + c * 10 AS BIGINT) AS "sitzplätze",
               CAST(50 + c * 15 AS BIGINT) AS "stehplätze"
        FROM (SELECT c, lo + CASE WHEN c > 4 THEN 10000000 ELSE 0 END AS lo, hi + CASE WHEN c > 4 THEN 10000000 ELSE 0 END AS hi
              FROM (SELECT (p_size - 1) // 8 AS c, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY 1)), (SELECT unnest(['T', 'B']) AS g)""",
    "numbered": """
        SELECT fzg_id, fzg_nr, typ,
               CASE WHEN digits = '' THEN NULL WHEN digits LIKE '232%' THEN CAST(substr(digits, 3, 4) AS BIGINT)
                    ELSE CAST(substr(digits, 1, 6) AS BIGINT) END AS fzg_nr_int
        FROM (SELECT *, regexp_replace(fzg_nr, '[^0-9]', '', 'g') AS digits FROM vehicles
              WHERE typ IS NOT NULL AND NOT regexp_matches(typ, '^[0-9]+$') AND fzg_nr IS NOT NULL)""",
    "vehicle_table": """
        SELECT fzg_id, fzg_nr, fzg_nr_int, numbered.typ, fahrzueg_type, "fahrgasttüren", "länge_m", "sitzplätze",
               "stehplätze", "sitzplätze" + "stehplätze" AS kapazitaet
        FROM numbered LEFT JOIN ranges ON fzg_nr_int BETWEEN fzg_nr_from AND fzg_nr_to""",
    "names": """
        SELECT DISTINCT n AS ort_nr, 'Halt ' || n || ' 1' AS stop_name
        FROM (SELECT CASE WHEN ort_nr_start < 4 THEN ort_nr_start ELSE ort_nr_start + 100 END AS n FROM telemetry)""",
    "visits": """
        SELECT *, (day_start + to_seconds((l_orderkey * 7 + l_linenumber * 4001) % 72000)) AS arrival_time,
               CASE WHEN month(day_start) BETWEEN 4 AND 10 AND NOT (year(day_start) < 1996 AND month(day_start) = 10)
                    THEN INTERVAL 2 HOURS ELSE INTERVAL 1 HOUR END AS zone
        FROM (SELECT *, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS day_start, l_suppkey AS fzg_id,
                (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS drop_row_idx, l_suppkey % 13 AS linie,
                l_suppkey AS fahrt_id, l_partkey % 50 AS ort_nr_start, l_partkey % 40 AS stop_index,
                CASE WHEN l_returnflag = 'R' THEN 'no_door' WHEN l_quantity > 45 THEN 'multi_door' ELSE 'normal' END
                  AS stop_status,
                l_extendedprice / 100 - 200 AS delay_calculated_sec,
                CASE WHEN l_returnflag = 'R' THEN CAST(-1 AS DOUBLE) ELSE l_quantity * 3 END AS dwell_time,
                l_quantity * 14 + l_discount * 100 AS travel_time, CAST(l_quantity AS BIGINT) AS besetztgrad
              FROM lineitem)""",
    "prepared": """
        SELECT *, CASE WHEN hour(arrival_time) IN (7, 8, 16, 17, 18) THEN 1 ELSE 0 END AS is_peak_hour,
               CASE WHEN isodow(arrival_time) <= 5 THEN 1 ELSE 0 END AS is_workday,
               CAST(arrival_time + zone AS DATE) AS local_date,
               CAST(hour(arrival_time + zone) AS BIGINT) AS hour_of_day,
               CAST(isodow(arrival_time + zone) AS BIGINT) AS day_of_week,
               CASE WHEN dwell_time = -1 THEN CAST(40 AS DOUBLE) ELSE dwell_time END AS dwell_filled
        FROM visits WHERE dwell_time >= -1""",
    "targets": """
        SELECT * FROM (
            SELECT *, lead(travel_time) OVER (PARTITION BY fahrt_id, local_date
                     ORDER BY stop_index, arrival_time, fzg_id, drop_row_idx) AS next_travel FROM prepared)
        WHERE next_travel IS NOT NULL""",
    "matrix": """
        SELECT fahrt_id, local_date AS service_date, greatest(0, least(120, dwell_filled)) AS dwell_time,
               delay_calculated_sec, stop_index, besetztgrad, linie, ort_nr_start,
               CASE stop_status WHEN 'normal' THEN 0 WHEN 'multi_door' THEN 1 ELSE 2 END AS stop_status,
               is_peak_hour, is_workday, hour_of_day, day_of_week, greatest(10, least(600, next_travel)) AS target
        FROM targets""",
    "split_days": """
        SELECT service_date, n, CASE WHEN full_day AND r = 1 THEN 'test' WHEN full_day AND r <= 3 THEN 'valid'
                                     ELSE 'train' END AS split
        FROM (SELECT *, n >= 50 AS full_day, count(*) FILTER (n >= 50) OVER (ORDER BY service_date DESC) AS r
              FROM (SELECT service_date, count(*) AS n FROM matrix GROUP BY 1))""",
    "splits": "SELECT m.*, d.split FROM matrix m JOIN split_days d USING (service_date)",
    "fixed": """
        SELECT * EXCLUDE (m) REPLACE (coalesce(m, avg(m) OVER (PARTITION BY split)) AS dwell_time)
        FROM (SELECT s.*, m FROM splits s LEFT JOIN
              (SELECT linie, avg(dwell_time) AS m FROM splits WHERE split = 'train' GROUP BY 1) USING (linie))""",
}


def changed(old: str, new: str) -> dict[str, str]:
    """The telemetry view with one expression replaced, for ``with_views``."""
    if VIEWS["telemetry"].count(old) != 1:
        raise ValueError(f"{old!r} does not stand in the view once")
    return {"telemetry": VIEWS["telemetry"].replace(old, new)}


# The feeds of the adapter's variants, see ``sources/driver_tables.py``.
SHARED_TRIPS = changed("user_id * 10 + (day(ts) - 1) // 10 AS fahrt_id", "(user_id % 15) * 10 + (user_id * 10 + (day(ts) - 1) // 10) % 10 AS fahrt_id")
COARSE_ODOMETER = changed("value AS distanz", "floor(value / 100) * 100 AS distanz")
COARSE_CLOCK = changed("ts AS tst_iso", "time_bucket(INTERVAL 8 HOURS, ts) AS tst_iso")
GAPPY_FEED = {
    "telemetry": f"""
        SELECT * REPLACE (CASE WHEN ping_id % 40 <> 0 THEN fahrt_id END AS fahrt_id, CASE WHEN ping_id % 55 <> 0 THEN ort_nr_start END AS ort_nr_start,
                          CASE WHEN ping_id % 77 <> 0 THEN tuerkriterium END AS tuerkriterium, CASE WHEN ping_id % 90 <> 0 THEN distanz END AS distanz)
        FROM ({VIEWS["telemetry"]})"""
}

_WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def _used(sql: str) -> set[str]:
    return set(_WORD.findall(sql)) & set(VIEWS)


def with_views(sql: str, replaced: Mapping[str, str] | None = None) -> str:
    """Put the views a statement uses, and theirs, before it; ``replaced`` gives other definitions of some."""
    views = {**VIEWS, **(replaced or {})}
    needed: set[str] = set()
    pending = list(_used(sql))
    while pending:
        name = pending.pop()
        if name not in needed:
            needed.add(name)
            pending += _used(views[name])
    if not needed:
        return sql
    parts = [f"{name} AS ({views[name]})" for name in views if name in needed]
    return "WITH " + ",\n".join(parts) + "\n" + sql
