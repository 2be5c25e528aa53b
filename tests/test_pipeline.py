"""Timetable, matching, features, enrichment, quality, model data and plans on hand-worked cases."""

import json
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from haltwerk.functions.ordered import Series
from haltwerk.operators import ablation, diagnostics, enrich, features, matching, motion, quality, timetable
from haltwerk.plans import core as core_plan
from haltwerk.sources import files
from haltwerk.sources.driver_tables import Tables

SMALL = "/root/testdata/sf0.001"


def ts(text):
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def seg(*stops):
    return json.dumps([{k: v for k, v in (("ort_nr", o), ("lenkzeit", z)) if v is not None} for o, z in stops])


def raw_timetable(spark, rows):
    return spark.createDataFrame(rows, "fahrt_id bigint, zp_abfahrt bigint, segmente string, tst_iso string")


def test_timetable_expansion(spark):
    raw = raw_timetable(
        spark,
        [
            (1, 1000, seg((5, 60), (6, 90)), "2025-07-22T10:00:00.000Z"),
            (1, 9999, seg((7, 1)), "2025-07-22T09:00:00.000Z"),
            (2, 1000, "[]", "2025-07-22T10:00:00.000Z"),
            (2, 1000, seg((5, 60)), "2025-07-21T10:00:00.000Z"),
            (3, 1000, "no json", "2025-07-22T10:00:00.000Z"),
            (4, 1000, seg((5, None), (6, 30)), "2025-07-22T10:00:00+02:00"),
        ],
    )
    got = {(r.fahrt_id, r.stop_index): (r.ort_nr, r.scheduled_arrival_unix) for r in timetable.expand_timetable(raw).collect()}
    assert got == {(1, 0): (5, 1060), (1, 1): (6, 1150), (4, 0): (5, 1000), (4, 1): (6, 1030)}
    later = {(r.fahrt_id, r.stop_index): r.scheduled_arrival_unix for r in timetable.expand_timetable(raw, inclusive=False).collect()}
    assert later == {(1, 0): 1000, (1, 1): 1060, (4, 0): 1000, (4, 1): 1000}


EVENT = "fzg_id bigint, drop_row_idx bigint, arrival_time timestamp, departure_time timestamp, linie bigint, fahrt_id bigint, ort_nr_start bigint, stop_status string, lage bigint, besetztgrad bigint"
PLAN = "fahrt_id bigint, stop_index bigint, ort_nr bigint, scheduled_arrival_time timestamp"


def event(row, at, trip, stop, status="normal", lage=0, leave=None, vehicle=1):
    return (vehicle, row, ts(at), ts(leave or at), 7, trip, stop, status, lage, 0)


def test_matching_rules(spark):
    events = spark.createDataFrame(
        [
            event(1, "2025-07-29T01:30:00", 1, 10, lage=5900, leave="2025-07-29T01:31:00"),  # after midnight, same service day
            event(2, "2025-07-29T08:00:00", 2, 20, leave="2025-07-29T08:00:30"),  # two calls: nearer one, tie to lower index
            event(3, "2025-07-29T09:00:00", 3, 30, "no_door"),  # collision, loses
            event(4, "2025-07-29T09:05:00", 3, 30, lage=700),  # collision, wins
            event(5, "2025-07-29T10:00:00", 9, 90),  # no schedule
            event(6, "2025-07-29T11:00:01", 4, 40, lage=700),  # 3601 late, 2901 off: kept
            event(7, "2025-07-29T12:00:01", 5, 50, lage=500),  # 3601 late, 3101 off: removed
            event(8, "2025-07-29T13:00:00", 6, 60, "no_door", leave="2025-07-29T13:00:00"),
        ],
        EVENT,
    )
    plan = spark.createDataFrame(
        [
            (1, 0, 10, ts("2025-07-28T23:50:00")),
            (2, 3, 20, ts("2025-07-29T07:50:00")),
            (2, 9, 20, ts("2025-07-29T08:10:00")),
            (3, 1, 30, ts("2025-07-29T09:00:00")),
            (4, 1, 40, ts("2025-07-29T10:00:00")),
            (5, 1, 50, ts("2025-07-29T11:00:00")),
            (6, 1, 60, ts("2025-07-29T13:00:00")),
        ],
        PLAN,
    )
    core = {r.drop_row_idx: r for r in matching.match_and_compute_delay(events, None, plan).collect()}
    assert set(core) == {1, 2, 4, 6, 8}
    assert core[1].delay_calculated_sec == 6000 and core[1].dwell_time == 60
    assert core[2].stop_index == 3 and core[2].travel_time == 23_340
    assert core[4].travel_time == 3870  # since row 2; row 3 lost the collision
    assert core[6].travel_time == 6901  # since row 4; the unmatched row 5 is skipped
    assert core[8].dwell_time == -1 and core[8].travel_time == 7199
    assert core[1].travel_time is None


def test_binary_features(spark):
    times = ["2025-07-31T06:59:59", "2025-07-31T07:00:00", "2025-08-01T09:00:00", "2025-08-01T16:00:00", "2025-08-02T19:00:00"]
    df = spark.createDataFrame([(ts(x),) for x in times], "arrival_time timestamp")
    got = [(r.is_peak_hour, r.is_workday, r.has_traffic_signal) for r in features.add_binary_features(df).collect()]
    assert got == [(0, 1, None), (1, 1, None), (0, 1, None), (1, 1, None), (0, 0, None)]
    strict = [r.is_workday for r in features.add_binary_features(df, workday_max_iso=4).collect()]
    assert strict == [1, 1, 0, 0, 0]


def test_vehicle_numbers(spark):
    df = spark.createDataFrame([("232 905-8",), ("464 001-3",), (None,), ("abc",)], "n string")
    assert [r.v for r in df.select(enrich.vehicle_number("n").alias("v")).collect()] == [2905, 464001, None, None]


def test_range_lookup_equals_brute_force(spark):
    points = [(i, k) for i, k in enumerate([0, 1, 5, 64, 65, 999_999, 2**40, -3, None])]
    ranges = [(0, 0), (0, 5), (5, 64), (64, 66), (-10, -1), (1, 2**41), (7, 6), (900_000, 1_100_000)]
    df = spark.createDataFrame(points, "id int, k bigint")
    table = spark.createDataFrame([(f"r{i}", a, b) for i, (a, b) in enumerate(ranges)], "name string, lo bigint, hi bigint")
    want = {(i, f"r{j}") for i, k in points if k is not None for j, (a, b) in enumerate(ranges) if a <= k <= b}
    got = {(r.id, r.name) for r in enrich.range_lookup(df, "k", table, "lo", "hi", "inner").collect()}
    assert got == want
    left = {(r.id, r.name) for r in enrich.range_lookup(df, "k", table, "lo", "hi").collect()}
    assert left == want | {(i, None) for i, _ in points if i not in {a for a, _ in want}}


def test_weather_and_special_days(spark, tmp_path):
    path = tmp_path / "weather.txt"
    path.write_text(
        "STATIONS_ID;MESS_DATUM; TMK; TXK; TNK; TGK; RSK;RSKF; SDK;SHK_TAG;  FM;eor\n"
        "1048;20250728;  12.3;  20.0;   8.0;   7.0; -999;   6;  1.0;   0;   3.2;eor\n"
    )
    row = files.load_weather(spark, str(path)).collect()[0]
    assert (row.MESS_DATUM, row.TMK, row.RSK, row.RSKF, row.FM) == (date(2025, 7, 28), 12.3, None, 6.0, 3.2)
    days = tmp_path / "days.csv"
    days.write_text("event_id,date,event_type,location,latitude,longitude\n1,2025-07-28,a,x,51.0,13.7\n2,2025-07-28,b,y,51.1,13.8\n")
    core = spark.createDataFrame([(ts("2025-07-28T10:00:00"),), (ts("2025-07-29T10:00:00"),)], "arrival_time timestamp")
    table = files.load_special_days(spark, str(days))
    joined = enrich.join_special_days(core, table)
    assert sorted((r.has_special_event, r.event_type or "") for r in joined.collect()) == [(False, ""), (True, "a"), (True, "b")]
    assert enrich.join_special_days(core, table, dedupe=True).count() == 2


def test_duplicates_count_all_copies(spark):
    df = spark.createDataFrame([(1, 1)] * 3 + [(2, 1), (2, 2)], "fzg_id int, tst_iso int")
    assert quality.hard_duplicates(df).collect()[0].hard_dup_count == 3
    soft = quality.soft_duplicates(df, ["fzg_id"]).collect()[0]
    assert (soft.soft_dup_extra_rows, soft.soft_dup_affected_groups, soft.soft_dup_rate) == (3, 2, 0.6)


def test_noise_union_counts_rows_once(spark):
    flags = "n1 boolean, n2 boolean, n3 boolean, n4 boolean, n5 boolean, n6 boolean"
    n, y = False, True
    df = spark.createDataFrame([(y, n, n, n, n, n), (y, n, n, y, n, n), (n, n, n, y, n, n), (n, n, n, y, n, n), (n,) * 6], flags)
    row = quality.noisy_union(df).collect()[0]
    assert (row.noisy_union_count, row.noisy_union_legacy) == (4, 3)


def test_speed_and_standing_runs(spark):
    s = Series(keys=("fzg_id",), time="tst_iso", slice_length=5)
    at = [0, 4, 8, 8, 12, 16, 20, 24, 28]
    distance = [100, 120, 115, 130, 130, None, 130, 150, 0]
    data = [(1, ts(f"2025-07-28T05:00:{a:02d}"), i, d) for i, (a, d) in enumerate(zip(at, distance))]
    pings = spark.createDataFrame(data, "fzg_id int, tst_iso timestamp, id int, distanz int")
    s = Series(keys=("fzg_id",), time="tst_iso", ties=("id",), slice_length=5)
    speeds = motion.odometer_speed(motion.with_steps(pings, s)).orderBy("id").collect()
    assert [r.speed_ms for r in speeds] == [None, 5.0, None, None, 0.0, None, None, 5.0, -1.0]
    rows = [(1, ts(f"2025-07-28T05:00:{i:02d}"), i, d) for i, d in enumerate([0, 0, 0, None, 0, 0, 3, 3])]
    pings = spark.createDataFrame(rows, "fzg_id int, tst_iso timestamp, id int, distanz int")
    runs = motion.stationary_runs(pings, series=s).collect()
    assert sorted((r.n_rows, r.duration_sec) for r in runs) == [(1, 1), (3, 3)]


def test_split_and_fixed_dwell(spark):
    sizes = {1: 12, 2: 12, 3: 12, 4: 12, 5: 5}
    data = [(date(2025, 7, d), d % 2 if d < 4 else 8, float(d)) for d, n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame(data, "service_date date, linie int, dwell_time double")
    split = ablation.temporal_split(df, min_rows=10)
    got = {r.service_date.day: r.split for r in split.select("service_date", "split").distinct().collect()}
    assert got == {1: "train", 2: "valid", 3: "valid", 4: "test", 5: "train"}
    # training: day 1 (line 1, dwell 1) and day 5 (line 8, dwell 5); line 0 is unseen
    fixed = {(r.service_date.day, r.dwell_time) for r in ablation.fixed_dwell(split).collect()}
    assert fixed == {(1, 1.0), (2, 1.0), (3, 1.0), (4, 5.0), (5, 5.0)}
    by_train = {(r.service_date.day, round(r.dwell_time, 6)) for r in ablation.fixed_dwell(split, "train").collect()}
    assert (2, round((12 * 1 + 5 * 5) / 17, 6)) in by_train


def test_feature_matrix_policies(spark):
    columns = "fzg_id int, drop_row_idx int, fahrt_id int, arrival_time timestamp, stop_index int, dwell_time double, travel_time double, stop_status string, delay_calculated_sec double, besetztgrad int, linie int, ort_nr_start int"
    rows = [
        (1, 1, 1, ts("2025-07-28T21:50:00"), 1, 500.0, 5.0, "normal", 0.0, 1, 7, 1),
        (1, 2, 1, ts("2025-07-28T21:55:00"), 2, -1.0, 900.0, "no_door", 0.0, 1, 7, 2),
        (1, 3, 1, ts("2025-07-28T21:58:00"), 3, 20.0, 50.0, "multi_door", 0.0, 1, 7, 3),
        (1, 4, 1, ts("2025-07-28T22:05:00"), 4, 20.0, 50.0, "normal", 0.0, 1, 7, 4),  # next local day
    ]
    core = features.add_binary_features(spark.createDataFrame(rows, columns))
    filled = {r.stop_index: r for r in features.feature_matrix(core).collect()}
    assert {i: (r.dwell_time, r.target, r.stop_status) for i, r in filled.items()} == {1: (120.0, 600.0, 0), 2: (40.0, 50.0, 2)}
    assert (filled[1].hour_of_day, filled[1].day_of_week) == (23, 1)
    dropped = {r.stop_index: r.target for r in features.feature_matrix(core, no_door="drop").collect()}
    assert dropped == {1: 50.0}


def test_event_context_reaches_over_slices(spark):
    pings = spark.createDataFrame([(1, i) for i in range(10)], "fzg_id int, row_idx bigint")
    events = spark.createDataFrame([(1, 0), (1, 5)], "fzg_id int, drop_row_idx bigint")
    got = sorted((r.drop_row_idx, r.offset) for r in diagnostics.event_context(events, pings, 2).collect())
    assert got == [(0, 0), (0, 1), (0, 2), (5, -2), (5, -1), (5, 0), (5, 1), (5, 2)]


def test_core_plan_stays_on_the_engine(spark):
    t = Tables(spark, SMALL)
    core = core_plan.core_table(t.telemetry, t.raw_timetable, ping_series=t.pings, arrival_series=t.arrivals)
    plan = core._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_entry_points_agree(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[:2] == ["fzg_id", "drop_row_idx"]
    assert set(entry.oracle_sql()) < set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark):
    t = Tables(spark, SMALL)
    plan = t.events.filter("user_id = 7 and value > 10").select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(user_id), IsNotNull(value), EqualTo(user_id,7), GreaterThan(value,10.0)]" in plan
    assert "props" not in plan


def test_core_variants_and_invariants(spark, tmp_path):
    t = Tables(spark, SMALL)
    core = core_plan.core_table(t.telemetry, t.raw_timetable, ping_series=t.pings, arrival_series=t.arrivals)
    core_plan.write_core(core, str(tmp_path / "core"))
    back = spark.read.parquet(str(tmp_path / "core"))
    assert back.groupBy("fzg_id", "fahrt_id", "ort_nr_start", "service_date").count().filter("count > 1").count() == 0
    assert back.filter("(stop_status = 'no_door') <> (dwell_time = -1)").count() == 0
    changed = core_plan.core_table(
        t.telemetry, t.raw_timetable, ping_series=t.pings, arrival_series=t.arrivals, stop_signal="ort_nr_start"
    )
    assert 0 < changed.count() <= back.count()


def test_summaries_are_one_document(spark, tmp_path):
    t = Tables(spark, SMALL)
    summary = quality.noisy_summary(t.telemetry, series=t.trips)
    files.write_summary_json(summary, str(tmp_path / "noise"))
    row = spark.read.json(str(tmp_path / "noise")).collect()
    assert len(row) == 1 and row[0].total_rows == 1000 and len(row[0].noisy_by_line) == 13
