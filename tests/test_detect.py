"""Detection and repair against hand-worked cases and the row-by-row checker."""

import random
from datetime import datetime, timedelta, timezone

import checker
import pytest
from pyspark.sql import functions as F

from haltwerk.functions.ordered import Series, spread_hot
from haltwerk.operators import detect, rescue

START = datetime(2025, 7, 28, 5, 0, tzinfo=timezone.utc)
SCHEMA = "fzg_id bigint, tst_iso timestamp, distanz double, tuerkriterium boolean, linie bigint, fahrt_id bigint, ping_id bigint"


def series(length):
    return Series(keys=("fzg_id",), time="tst_iso", ties=("ping_id",), slice_length=length)


def rows_of(distances, doors, trips=None, start=START, gap=10):
    trips = trips or [1] * len(distances)
    return [
        {"ts": start + timedelta(seconds=gap * i), "distanz": d, "door": o, "trip": t}
        for i, (d, o, t) in enumerate(zip(distances, doors, trips))
    ]


def frame(spark, vehicles):
    data = [
        (v, r["ts"], float(r["distanz"]), r["door"], 7, r["trip"], i) for v, rows in vehicles.items() for i, r in enumerate(rows)
    ]
    random.Random(1).shuffle(data)
    return spark.createDataFrame(data, SCHEMA)


def run(spark, rows, length=60, n=None):
    pings = frame(spark, {1: rows})
    limits = {"n_min": n, "n_max": n, "n_default": n} if n else {}
    return detect.detect_stop_events(pings, series=series(length), **limits)


T, N = True, False


def test_plain_stop(spark):
    rows = rows_of([0, 200, 400, 410, 10, 12, 200], [N, N, N, T, T, N, N])
    e = run(spark, rows).collect()[0]
    assert (e.stop_status, e.door_open_count, e.door_close_count) == ("normal", 1, 1)
    assert e.arrival_time.replace(tzinfo=timezone.utc) == rows[3]["ts"]
    assert e.departure_time.replace(tzinfo=timezone.utc) == rows[5]["ts"]
    assert (e.drop_row_idx, e.window_lo, e.window_hi) == (4, 0, 6)


def test_threshold_is_strict(spark):
    assert run(spark, rows_of([0, 100, 0, 5], [N] * 4)).count() == 0
    assert run(spark, rows_of([0, 101, 0, 5], [N] * 4)).count() == 1


def test_no_drops_gives_default_size(spark):
    pings = frame(spark, {1: rows_of([0, 10, 20], [N] * 3)})
    assert detect.window_size(detect.row_intervals(pings, series=series(60))).collect()[0].n == 5


def test_adjacent_drops_clip_each_other(spark):
    rows = rows_of([0, 300, 500, 350, 200, 90, 100, 120], [N] * 8)
    got = {e.drop_row_idx: (e.window_lo, e.window_hi) for e in run(spark, rows, n=3).collect()}
    assert got == {3: (0, 3), 4: (4, 4), 5: (5, 7)}


def test_opening_into_lower_edge_is_not_counted(spark):
    # n = 3: the window of row 5 starts at row 2, where the door opens
    rows = rows_of([0, 100, 200, 300, 400, 5, 6, 7, 8], [N, N, T, T, T, N, N, N, N])
    e = run(spark, rows, n=3).collect()[0]
    assert (e.door_open_count, e.door_close_count, e.stop_status) == (0, 1, "normal")


@pytest.mark.parametrize(
    "distances, trips, status",
    [
        ([300, 310, 0, 5, 10, 20, 60], [1] * 7, "multi_door"),
        ([300, 310, 0, 5, 105, 105, 110], [1] * 7, "normal"),  # growth of exactly 100
        ([300, 310, 0, 60, 29, 30, 40], [1] * 7, "normal"),  # step of -31
        ([300, 310, 0, 60, 30, 30, 40], [1] * 7, "multi_door"),  # step of -30
        ([300, 310, 0, 5, 10, 20, 60], [1, 1, 1, 2, 2, 2, 2], "normal"),  # trip handover
        ([300, 310, 0, 5, 10, 20, 60], [1, 1, None, 1, 1, 1, 1], "normal"),  # a missing trip is another trip
        ([300, 310, 0, 5, 10, 20, 60], [None] * 7, "multi_door"),
    ],
)
def test_multi_door(spark, distances, trips, status):
    rows = rows_of(distances, [N, N, N, T, N, T, N], trips)
    assert [e.stop_status for e in run(spark, rows, n=5).collect()] == [status]


def test_missing_door_reading_breaks_a_turn(spark):
    rows = rows_of([300, 310, 0, 5, 10, 20], [N, None, T, T, N, N])
    e = run(spark, rows, n=3).collect()[0]
    assert (e.door_open_count, e.door_close_count, e.stop_status) == (0, 1, "normal")


def test_rescue_cases(spark):
    # case 1: opens inside the window, closes later
    rows = rows_of([300, 310, 0, 1, 2, 3, 4, 5, 6, 7], [N, N, T, T, T, T, T, T, N, N])
    rows[2]["door"], rows[3]["door"] = N, T
    out = rescue.rescue_dwell_times(run(spark, rows, n=3), frame(spark, {1: rows}), series=series(60)).collect()[0]
    assert out.departure_time.replace(tzinfo=timezone.utc) == rows[8]["ts"]
    # case 2: the door stands open at the drop and never turns
    rows = rows_of([300, 310, 0, 1, 2], [T] * 5)
    out = rescue.rescue_dwell_times(run(spark, rows, n=3), frame(spark, {1: rows}), series=series(60)).collect()[0]
    assert (out.stop_status, out.arrival_time, out.departure_time) == ("no_door", out.drop_time, out.drop_time)


def test_closed_door_after_the_arrivals_instant(spark):
    """Two pings share the arrival's instant, the second one closed: the closed door after them is the closing."""
    rows = rows_of([300, 310, 0, 1, 2, 3, 4, 5], [N, N, N, T, N, N, N, N])
    rows[4]["ts"] = rows[3]["ts"]
    pings = frame(spark, {1: rows})
    found = detect.detect_stop_events(pings, series=series(60), n_min=3, n_max=3, n_default=3, keep_rescan=True)
    for events in (found, found.drop("rescan_open", "rescan_close", "late_close")):
        out = rescue.rescue_dwell_times(events, pings, series=series(60)).collect()[0]
        assert out.arrival_time.replace(tzinfo=timezone.utc) == rows[3]["ts"]
        assert out.departure_time.replace(tzinfo=timezone.utc) == rows[5]["ts"]


def random_vehicle(rng, size, pauses=(1, 5, 10, 120)):
    rows, distance, moment, door, trip = [], 0.0, START, False, 1
    for _ in range(size):
        roll = rng.random()
        if roll < 0.16:
            distance = float(rng.randint(0, 40))
        elif roll < 0.24:
            distance = max(0.0, distance - rng.randint(1, 60))
        else:
            distance += rng.choice([0, 0, 5, 40, 90, 160])
        if rng.random() < 0.35:
            door = rng.choice([True, False, False, None]) if rng.random() < 0.15 else not door
        if rng.random() < 0.04:
            trip += 1
        moment += timedelta(seconds=rng.choice(pauses))
        rows.append({"ts": moment, "distanz": distance, "door": door, "trip": trip if rng.random() > 0.01 else None})
    return rows


@pytest.mark.parametrize("seed, length", [(1, 30), (2, 100_000), (3, -40), (4, -10_000)])
@pytest.mark.parametrize("pauses", [(1, 5, 10, 120), (0, 0, 0, 5, 60)])
def test_equals_checker_on_random_series(spark, seed, length, pauses):
    """One vehicle holds most rows; how it is cut must not matter (below 0: hot keys only), nor how many pings share an instant."""
    rng = random.Random(seed)
    vehicles = {v: random_vehicle(rng, 900 if v == 0 else rng.choice([1, 2, 40, 90]), pauses) for v in range(8)}
    pings = frame(spark, vehicles)
    n = checker.window_size(vehicles.values())
    expected = {}
    for v, rows in vehicles.items():
        events = checker.detect(rows, n)
        for before, after in zip(events, checker.rescue(rows, events)):
            expected[v, before["row"]] = (before, after)
    cut = series(length) if length > 0 else spread_hot(pings, series(1), rows_per_slice=-length)
    found = detect.detect_stop_events(pings, series=cut, keep_rescan=True)
    fixed = rescue.rescue_dwell_times(found, series=cut)
    again = rescue.rescue_dwell_times(found.drop("rescan_open", "rescan_close", "late_close"), pings, series=cut)
    got = {(e.fzg_id, e.drop_row_idx): e for e in found.collect()}
    assert set(got) == set(expected)

    def utc(x):
        return x.replace(tzinfo=timezone.utc)

    for key, e in got.items():
        want = expected[key][0]
        seen = (e.window_lo, e.window_hi, e.door_open_count, e.door_close_count, e.door_near_drop, e.is_true_multi_door)
        assert seen == (want["lo"], want["hi"], want["opens"], want["closes"], want["near"], want["multi"]), key
        assert (utc(e.arrival_time), utc(e.departure_time), e.stop_status) == (
            want["arrival"], want["departure"], want["status"],
        )
        assert e.window_lo <= e.drop_row_idx <= e.window_hi
    for result in (fixed, again):
        for e in result.collect():
            want = expected[e.fzg_id, e.drop_row_idx][1]
            assert (utc(e.arrival_time), utc(e.departure_time), e.stop_status) == (
                want["arrival"], want["departure"], want["status"],
            ), (e.fzg_id, e.drop_row_idx)


def test_window_size_with_long_gaps(spark):
    """Intervals beyond the cap give the same size."""
    for gaps in ([7, 1000], [7, 7, 1000], [39, 41, 90], [1, 2, 3], [12, 14]):
        intervals = spark.createDataFrame([(g,) for g in gaps], "rows_between bigint")
        got = detect.window_size(intervals).collect()[0].n
        plain = sorted(gaps)
        mid = len(plain) // 2
        median = plain[mid] if len(plain) % 2 else (plain[mid - 1] + plain[mid]) / 2
        assert got == int(min(10, max(3, median / 2)))


def test_stop_change_filter(spark):
    rows = rows_of([300, 310, 0, 1, 200, 0], [N] * 6)
    pings = frame(spark, {1: rows}).withColumn("ort_nr_ziel", F.lit(9)).withColumn(
        "ort_nr_start", F.when(F.col("distanz") == 310, 1).otherwise(2)
    )
    events = detect.detect_stop_events(pings, series=series(30), n_min=3, n_max=3, n_default=3)
    kept = detect.filter_stop_changed(events, pings, series=series(30)).collect()
    assert [(e.drop_row_idx, e.ort_nr_end) for e in kept] == [(2, 9)]
