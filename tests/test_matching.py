"""Nearest match by merge against the plain rule and the list form."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from haltwerk.operators import matching

START = datetime(2025, 3, 1)
KEYS = ("fahrt_id", "ort_nr_start")


def tables(spark, seed):
    draw = random.Random(seed)
    moment = lambda: START + timedelta(seconds=draw.randrange(400))
    # one trip and stop holds most rows
    key = lambda: (1, 1) if draw.random() < 0.7 else (draw.randrange(3), draw.randrange(3))
    calls = [(*key(), draw.randrange(5), moment()) for _ in range(150)] + [(1, 1, 0, None), (None, 1, 0, START), (8, 8, 3, START)]
    events = [(k, *key(), moment(), "x") for k in range(200)]
    events += [(900, 1, 1, None, "x"), (901, None, 1, START, "x"), (902, 7, 7, START, "x"), (903, 1, 1, events[0][3], "x"), (903, 1, 1, events[0][3], "x")]
    timetable = spark.createDataFrame(calls, "fahrt_id long, ort_nr long, stop_index long, scheduled_arrival_time timestamp")
    return calls, events, spark.createDataFrame(events, "n long, fahrt_id long, ort_nr_start long, arrival_time timestamp, stop_index string"), timetable


def plain(calls, events):
    out = []
    for n, trip, stop, at, _ in events:
        own = [(abs(at - t), i, t) for a, b, i, t in calls if (a, b) == (trip, stop) and t is not None] if at and trip is not None else []
        best = min(own) if own else (None, None, None)
        count = sum((a, b) == (trip, stop) and t is not None for a, b, _, t in calls) if trip is not None else 0
        out.append((n, best[2], best[1], count))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows_per_slice", [20, 2_000_000])
def test_merge_equals_the_plain_rule(spark, rows_per_slice):
    calls, events, asked, timetable = tables(spark, 3)
    found = matching.nearest_by_merge(asked, timetable, KEYS, rows_per_slice=rows_per_slice)
    got = sorted(((r.n, r.scheduled_arrival_time, r.stop_index, r.n_candidates) for r in found.collect()), key=str)
    assert got == plain(calls, events)


def test_merge_equals_the_list_form(spark):
    _, _, asked, timetable = tables(spark, 4)
    asked = asked.drop("stop_index").where("arrival_time IS NOT NULL")
    dated = matching.match_nearest(asked, timetable.dropna(), cutoff_hours=0)  # all on one day
    merged = matching.match_nearest(asked, timetable, KEYS, cutoff_hours=0)
    columns = ["n", "service_date", "scheduled_arrival_time", "stop_index", "n_candidates"]
    assert sorted(map(tuple, dated.select(columns).collect())) == sorted(map(tuple, merged.select(columns).collect()))


def test_merge_has_no_list_and_takes_empty_sides(spark):
    _, _, asked, timetable = tables(spark, 5)
    found = matching.nearest_by_merge(asked, timetable, KEYS)
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()
    assert matching.nearest_by_merge(asked, timetable.where("false"), KEYS).where(F.col("stop_index").isNotNull()).count() == 0
    assert matching.nearest_by_merge(asked.where("false"), timetable, KEYS).collect() == []


def test_merge_is_dealt_by_rows_and_never_sorts_calls_to_count_them(spark):
    calls = [(trip, stop, i, START + timedelta(seconds=i // 2)) for trip in range(20) for stop in range(3) for i in range(20)]
    calls += [(1, 1, None, START)]
    timetable = spark.createDataFrame(calls, "fahrt_id long, ort_nr long, stop_index long, scheduled_arrival_time timestamp")
    asked = spark.createDataFrame([(1, 1, START), (2, 1, START)], "fahrt_id long, ort_nr_start long, arrival_time timestamp")
    found = matching.nearest_by_merge(asked, timetable, KEYS, task_rows=200)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("REPARTITION_BY_NUM") == 1 and ", 7)" in plan  # 1203 rows
    assert sorted((r.fahrt_id, r.stop_index, r.n_candidates) for r in found.collect()) == [(1, None, 21), (2, 0, 20)]


@pytest.mark.parametrize("rows_per_slice", [15, 200_000])
def test_range_lookup_in_slices(spark, rows_per_slice):
    from haltwerk.operators import enrich

    draw = random.Random(8)
    ranges = [(f"r{k}", a := draw.randrange(-20, 60), a + draw.choice([0, 3, 30])) for k in range(25)] + [("none", 5, 4), ("far", 2**50, 2**50 + 2), ("null", None, 3)]
    points = [(k, draw.choice([7, 7, 7, draw.randrange(-40, 100), None, 2**50 + 1])) for k in range(200)] + [(7, 7), (7, 7)]
    df = spark.createDataFrame(points, "id int, k bigint")
    table = spark.createDataFrame(ranges, "name string, lo bigint, hi bigint")
    held = lambda k, a, b: k is not None and a is not None and a <= k <= b
    inner = sorted((i, n) for i, k in points for n, a, b in ranges if held(k, a, b))
    outer = sorted(inner + [(i, None) for i, k in points if not any(held(k, a, b) for _, a, b in ranges)], key=str)
    assert sorted((r.id, r.name) for r in enrich.range_lookup(df, "k", table, "lo", "hi", "inner", rows_per_slice).collect()) == inner
    found = enrich.range_lookup(df, "k", table, "lo", "hi", "left", rows_per_slice)
    assert sorted(((r.id, r.name) for r in found.collect()), key=str) == outer and found.columns == ["id", "k", "name", "lo", "hi"]
    assert enrich.range_lookup(df, "k", table.where("false"), "lo", "hi").count() == len(points)


def test_hexagons_are_nearest_centres(spark):
    from haltwerk.functions import stats

    draw = random.Random(9)
    points = [(draw.uniform(-1, 11), draw.uniform(-1, 6)) for _ in range(400)] + [(None, 1.0), (0.0, 0.0), (10.0, 5.0)]
    df = spark.createDataFrame(points, "x double, y double")
    cells = stats.hex_grid(df, "x", "y", (0.0, 10.0), (0.0, 5.0), 9).collect()
    inside = [(x, y) for x, y in points if x is not None and 0 <= x <= 10 and 0 <= y <= 5]
    assert sum(c["count"] for c in cells) == len(inside)
    wide, high, counts = 10 / 9, 5 / 5, {}
    centres = [((i + o) * wide, (j + o) * high) for o in (0, 0.5) for i in range(-1, 11) for j in range(-1, 8)]
    for x, y in inside:
        best = min(centres, key=lambda c: ((x - c[0]) / wide) ** 2 + 3 * ((y - c[1]) / high) ** 2)
        counts[round(best[0], 6), round(best[1], 6)] = counts.get((round(best[0], 6), round(best[1], 6)), 0) + 1
    assert {(round(c.x, 6), round(c.y, 6)): c["count"] for c in cells} == counts


def test_lists_of_calls_are_never_broadcast(spark):
    trips = spark.createDataFrame([(k,) for k in range(50)], "fahrt_id long").repartition(4, "fahrt_id")
    calls = trips.selectExpr("fahrt_id", "posexplode(transform(sequence(0, 199), i -> i % 4)) AS (stop_index, ort_nr)")
    timetable = calls.selectExpr("fahrt_id", "ort_nr", "cast(stop_index AS long) AS stop_index", "timestamp'2025-03-01 12:00:00' + make_interval(0, 0, 0, 0, 0, 0, stop_index) AS scheduled_arrival_time")
    rows = [(k, k % 60 if k % 7 else None, k % 5, START + timedelta(hours=12, seconds=k)) for k in range(200)]
    asked = spark.createDataFrame(rows, "n long, fahrt_id long, ort_nr_start long, arrival_time timestamp")
    found = matching.match_nearest(asked, timetable)
    got = {r.n: (r.stop_index, r.n_candidates) for r in found.collect()}

    def expected(n, trip, stop):
        own = [(abs(i - n), i) for i in range(200) if i % 4 == stop] if trip is not None and trip < 50 else []
        return (min(own)[1] if own else None, len(own))

    assert got == {n: expected(n, trip, stop) for n, trip, stop, _ in rows}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
