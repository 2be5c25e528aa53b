"""The timetable built from the feed is spread over tasks by its trips, not by the bytes of their ids."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from haltwerk.operators import timetable
from haltwerk.plans.catalog import QUERIES
from haltwerk.sources import driver_tables
from haltwerk.sources.driver_tables import Tables

USERS = 300


@pytest.fixture
def folder(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(days=k % 29), k % USERS, "view", float(k), '{"k": %d}' % (k % 40)) for k in range(2 * USERS)] + [(9999, start, None, "view", 1.0, '{"k": 1}')]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_no_task_gets_more_trips_than_its_share(spark, folder, monkeypatch):
    monkeypatch.setattr(driver_tables, "TRIPS_PER_TASK", 20, raising=False)
    t = Tables(spark, folder)
    listed = timetable.planned_route(timetable.expand_timetable(t.raw_timetable, inclusive=False))
    in_task = [r["count"] for r in listed.groupBy(F.spark_partition_id()).count().collect()]
    trips = t.telemetry.select("fahrt_id").distinct().count()
    assert sum(in_task) > 80 * trips * 0.8 and max(in_task) < 80 * 60  # hashing deals unevenly


def test_the_planned_route_starts_at_zero(spark, folder):
    rows = QUERIES["planned_route"].run(spark, folder).collect()
    kept = {r.fahrt_id for r in rows if r.fahrt_id is not None}
    assert kept and all(k % 17 for k in kept)
    assert sorted(r.offset_sec for r in rows if r.fahrt_id == min(kept) and r.stop_name.endswith(" 1")) == [10800 * i for i in range(80)]
