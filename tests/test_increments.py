"""Runs over parts of the feed, and a store that needs no exchange."""

import random
import re
import uuid

import pytest
from test_detect import frame, random_vehicle, series

from haltwerk.functions.ordered import Series, spread_hot
from haltwerk.operators import detect, increments, rescue
from haltwerk.session import checkpoint_folder, delete_at_exit, temporary_table
from haltwerk.sources import files

COLUMNS = [*detect.EVENT_COLUMNS, "rescan_open", "rescan_close", "late_close"]


def rows(df):
    return sorted((tuple(r) for r in df.select("fzg_id", *COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("seed, cuts", [(1, [300]), (2, [40, 41, 400]), (3, [0, 899])])
def test_runs_over_parts_give_the_events_of_the_whole(spark, seed, cuts):
    rng = random.Random(seed)
    vehicles = {v: random_vehicle(rng, 900 if v == 0 else rng.choice([1, 2, 40, 90]), (1, 5, 10)) for v in range(6)}
    numbered = [(v, i, r) for v, rs in vehicles.items() for i, r in enumerate(rs)]
    whole = frame(spark, vehicles)
    want = rows(detect.detect_stop_events(whole, n_min=4, n_max=4, n_default=4, series=series(60), keep_rescan=True))
    state, found, last = None, [], None
    edges = [0, *cuts, 10_000]
    for a, b in zip(edges, edges[1:]):
        part = whole.filter(f"ping_id >= {a} AND ping_id < {b}")
        last = increments.increment_events(part, state, 4, series=series(60), keep_rescan=True)
        found += rows(last.filter("is_final"))
        carried = increments.next_state(part, state, series=series(60))
        state = temporary_table(carried, "test-state")
    open_ = rows(last.filter("NOT coalesce(is_final, false)"))
    assert sorted(found + open_, key=repr) == want and len(numbered) == whole.count()
    # what is carried on are two stops a vehicle, not the history
    assert state.filter("fzg_id = 0").count() < 120
    assert state.groupBy("fzg_id").count().count() == 6


def test_a_run_without_new_pings(spark):
    vehicles = {1: random_vehicle(random.Random(4), 80), 2: []}
    part = frame(spark, vehicles)
    state = temporary_table(increments.next_state(part, None, series=series(60)), "test-state")
    again = increments.increment_events(part.where("false"), state, 4, series=series(60))
    first = increments.increment_events(part, None, 4, series=series(60))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.filter("NOT is_final").collect()))
    assert increments.next_state(part.where("false"), state, series=series(60)).count() == state.count()


def test_clustered_store_is_read_without_an_exchange(spark):
    vehicles = {v: random_vehicle(random.Random(v), 60) for v in range(12)}
    pings = frame(spark, vehicles)
    path = delete_at_exit(spark, f"{checkpoint_folder(spark)}/test-clustered-{uuid.uuid4().hex}")
    name = f"test_pings_{uuid.uuid4().hex}"
    store = files.write_clustered(pings, name, path, ["fzg_id"], ["tst_iso", "ping_id"], buckets=3)
    plain = spread_hot(pings, Series(keys=("fzg_id",), time="tst_iso", ties=("ping_id",)))
    indexed = detect.index_pings(store, plain)
    marked = detect.mark_drops(store, series=plain)
    for df in (indexed, marked):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange (hash|range)partitioning", plan)
    assert rows(detect.detect_stop_events(store, series=plain, keep_rescan=True)) == rows(detect.detect_stop_events(pings, series=plain, keep_rescan=True))
    assert rescue.last_rows(store).count() == 12
    assert files.write_clustered(pings, name + "_b", path + "-b", ["fzg_id"], ["tst_iso"], rows_per_bucket=100).count() == 720
    delete_at_exit(spark, path + "-b")
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"DROP TABLE {name}_b")
