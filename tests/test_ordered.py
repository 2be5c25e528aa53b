"""Sliced windows and ranks equal their plain counterparts, also with a hot key."""

import random
from datetime import datetime, timedelta

import checker
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from haltwerk.functions import ranks, stats
from haltwerk.functions.ordered import Series, neighbours, running, sliced, spread_hot


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for i in range(3000):
        key = rng.choice([0, 0, 0, 1, 2, 3, None])
        moment = datetime(2025, 1, 1) + timedelta(seconds=rng.choice([rng.randint(0, 90_000), rng.randint(0, 300)]))
        data.append((key, moment, i, rng.choice([None, rng.randint(-5, 5)])))
    return spark.createDataFrame(data, "k bigint, t timestamp, id bigint, v bigint").repartition(7)


def cut(rows, length):
    """A fixed length, or only keys with more rows than given."""
    s = Series(keys=("k",), time="t", ties=("id",), slice_length=abs(length))
    return s if length > 0 else spread_hot(rows, s, rows_per_slice=-length)


@pytest.mark.parametrize("length", [1, 60, 3600, 10**7, -5, -500, -10**6])
def test_neighbours_equal_plain_window(rows, length):
    s = cut(rows, length)
    got = neighbours(rows, s, lag={"a": "v"}, lead={"b": "v"}, index="i")
    w = Window.partitionBy("k").orderBy("t", "id")
    plain = rows.select(
        "*", (F.row_number().over(w) - 1).cast("bigint").alias("i"), F.lag("v").over(w).alias("a"), F.lead("v").over(w).alias("b")
    )
    columns = ["k", "id", "i", "a", "b"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, plain.select(columns).collect()))


@pytest.mark.parametrize("length", [1, 600, 10**7, -5, -500, -10**6])
def test_running_equals_plain_window(rows, length):
    s = cut(rows, length)
    w = Window.partitionBy("k").orderBy("t", "id")
    numbered = rows.withColumn("i", F.row_number().over(w))
    mark = F.when(F.col("v") > 3, F.col("i"))
    got = running(numbered, s, sums={"total": F.col("v")}, latest={"prev": mark}, upcoming={"next": mark})
    forward = w.rowsBetween(Window.unboundedPreceding, -1)
    plain = numbered.select(
        "*",
        F.coalesce(F.sum("v").over(w), F.lit(0)).alias("total"),
        F.last(mark, ignorenulls=True).over(forward).alias("prev"),
        F.first(mark, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("next"),
    )
    columns = ["k", "id", "total", "prev", "next"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, plain.select(columns).collect()))


def test_hot_key_is_spread_over_tasks(spark):
    """One key with most rows must not end in one task."""
    pings = spark.range(20_000).select(
        F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 97).alias("k"),
        F.timestamp_seconds(F.col("id")).alias("t"),
        "id",
    )
    s = spread_hot(pings, Series(keys=("k",), time="t", ties=("id",)), rows_per_slice=200)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [
            r["count"]
            for r in neighbours(pings, s, index="i").groupBy(F.spark_partition_id().alias("p")).count().collect()
        ]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 4 and max(sizes) < 8_000


def test_slices_hold_rows_not_time(spark):
    """A wrong clock, a burst at one instant and missing times leave no large slice."""
    n = F.col("id")
    moment = (
        F.when(n == 0, F.timestamp_seconds(F.lit(0)))
        .when(n % 4 == 1, F.timestamp_seconds(F.lit(1_700_000_000)))
        .when(n % 8 == 2, F.lit(None).cast("timestamp"))
        .otherwise(F.timestamp_seconds(F.lit(1_750_000_000) + n / 100))
    )
    rows = spark.range(40_000).select(F.lit(1).alias("k"), moment.alias("t"), "id")
    s = spread_hot(rows, Series(keys=("k",), time="t", ties=("id",)), rows_per_slice=1000)
    sizes = [r["count"] for r in sliced(rows, s).groupBy("_slice").count().collect()]
    assert len(sizes) > 40 and max(sizes) <= 2000
    got = neighbours(rows, s, index="i", lag={"a": "id"})
    w = Window.partitionBy("k").orderBy("t", "id")
    plain = rows.select("id", (F.row_number().over(w) - 1).cast("bigint").alias("i"), F.lag("id").over(w).alias("a"))
    assert got.select("id", "i", "a").exceptAll(plain).isEmpty()


@pytest.mark.parametrize("length", [60, -2, -10**6])
def test_missing_key_is_no_value(spark, length):
    first = datetime(2025, 1, 1)
    rows = spark.createDataFrame([(None, first + timedelta(seconds=i), i) for i in range(5)] + [(-2147483647, first, 9), (-2147483648, first, 8)], "k int, t timestamp, id bigint")
    got = {r.id: (r.i, r.a) for r in neighbours(rows, cut(rows, length), index="i", lag={"a": "id"}).collect()}
    assert got[9] == (0, None) and got[8] == (0, None) and [got[i][0] for i in range(5)] == list(range(5))


def test_quantiles_are_exact(spark):
    rng = random.Random(3)
    values = [rng.choice([0.0, 0.0, -1.5, rng.gauss(0, 1), rng.gauss(0, 1e5), 1e-9 * rng.random()]) for _ in range(2500)]
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(values)] + [(None, 0)], "v double, g int")
    qs = [0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {r.q: r.value for r in ranks.quantiles(df, "v", qs).collect()}
    for q in qs:
        assert got[q] == pytest.approx(checker.quantile(values, q), rel=1e-12, abs=1e-15)
    nearest = {r.q: r.value for r in ranks.quantiles(df, "v", qs, method="nearest").collect()}
    for q in qs:
        assert nearest[q] == sorted(values)[int(q * (len(values) - 1) + 0.5)]
    grouped = {(r.g, r.q): r.value for r in ranks.quantiles(df, "v", [0.5], ["g"]).collect()}
    for g in range(3):
        assert grouped[g, 0.5] == pytest.approx(checker.quantile(values[g::3], 0.5), rel=1e-12, abs=1e-15)


def test_quantiles_of_a_missing_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    got = {r.g: r.value for r in ranks.quantiles(df, "v", [0.5], ["g"]).collect()}
    assert got == {None: 2.0, "a": 5.0}


def test_ecdf_and_spearman_with_ties(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0), (2.0, 3.0), (4.0, 3.0), (4.0, 9.0)], "x double, y double")
    assert {r.value: r.cdf for r in ranks.ecdf(df, "x").collect()} == {1.0: 0.4, 2.0: 0.6, 4.0: 1.0}
    # average ranks x: 1.5 1.5 3 4.5 4.5, y: 2 1 3.5 3.5 5
    rx, ry = [1.5, 1.5, 3, 4.5, 4.5], [2, 1, 3.5, 3.5, 5]
    mx, my = sum(rx) / 5, sum(ry) / 5
    top = sum((a - mx) * (b - my) for a, b in zip(rx, ry))
    want = top / (sum((a - mx) ** 2 for a in rx) * sum((b - my) ** 2 for b in ry)) ** 0.5
    assert ranks.spearman(df, "x", "y").collect()[0].spearman == pytest.approx(want)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.999,), (1.0,), (10.0,), (-0.1,), (10.1,), (None,)], "v double")
    assert {r.bin: r["count"] for r in stats.histogram(df, "v", 0, 10, 10).collect()} == {0: 2, 1: 1, 9: 1}
    log = {r.bin: r["count"] for r in stats.histogram(df, "v", 0.1, 100, 3, scale="log").collect()}
    assert sum(log.values()) == 4
