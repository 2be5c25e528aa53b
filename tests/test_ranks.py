"""Order keys and exact ranks on values that crowd into few leading bits."""

import bisect
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from haltwerk.functions import ranks


def test_keys_are_the_bits_of_the_double(spark):
    draw = random.Random(1)
    values = [struct.unpack("<d", struct.pack("<Q", draw.getrandbits(64)))[0] for _ in range(2000)]
    values += [s * 2.0**k * m for s in (1, -1) for k in range(-1022, 1024, 7) for m in (1, 1 - 2**-53)]
    values += [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, math.inf, -math.inf, 1.7976931348623157e308]
    values = [v for v in values if v == v]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", ranks.order_key(F.col("v")).alias("k"))
    for v, k in df.collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
        assert k == (-bits if v < 0 else bits)
    assert spark.range(1).select(ranks.order_key(F.lit(float("nan")))).first()[0] > (2047 << 52)


# timestamps far from zero, one dense range, mixed signs with an outlier, few values many times
COLUMNS = {
    "microseconds": "1700000000000000.0 + id * 1000 + id % 7",
    "dense": "1.0 + id / 1e12",
    "signs": "CASE WHEN id = 5 THEN 1e300 ELSE (id - 10000) * (id % 13) END",
    "few": "double(id % 3)",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_full_buckets_are_refined(spark, monkeypatch, name):
    monkeypatch.setattr(ranks, "LIMIT", 500)
    df = spark.range(20_000).selectExpr(f"double({COLUMNS[name]}) AS v", "id % 2 AS g")
    values = sorted(r.v for r in df.collect())
    counts = ranks.value_counts(df, "v")
    keyed = ranks._keyed(counts)
    buckets = ranks._buckets(keyed, ())
    sizes = [level.count() for _, level in buckets]
    held = [r[0] for shift, level in buckets for r in keyed.withColumn("_p", F.shiftright("_key", shift)).join(level, "_p").groupBy("_p").count().select("count").collect()]
    assert sum(held) == len(set(values)) and max(held) <= 500
    if name in ("microseconds", "dense"):
        assert sum(sizes) >= 40  # spread over many windows
    for r in ranks.ranked_values(counts).collect():
        assert r.below == bisect.bisect_left(values, r.value) and r.n == 20_000
    qs = [0.0, 0.013, 0.5, 0.77, 1.0]
    for row in ranks.quantiles(df, "v", qs).collect():
        at = row.q * 19_999
        low, high = values[math.floor(at)], values[math.ceil(at)]
        assert row.value == pytest.approx(low + (high - low) * (at - math.floor(at)), rel=1e-15)
    by_group = {g: sorted(r.v for r in df.where(f"g = {g}").collect()) for g in (0, 1)}
    for row in ranks.quantiles(df, "v", [0.25, 0.9], ["g"], "nearest").collect():
        assert row.value == by_group[row.g][math.floor(row.q * 9_999 + 0.5)]


def test_only_wanted_buckets_are_refined(spark, monkeypatch):
    monkeypatch.setattr(ranks, "LIMIT", 100)
    written = []
    real = ranks.temporary_table
    monkeypatch.setattr(ranks, "temporary_table", lambda df, name: written.append(name) or real(df, name))
    df = spark.range(5_000).selectExpr("double(id) AS v")
    assert ranks.quantiles(df, "v", [0.0]).first().value == 0.0
    assert written == ["value-counts"]  # the lowest bucket is not full
    assert ranks.quantiles(df, "v", [1.0]).first().value == 4999.0
    assert "rank-buckets" in written


def test_nothing_to_rank(spark):
    empty = spark.range(3).selectExpr("CAST(NULL AS DOUBLE) AS v")
    assert ranks.quantiles(empty, "v", [0.5]).collect() == []
    assert ranks.ranked_values(ranks.value_counts(empty, "v")).collect() == []
