"""Queries: data quality of the feed, gaps, noise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltwerk.functions import ranks, stats
from haltwerk.operators import diagnostics, quality
from haltwerk.plans.queries_core import indexed
from haltwerk.plans.registry import QUERIES, query
from haltwerk.sources.driver_tables import Tables
from haltwerk.sources.files import distinct_rows

GAP = 86_400  # pings of these tables are hours apart
LINE_KEYS = ("l_orderkey", "l_linenumber")


def flagged(t: Tables) -> DataFrame:
    return quality.noise_flags(t.telemetry, series=t.trips)


def intervals(t: Tables) -> DataFrame:
    return quality.sampling_intervals(t.telemetry.select("fahrt_id", "fzg_id", "tst_iso", "ping_id"), t.trips)


# Whole rows; the lines of every 7th order stand twice, so that twins occur.
@query(
    "hard_duplicates",
    """SELECT CAST(sum(c) AS BIGINT) AS total_rows, CAST(sum(c) FILTER (c > 1) AS BIGINT) AS hard_dup_count,
       round(sum(c) FILTER (c > 1) / sum(c), 6) AS hard_dup_rate FROM (SELECT *, count(*) AS c FROM
       (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 7 = 0) GROUP BY ALL)""",
)
def _(t):
    lines = t.table("lineitem")
    return quality.hard_duplicates(lines.unionByName(lines.filter("l_orderkey % 7 = 0")))


@query(
    "soft_duplicates",
    """SELECT CAST(sum(c) AS BIGINT) AS total_rows, CAST(sum(c - 1) AS BIGINT) AS soft_dup_extra_rows,
       count(*) FILTER (c > 1) AS soft_dup_affected_groups, round(sum(c - 1) / sum(c), 6) AS soft_dup_rate
       FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
)
def _(t):
    return quality.soft_duplicates(t.table("lineitem"), LINE_KEYS)


@query(
    "soft_dup_rows",
    """SELECT l_orderkey, l_linenumber :: BIGINT AS l_linenumber, l_partkey, l_suppkey FROM lineitem
       QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1""",
)
def _(t):
    rows = quality.soft_dup_rows(t.table("lineitem"), LINE_KEYS)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    "soft_dup_by_line",
    """SELECT l_returnflag, CAST(count(*) FILTER (c > 1) AS BIGINT) AS soft_dup_rows, count(*) AS total_rows,
       round(count(*) FILTER (c > 1) / count(*), 6) AS soft_dup_rate
       FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS c FROM lineitem)
       GROUP BY l_returnflag HAVING count(*) FILTER (c > 1) > 0""",
)
def _(t):
    return quality.soft_dup_by_line(t.table("lineitem"), LINE_KEYS, "l_returnflag")


_FIELDS = [
    ("distanz", "core"), ("tuerkriterium", "core"), ("fahrt_id", "core"), ("ort_nr_start", "core"), ("lage", "analysis"),
    ("besetztgrad", "analysis"), ("pos_lat", "analysis"), ("pos_lon", "analysis"), ("linie_text", "secondary"),
    ("status_text", "secondary"),
]


@query(
    "field_missing",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{g}' AS \"group\", count(*) - count({c}) AS null_count,"
        f" round((count(*) - count({c})) / count(*), 6) AS null_rate FROM telemetry"
        for c, g in _FIELDS
    ),
)
def _(t):
    return quality.field_missing(t.telemetry)


@query(
    "null_rates",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, count(*) AS total_rows,"
        f" round((count(*) - count({c})) / count(*), 6) AS null_rate FROM telemetry"
        for c in ("linie_text", "status_text", "lage")
    ),
)
def _(t):
    return stats.null_rates(t.telemetry, ["linie_text", "status_text", "lage"])


@query(
    "null_rates_by_line",
    " UNION ALL ".join(
        f"SELECT linie, '{c}' AS \"column\", count(*) - count({c}) AS null_count, count(*) AS total_rows,"
        f" round((count(*) - count({c})) / count(*), 6) AS null_rate FROM telemetry GROUP BY linie"
        for c in ("linie_text", "distanz")
    ),
)
def _(t):
    return stats.null_rates(t.telemetry, ["linie_text", "distanz"], ["linie"])


@query(
    "missing_by_line",
    """SELECT linie, count(*) AS total_rows, CAST(0 AS DOUBLE) AS distanz_null_rate, CAST(0 AS DOUBLE) AS
       tuerkriterium_null_rate, CAST(0 AS DOUBLE) AS fahrt_id_null_rate, CAST(0 AS DOUBLE) AS ort_nr_start_null_rate
       FROM telemetry WHERE distanz IS NOT NULL GROUP BY linie""",
)
def _(t):
    return quality.missing_by_line(t.telemetry)


@query("trip_gaps", f"SELECT fahrt_id, fzg_id, linie, tst_iso, gap_sec FROM trip_steps WHERE gap_sec > {GAP}")
def _(t):
    return quality.trip_gaps(t.telemetry, GAP, t.trips).select("fahrt_id", "fzg_id", "linie", "tst_iso", "gap_sec")


@query(
    "gap_summary",
    f"""SELECT count(*) AS total_rows, count(*) FILTER (gap_sec > {GAP}) AS trip_gap_count,
        count(DISTINCT fahrt_id) FILTER (gap_sec > {GAP}) AS affected_trips,
        round(count(*) FILTER (gap_sec > {GAP}) / count(*), 6) AS trip_gap_rate FROM trip_steps""",
)
def _(t):
    return quality.gap_summary(t.telemetry, GAP, t.trips)


_NEAREST = "min(v) FILTER (r = floor({q} * (n - 1) + 0.5))"


@query(
    "sampling_interval",
    """, ranked AS (SELECT gap_sec AS v, row_number() OVER (ORDER BY gap_sec) - 1 AS r, count(*) OVER () AS n
         FROM trip_steps WHERE gap_sec > 0)
       SELECT count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, max(v) AS max, """
    + ", ".join(f"round(CAST({_NEAREST.format(q=q)} AS DOUBLE), 6) AS {n}" for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999)))
    + " FROM ranked",
)
def _(t):
    spaced = intervals(t).filter("gap_sec > 0")
    basic = spaced.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("gap_sec").alias("mean"),
        F.stddev_samp("gap_sec").alias("std"),
        F.min("gap_sec").alias("min"),
        F.max("gap_sec").alias("max"),
    )
    qs = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}
    wide = ranks.quantiles_wide(spaced, "gap_sec", qs, method="nearest")
    return basic.join(F.broadcast(wide), F.lit(True))  # a row each


@query(
    "gap_hours",
    f"SELECT CAST(hour(tst_iso) AS BIGINT) AS hour_of_day, count(*) AS count FROM trip_steps WHERE gap_sec > {GAP} GROUP BY 1",
)
def _(t):
    gaps = quality.trip_gaps(t.telemetry.select("fahrt_id", "tst_iso", "ping_id"), GAP, t.trips)
    return gaps.groupBy(F.hour("tst_iso").alias("hour_of_day")).agg(F.count(F.lit(1)).alias("count"))


@query(
    "gap_ladder",
    """SELECT CAST(lim AS DOUBLE) AS threshold, count(*) FILTER (gap_sec > lim) AS hits,
       round(count(*) FILTER (gap_sec > lim) / count(*), 6) AS share
       FROM trip_steps, (SELECT unnest([3600, 21600, 86400, 172800]) AS lim) WHERE gap_sec > 0 GROUP BY lim""",
)
def _(t):
    return stats.threshold_ladder(intervals(t).filter("gap_sec > 0"), "gap_sec", [3600, 21600, 86400, 172800], below=False)


@query("n1_gps_zero", "SELECT fzg_id, count(*) AS n FROM noise WHERE n1 GROUP BY fzg_id")
def _(t):
    return quality.gps_zero(t.telemetry).groupBy("fzg_id").agg(F.count(F.lit(1)).alias("n"))


@query("n2_distance_spike", "SELECT ping_id, fahrt_id, distanz FROM noise WHERE n2")
def _(t):
    return flagged(t).filter("n2").select("ping_id", "fahrt_id", "distanz")


@query("n3_small_drop", "SELECT ping_id, fahrt_id, distanz FROM noise WHERE n3")
def _(t):
    return flagged(t).filter("n3").select("ping_id", "fahrt_id", "distanz")


@query("n4_delay_extreme", "SELECT ping_id, lage, status_text FROM noise WHERE n4")
def _(t):
    return quality.lage_extreme(t.telemetry).select("ping_id", "lage", "status_text")


@query("n5_default_zero", "SELECT status_text, count(*) AS count FROM noise WHERE n5 GROUP BY 1")
def _(t):
    return quality.default_zero_by_status(t.telemetry)


@query("n6_bad_status", "SELECT status_text, count(*) AS count FROM noise WHERE n6 GROUP BY 1")
def _(t):
    return quality.bad_status_by_status(t.telemetry)


@query("noise_flags", "SELECT ping_id, n1, n2, n3, n4, n5, n6 FROM noise")
def _(t):
    return flagged(t).select("ping_id", *quality.NOISE)


_COUNTS = ", ".join(f"count(*) FILTER (n{i}) AS n{i}_count" for i in range(1, 7))


@query(
    "noisy_union",
    f"""SELECT count(*) AS total_rows, {_COUNTS}, count(*) FILTER (n1 OR n2 OR n3 OR n4 OR n5 OR n6) AS noisy_union_count,
        greatest({', '.join(f'count(*) FILTER (n{i})' for i in range(1, 7))}) AS noisy_union_legacy,
        round(count(*) FILTER (n1 OR n2 OR n3 OR n4 OR n5 OR n6) / count(*), 6) AS noisy_union_rate FROM noise""",
)
def _(t):
    return quality.noisy_union(flagged(t))


@query(
    "noisy_by_line",
    f"""SELECT linie, count(*) AS total_rows, {_COUNTS}, count(*) FILTER (n1 OR n2 OR n4 OR n5 OR n6) AS any_noisy_count,
        round(count(*) FILTER (n1 OR n2 OR n4 OR n5 OR n6) / count(*), 6) AS noisy_rate FROM noise GROUP BY linie""",
)
def _(t):
    return quality.noisy_by_line(flagged(t))


@query(
    "union_flags",
    " UNION ALL ".join(f"SELECT 'n{i}' AS category, ping_id FROM noise WHERE n{i}" for i in range(1, 7)),
)
def _(t):
    hits = F.array(*[F.when(F.col(n), F.lit(n)) for n in quality.NOISE])
    return flagged(t).select(F.explode(F.array_compact(hits)).alias("category"), "ping_id")


def _documents(t: Tables, longest: int = quality.LONGEST) -> dict[str, DataFrame]:
    return {
        "A1": quality.redundant_summary(t.table("lineitem"), LINE_KEYS, "l_returnflag", longest),
        "A2": quality.missing_summary(t.telemetry, gap_threshold_sec=GAP, series=t.trips, longest=longest),
        "A3": quality.noisy_summary(t.telemetry, series=t.trips, longest=longest),
    }


@query("quality_summary")
def _(t):
    rows = [d.select(F.lit(n).alias("report"), F.to_json(F.struct("*")).alias("document")) for n, d in _documents(t).items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_LISTS = {
    "A1": {"soft_dup_by_line": "l_returnflag"},
    "A2": {"field_missing": "column", "missing_by_line": "linie"},
    "A3": {"n5_by_status": "status_text", "n6_by_status": "status_text", "noisy_by_line": "linie"},
}
SHORT = 5  # entries of the lists in the long form, fewer than there are lines


def _flat(report: str, name: str | None, sql: str, numbers: list[str], label: str = "''", by: str | None = None) -> str:
    """The numbers of a statement in long form; with ``by`` its ``SHORT`` heaviest rows."""
    top = f" QUALIFY row_number() OVER (ORDER BY {by} DESC, {label}) <= {SHORT}" if by else ""
    prefix = f"{name}." if name else ""
    return " UNION ALL ".join(
        f"SELECT '{report}' AS report, '{prefix}{c}' AS measure, CAST({label} AS VARCHAR) AS label, round(CAST({c} AS DOUBLE), 6) AS value FROM (SELECT * FROM ({sql}){top})"
        for c in numbers
    )


def _checked(name: str) -> str:
    return QUERIES[name].sql


_HARD_SQL = """SELECT CAST(coalesce(sum(c) FILTER (c > 1), 0) AS BIGINT) AS hard_dup_count, round(coalesce(sum(c) FILTER (c > 1), 0) / sum(c), 6) AS hard_dup_rate
    FROM (SELECT *, count(*) AS c FROM lineitem GROUP BY ALL)"""
_LINE_RATES = ["total_rows", *(f"{c}_null_rate" for c in quality.FIELD_GROUPS["core"])]


@query(
    "quality_summary_rows",
    " UNION ALL ".join(
        [
            _flat("A1", None, _checked("soft_duplicates"), ["total_rows", "soft_dup_extra_rows", "soft_dup_affected_groups", "soft_dup_rate"]),
            _flat("A1", None, _HARD_SQL, ["hard_dup_count", "hard_dup_rate"]),
            _flat("A1", "soft_dup_by_line", _checked("soft_dup_by_line"), ["soft_dup_rows", "total_rows", "soft_dup_rate"], "l_returnflag", "soft_dup_rows"),
            _flat("A2", None, _checked("gap_summary"), ["total_rows", "trip_gap_count", "affected_trips", "trip_gap_rate"]),
            _flat("A2", None, "SELECT CAST(count(*) FILTER (distanz IS NOT NULL AND fahrt_id IS NOT NULL AND tuerkriterium IS NOT NULL AND ort_nr_start IS NOT NULL) AS DOUBLE) / count(*) AS core_completeness_rate FROM telemetry", ["core_completeness_rate"]),
            _flat("A2", "field_missing", _checked("field_missing"), ["null_count", "null_rate"], '"column"'),
            _flat("A2", "missing_by_line", _checked("missing_by_line"), _LINE_RATES, "linie", "total_rows"),
            _flat("A3", None, _checked("noisy_union"), ["total_rows", *(f"n{i}_count" for i in range(1, 7)), "noisy_union_count", "noisy_union_legacy", "noisy_union_rate"]),
            _flat("A3", None, "SELECT count(DISTINCT fzg_id) AS n1_affected_vehicles FROM noise WHERE n1", ["n1_affected_vehicles"]),
            _flat("A3", "n5_by_status", "SELECT status_text, count(*) AS count FROM noise WHERE n5 GROUP BY 1", ["count"], "status_text", "count"),
            _flat("A3", "n6_by_status", "SELECT status_text, count(*) AS count FROM noise WHERE n6 GROUP BY 1", ["count"], "status_text", "count"),
            _flat("A3", "noisy_by_line", _checked("noisy_by_line"), ["total_rows", *(f"n{i}_count" for i in range(1, 7)), "any_noisy_count", "noisy_rate"], "linie", "any_noisy_count"),
        ]
    ),
)
def _(t):
    """The three documents in long form, with lists of a few entries."""
    rows = [quality.summary_rows(d, _LISTS[n]).withColumn("report", F.lit(n)) for n, d in _documents(t, SHORT).items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("status_text_share", "SELECT status_text, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM telemetry GROUP BY 1")
def _(t):
    return stats.count_share(t.telemetry, "status_text", digits=4)


@query(
    "occupancy_by_hour",
    """SELECT CAST(hour(tst_iso) AS BIGINT) AS hour, count(*) AS n, round(avg(besetztgrad), 6) AS mean_besetztgrad
       FROM telemetry WHERE besetztgrad <> -1 GROUP BY 1""",
)
def _(t):
    return diagnostics.occupancy_by_hour(t.telemetry)


@query(
    "occupancy_by_local_hour",
    """SELECT CAST(hour(tst_iso + INTERVAL 1 HOUR) AS BIGINT) AS hour, count(*) AS n,
       round(avg(besetztgrad), 6) AS mean_besetztgrad FROM telemetry WHERE besetztgrad <> -1 GROUP BY 1""",
)
def _(t):
    return diagnostics.occupancy_by_hour(t.telemetry, tz="Europe/Berlin")


# -- sort, limit, distinct, sample --------------------------------------------


@query(
    "sorted_report",
    f"""SELECT linie, round(count(*) FILTER (n1 OR n2 OR n4 OR n5 OR n6) / count(*), 6) AS noisy_rate FROM noise
        GROUP BY linie ORDER BY noisy_rate DESC, linie""",
)
def _(t):
    return quality.noisy_by_line(flagged(t)).select("linie", "noisy_rate").orderBy(F.col("noisy_rate").desc(), "linie")


@query(
    "top_gaps",
    "SELECT fahrt_id, tst_iso, gap_sec FROM trip_steps WHERE gap_sec IS NOT NULL ORDER BY gap_sec DESC, ping_id LIMIT 10",
)
def _(t):
    gaps = intervals(t).filter("gap_sec is not null")
    return gaps.orderBy(F.col("gap_sec").desc(), "ping_id").limit(10).select("fahrt_id", "tst_iso", "gap_sec")


@query("distinct_rows", "SELECT DISTINCT linie, status_text, ort_nr_start FROM telemetry")
def _(t):
    return distinct_rows(t.telemetry.select("linie", "status_text", "ort_nr_start"))


@query(
    "hash_sample",
    "SELECT ping_id, fzg_id, tst_iso, round(distanz, 6) AS distanz FROM telemetry ORDER BY md5('42|' || ping_id), ping_id LIMIT 500",
)
def _(t):
    pings = t.telemetry.select("ping_id", "fzg_id", "tst_iso", "distanz")
    return diagnostics.hash_sample(pings, ["ping_id"], n=500, seed=42)


@query(
    "distinct_counts",
    "SELECT count(DISTINCT fzg_id) AS vehicles, count(DISTINCT fahrt_id) AS trips, count(DISTINCT ort_nr_start) AS stops FROM telemetry",
)
def _(t):
    return indexed(t).agg(
        F.count_distinct("fzg_id").alias("vehicles"),
        F.count_distinct("fahrt_id").alias("trips"),
        F.count_distinct("ort_nr_start").alias("stops"),
    )
