"""Queries: statistics, motion, diagnostics, trips, model preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haltwerk.functions import ranks, stats
from haltwerk.operators import ablation, detect, diagnostics, enrich, features, motion, timetable
from haltwerk.plans import oracle
from haltwerk.plans.queries_core import clean_core, core, detected, indexed, schedule, shared_core, stored, stored_folder
from haltwerk.plans.registry import query
from haltwerk.sources.driver_tables import CoarseOdometer, Tables

CALC, REC = "delay_calculated_sec", "delay_recorded_sec"
QS = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def linear_sql(view: str, value: str, by: str = "", qs=QS) -> str:
    """Interpolated quantiles in long form."""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return " UNION ALL ".join(
        f"SELECT {keys}count({value}) AS n, CAST({q} AS DOUBLE) AS q,"
        f" round(quantile_cont(CAST({value} AS DOUBLE), {q}), 6) AS value FROM {view} WHERE {value} IS NOT NULL {group}"
        for q in qs
    )


def closings(t: Tables) -> DataFrame:
    """Written table of closings per drop; its analyses pass over it several times."""
    return stored(t, "closings", lambda: diagnostics.rows_to_close(t.telemetry, series=t.pings))


# -- groups and quantiles -----------------------------------------------------


@query(
    "status_share",
    "SELECT stop_status, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM detected GROUP BY 1",
)
def _(t):
    return stats.count_share(detected(t).select("stop_status"), "stop_status")


_PROFILE = ", ".join(
    f"min(v) FILTER (r = floor({q} * (n - 1) + 0.5)) AS {name}" for name, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))
)


@query(
    "profile",
    f""", long AS (SELECT 'dwell_time' AS "column", dwell_time AS v FROM core UNION ALL
          SELECT 'travel_time', travel_time FROM core UNION ALL SELECT '{CALC}', {CALC} FROM core),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY v NULLS LAST) - 1 AS r,
          count(v) OVER (PARTITION BY "column") AS n FROM long)
        SELECT "column", count(v) AS count, count(*) - count(v) AS null_count, round(avg(v), 6) AS mean,
        round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max,
        {", ".join(f"round(min(v) FILTER (r = floor({q} * (n - 1) + 0.5)), 6) AS {n}" for n, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)))}
        FROM ranked GROUP BY "column" """,
)
def _(t):
    return stats.profile(core(t), ["dwell_time", "travel_time", CALC])


@query("quantiles_linear", linear_sql("pings", "delta"))
def _(t):
    return ranks.quantiles(indexed(t), "delta", QS)


@query("quantiles_by_line", linear_sql("telemetry", "distanz", "linie"))
def _(t):
    return ranks.quantiles(t.telemetry, "distanz", QS, ["linie"])


@query(
    "quantiles_nearest",
    """, ranked AS (SELECT lage AS v, row_number() OVER (ORDER BY lage) - 1 AS r, count(*) OVER () AS n FROM telemetry)
       SELECT any_value(n) AS n, CAST(q AS DOUBLE) AS q, CAST(min(v) FILTER (r = floor(q * (n - 1) + 0.5)) AS DOUBLE) AS value
       FROM ranked, (SELECT unnest([0.01, 0.05, 0.5, 0.95, 0.99, 0.999]) AS q) GROUP BY q""",
)
def _(t):
    return ranks.quantiles(t.telemetry, "lage", [0.01, 0.05, 0.5, 0.95, 0.99, 0.999], method="nearest")


def _nearest_by_status(column: str, q: float) -> str:
    rank = f"r_{column}"
    return f"round(CAST(min({column}) FILTER ({rank} = floor({q} * (n - 1) + 0.5)) AS DOUBLE), 6)"


def micros(value: str | Column) -> Column:
    """Seconds as whole microseconds, so that medians and means are the same in any engine."""
    return F.round((F.col(value) if isinstance(value, str) else value) * 1_000_000).cast("long")


def _median_sql(column: str) -> str:
    return f"floor(median(CAST(round({column} * 1e6) AS BIGINT))) / 1e6"


@query(
    "delay_by_status",
    f""", ranked AS (SELECT stop_status, {CALC} AS calc, {REC} AS recd, {CALC} - {REC} AS diff,
          row_number() OVER (PARTITION BY stop_status ORDER BY {CALC}) - 1 AS r_calc,
          row_number() OVER (PARTITION BY stop_status ORDER BY {REC}) - 1 AS r_recd,
          count(*) OVER (PARTITION BY stop_status) AS n FROM clean_core)
        SELECT stop_status, count(*) AS n, {_median_sql("calc")} AS calc_median,
        {_nearest_by_status("calc", 0.05)} AS calc_p05, {_nearest_by_status("calc", 0.95)} AS calc_p95,
        {_median_sql("recd")} AS recd_median, {_nearest_by_status("recd", 0.05)} AS recd_p05,
        {_nearest_by_status("recd", 0.95)} AS recd_p95, {_median_sql("diff")} AS diff_median FROM ranked GROUP BY 1""",
)
def _(t):
    rows = clean_core(t).select("stop_status", F.col(CALC).alias("calc"), F.col(REC).alias("recd"))
    rows = rows.withColumn("diff", F.col("calc") - F.col("recd"))
    cells = F.array(*[F.struct(F.lit(c).alias("measure"), micros(c).alias("us")) for c in ("calc", "recd", "diff")])
    found = ranks.quantiles(rows.select("stop_status", F.inline(cells)), "us", [0.5, (0.05, "nearest"), (0.95, "nearest")], ["stop_status", "measure"])
    picks = [F.max(F.when(F.col("measure") == "calc", F.col("n"))).alias("n")]
    for c in ("calc", "recd", "diff"):
        for name, q in (("median", 0.5), ("p05", 0.05), ("p95", 0.95)):
            if name == "median" or c != "diff":
                value = F.max(F.when((F.col("measure") == c) & (F.col("q") == q), F.col("value")))
                picks.append((F.floor(value) / 1e6).alias(f"{c}_{name}"))
    return found.groupBy("stop_status").agg(*picks)


@query(
    "threshold_ladder",
    """SELECT CAST(lim AS DOUBLE) AS threshold, count(*) FILTER (distanz - step < lim) AS hits,
       round(count(*) FILTER (distanz - step < lim) / count(*), 6) AS share
       FROM trip_steps, (SELECT unnest([10, 25, 50, 75, 100, 150, 200]) AS lim) WHERE step < 0 GROUP BY lim""",
)
def _(t):
    from haltwerk.functions.ordered import neighbours

    stepped = neighbours(t.telemetry.select("fahrt_id", "tst_iso", "ping_id", "distanz"), t.trips, lag={"before": "distanz"})
    step = F.col("distanz") - F.col("before")
    falls = stepped.filter(step < 0).select((F.col("distanz") - step).alias("before_drop"))
    return stats.threshold_ladder(falls, "before_drop", [10, 25, 50, 75, 100, 150, 200])


@query(
    "histogram",
    """SELECT least(floor((distanz - 0) / 600 * 60), 59) :: BIGINT AS bin, count(*) AS count,
       round(CAST(least(floor(distanz / 600 * 60), 59) * 10 AS DOUBLE), 6) AS edge
       FROM telemetry WHERE distanz BETWEEN 0 AND 600 GROUP BY 1, 3""",
)
def _(t):
    return stats.histogram(t.telemetry, "distanz", 0, 600, 60)


@query(
    "histogram_clipped",
    """, lim AS (SELECT quantile_cont(drop_size, 0.99) AS top FROM closings),
       kept AS (SELECT drop_size FROM closings, lim WHERE drop_size <= top),
       ends AS (SELECT min(drop_size) AS lo, max(drop_size) AS hi FROM kept)
       SELECT least(floor((drop_size - lo) / (hi - lo) * 60), 59) :: BIGINT AS bin, count(*) AS count FROM kept, ends GROUP BY 1""",
)
def _(t):
    return stats.clipped_histogram(closings(t), "drop_size", 60)


@query(
    "log_histogram",
    """SELECT least(floor((ln(gap_sec) - ln(1.0)) / (ln(864000.0) - ln(1.0)) * 80), 79) :: BIGINT AS bin, count(*) AS count
       FROM trip_steps WHERE gap_sec BETWEEN 1 AND 864000 GROUP BY 1""",
)
def _(t):
    from haltwerk.plans.queries_quality import intervals

    return stats.histogram(intervals(t), "gap_sec", 1, 864_000, 80, scale="log").drop("edge")


@query(
    "log1p_histogram",
    """SELECT least(floor(ln(1 + gap_sec) / ln(CAST(864001 AS DOUBLE)) * 80), 79) :: BIGINT AS bin, count(*) AS count
       FROM trip_steps WHERE gap_sec BETWEEN 0 AND 864000 GROUP BY 1""",
)
def _(t):
    from haltwerk.plans.queries_quality import intervals

    return stats.histogram(intervals(t), "gap_sec", 0, 864_000, 80, scale="log1p").drop("edge")


@query(
    "ecdf",
    """, ranked AS (SELECT drop_size, cume_dist() OVER (PARTITION BY rows_to_close IS NOT NULL ORDER BY drop_size) AS c,
         rows_to_close IS NOT NULL AS has_close FROM closings)
       SELECT has_close, round(drop_size, 6) AS value, round(c, 6) AS cdf FROM ranked GROUP BY ALL""",
)
def _(t):
    classed = closings(t).select(F.col("rows_to_close").isNotNull().alias("has_close"), "drop_size")
    return ranks.ecdf(classed, "drop_size", ["has_close"])


@query(
    "density_grid",
    """SELECT least(floor((pos_lon - CAST(13.7 AS DOUBLE)) / (CAST(13.76 AS DOUBLE) - CAST(13.7 AS DOUBLE)) * 50), 49) :: BIGINT AS x_bin,
       least(floor((pos_lat - 51) / (CAST(51.1 AS DOUBLE) - 51) * 50), 49) :: BIGINT AS y_bin, count(*) AS count FROM telemetry
       WHERE pos_lon BETWEEN CAST(13.7 AS DOUBLE) AND CAST(13.76 AS DOUBLE) AND pos_lat BETWEEN 51 AND CAST(51.1 AS DOUBLE) GROUP BY 1, 2""",
)
def _(t):
    return stats.density_grid(t.telemetry, "pos_lon", "pos_lat", (13.7, 13.76), (51.0, 51.1), 50)


def _hex_sql(view: str, x: str, y: str, low: float, high: float, columns: int) -> str:
    """The hexagons of a square, in SQL."""
    rows = int(columns / 3**0.5)
    span = f"(CAST({high} AS DOUBLE) - {low})"
    return f"""(SELECT lattice, i AS column, j AS row, count(*) AS count, round({low} + (i + lattice * 0.5) * ({span} / {columns}), 6) AS x,
            round({low} + (j + lattice * 0.5) * ({span} / {rows}), 6) AS y, round(log10(count(*)), 6) AS log_count
        FROM (SELECT (a >= b) :: BIGINT AS lattice, CASE WHEN a < b THEN floor(u + 0.5) ELSE floor(u) END :: BIGINT AS i,
                     CASE WHEN a < b THEN floor(v + 0.5) ELSE floor(v) END :: BIGINT AS j
              FROM (SELECT *, pow(u - floor(u + 0.5), 2) + 3 * pow(v - floor(v + 0.5), 2) AS a,
                           pow(u - floor(u) - 0.5, 2) + 3 * pow(v - floor(v) - 0.5, 2) AS b
                    FROM (SELECT ({x} - CAST({low} AS DOUBLE)) * ({columns} / {span}) AS u, ({y} - CAST({low} AS DOUBLE)) * ({rows} / {span}) AS v
                          FROM {view} WHERE {x} BETWEEN {low} AND {high} AND {y} BETWEEN {low} AND {high})))
        GROUP BY lattice, i, j)"""


@query("hex_grid", f"SELECT * FROM {_hex_sql('clean_core', REC, CALC, -180, 600, 65)}")
def _(t):
    """Recorded against calculated delay in hexagons, over the displayed range."""
    return stats.hex_grid(clean_core(t), REC, CALC, (-180.0, 600.0), (-180.0, 600.0), 65)


@query("hex_grid_pings", f"SELECT * FROM {_hex_sql('telemetry', 'distanz', 'lage', 0, 300, 40)}")
def _(t):
    return stats.hex_grid(t.telemetry, "distanz", "lage", (0.0, 300.0), (0.0, 300.0), 40)


@query(
    "binned_mean",
    f""", lim AS (SELECT quantile_cont(CAST({REC} AS DOUBLE), 0.01) AS q0, quantile_cont(CAST({REC} AS DOUBLE), 0.99) AS q1 FROM clean_core)
        SELECT least(floor(({REC} - q0) / ((q1 - q0) / 39)), 38) :: BIGINT AS bin, count(*) AS n,
        floor(sum(CAST(round(({CALC} - {REC}) * 1e6) AS BIGINT)) / count(*)) / 1e6 AS mean_y FROM clean_core, lim WHERE {REC} >= q0 AND {REC} < q1 GROUP BY 1""",
)
def _(t):
    rows = clean_core(t).withColumn("diff", micros(F.col(CALC) - F.col(REC)))
    return stats.binned_mean(rows, REC, "diff", 39).select("bin", "n", (F.floor(F.col("sum_y") / F.col("n")) / 1e6).alias("mean_y"))


@query("delay_pearson", f"SELECT count(*) AS n, round(corr({CALC}, {REC}), 6) AS pearson FROM clean_core")
def _(t):
    return clean_core(t).agg(F.count(F.lit(1)).alias("n"), F.corr(CALC, REC).alias("pearson"))


@query(
    "delay_spearman",
    f""", r AS (SELECT rank() OVER (ORDER BY {CALC}) + (count(*) OVER (PARTITION BY {CALC}) - 1) / 2 AS a,
          rank() OVER (ORDER BY {REC}) + (count(*) OVER (PARTITION BY {REC}) - 1) / 2 AS b FROM clean_core)
        SELECT count(*) AS n, round(corr(a, b), 6) AS spearman FROM r""",
)
def _(t):
    return ranks.spearman(clean_core(t), CALC, REC)


@query(
    "delay_ols",
    f""", ranked AS (SELECT {CALC} AS y, {REC} AS x, row_number() OVER (ORDER BY {CALC}) - 1 AS ry,
          row_number() OVER (ORDER BY {REC}) - 1 AS rx, count(*) OVER () AS n FROM clean_core),
        lim AS (SELECT min(y) FILTER (ry = floor(0.05 * (n - 1) + 0.5)) AS y0, min(y) FILTER (ry = floor(0.95 * (n - 1) + 0.5)) AS y1,
          min(x) FILTER (rx = floor(0.05 * (n - 1) + 0.5)) AS x0, min(x) FILTER (rx = floor(0.95 * (n - 1) + 0.5)) AS x1 FROM ranked)
        SELECT count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept,
        round(corr(y, x), 6) AS r FROM ranked, lim WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1""",
)
def _(t):
    # both limits come from the untrimmed rows
    return stats.ols(stats.trimmed(clean_core(t), [CALC, REC]), REC, CALC)


@query(
    "delay_agreement",
    f"""SELECT CAST(k AS DOUBLE) AS limit_sec, count(*) FILTER (abs({CALC} - {REC}) <= k) AS hits,
        round(count(*) FILTER (abs({CALC} - {REC}) <= k) / count(*), 6) AS share
        FROM clean_core, (SELECT unnest([30, 60, 120, 3600, 36000]) AS k) GROUP BY k""",
)
def _(t):
    return stats.agreement(clean_core(t), F.col(CALC) - F.col(REC), [30, 60, 120, 3600, 36000])


@query(
    "delay_outliers",
    f"""SELECT stop_status, linie, CAST(hour(arrival_time) AS BIGINT) AS hour, count(*) AS n FROM core
        WHERE abs({CALC} - {REC}) > 600 GROUP BY 1, 2, 3""",
)
def _(t):
    far = core(t).filter(F.abs(F.col(CALC) - F.col(REC)) > 600)
    return far.groupBy("stop_status", "linie", F.hour("arrival_time").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


# -- motion -------------------------------------------------------------------


def _speeds(t: Tables) -> DataFrame:
    used = t.telemetry.select("fzg_id", "tst_iso", "ping_id", "distanz", "tuerkriterium", "pos_lat", "pos_lon")
    return motion.gps_speed(motion.odometer_speed(motion.with_steps(used, t.pings)))


@query("odometer_speed", "SELECT ping_id, round(speed_ms, 6) AS speed_ms FROM speeds")
def _(t):
    used = t.telemetry.select("fzg_id", "tst_iso", "ping_id", "distanz")
    return motion.odometer_speed(motion.with_steps(used, t.pings)).select("ping_id", "speed_ms")


@query("gps_speed", "SELECT ping_id, round(gps_dist_m, 3) AS gps_dist_m, round(gps_speed_ms, 5) AS gps_speed_ms FROM speeds")
def _(t):
    return _speeds(t).select("ping_id", F.round("gps_dist_m", 3).alias("gps_dist_m"), F.round("gps_speed_ms", 5).alias("gps_speed_ms"))


@query(
    "speed_classes",
    """SELECT count(*) FILTER (speed_ms = -1) AS drops, count(*) FILTER (speed_ms IS NULL) AS unknown,
       count(*) FILTER (speed_ms >= 0) AS normal, count(*) FILTER (speed_ms = 0) AS standing FROM speeds""",
)
def _(t):
    return motion.speed_classes(_speeds(t))


@query(
    "speed_agreement",
    """SELECT count(*) AS n, count(*) FILTER (gps_speed_ms = 0 AND speed_ms = 0) AS both_zero,
       count(*) FILTER (gps_speed_ms = 0 AND speed_ms > 0) AS only_odometer_moves,
       count(*) FILTER (gps_speed_ms > 0 AND speed_ms = 0) AS only_gps_moves
       FROM speeds WHERE gps_speed_ms IS NOT NULL AND speed_ms >= 0""",
)
def _(t):
    return motion.speed_agreement(_speeds(t))


def _door_speed_sql(column: str, thresholds) -> str:
    below = ", ".join(f"count(*) FILTER ({column} < {k}) AS below_{i}" for i, k in enumerate(thresholds))
    return f"""SELECT CASE WHEN opens THEN 'open' ELSE 'close' END AS door, count(*) AS n, count({column}) AS known,
        count(*) FILTER ({column} = -1) AS at_drop, count(*) FILTER ({column} = 0) AS standing,
        count(*) FILTER ({column} > 0) AS moving, {below},
        round(count(*) FILTER ({column} = 0) / nullif(count({column}), 0), 6) AS standing_share
        FROM speeds WHERE opens OR closes GROUP BY 1"""


@query("speed_at_door", _door_speed_sql("speed_ms", (0.0001, 0.001, 0.01)))
def _(t):
    return motion.speed_at_door(_speeds(t), "speed_ms", (0.0001, 0.001, 0.01))


@query("gps_speed_at_door", _door_speed_sql("gps_speed_ms", (0.05, 0.5, 2.0)))
def _(t):
    return motion.speed_at_door(_speeds(t), "gps_speed_ms", (0.05, 0.5, 2.0))


@query(
    "stationary_runs",
    """, marked AS (SELECT fzg_id, speed_ms, dt, sum(CASE WHEN speed_ms <> 0 THEN 1 ELSE 0 END) OVER
         (PARTITION BY fzg_id ORDER BY tst_iso, ping_id) AS run FROM speeds)
       SELECT fzg_id, CAST(run AS BIGINT) AS run, count(*) AS n_rows, CAST(sum(dt) AS BIGINT) AS duration_sec
       FROM marked WHERE speed_ms = 0 GROUP BY 1, 2""",
    oracle.COARSE_ODOMETER,
)
def _(t):
    feed = CoarseOdometer(t.spark, t.folder, t.hot_rows).telemetry
    return motion.stationary_runs(feed.select("fzg_id", "tst_iso", "ping_id", "distanz"), series=t.pings)


# -- diagnostics --------------------------------------------------------------


@query("rows_to_close", "SELECT fzg_id, drop_row_idx, rows_to_close, round(drop_size, 6) AS drop_size FROM closings")
def _(t):
    return diagnostics.rows_to_close(t.telemetry, series=t.pings)


@query(
    "window_coverage",
    """SELECT n, count(*) FILTER (rows_to_close <= n) AS covered,
       round(count(*) FILTER (rows_to_close <= n) / count(rows_to_close), 6) AS coverage
       FROM closings, (SELECT unnest(range(1, 41)) AS n) GROUP BY n""",
)
def _(t):
    return diagnostics.window_coverage(closings(t))


@query(
    "drop_size_by_close",
    linear_sql("(SELECT rows_to_close IS NOT NULL AS has_close, drop_size FROM closings)", "drop_size", "has_close", (0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)),
)
def _(t):
    return diagnostics.drop_size_by_close(closings(t))


@query(
    "drop_intervals",
    """SELECT fzg_id, drop_row_idx AS row_idx, prev_drop, next_drop, drop_row_idx - prev_drop AS rows_between,
       (epoch_us(drop_time) - epoch_us(prev_time)) // 1000000 AS seconds_between FROM falls""",
)
def _(t):
    from haltwerk.functions.scalars import whole_seconds_between

    linked = detect.drop_intervals(t.telemetry, series=t.pings)
    return linked.select(
        "fzg_id", "row_idx", "prev_drop", "next_drop", "rows_between", whole_seconds_between("tst_iso", "prev_time").alias("seconds_between")
    )


def _doors(t: Tables) -> DataFrame:
    return diagnostics.door_at_drop(core(t), indexed(t))


@query("line_drop_type", "SELECT * FROM by_line")
def _(t):
    return diagnostics.line_drop_type(_doors(t))


@query(
    "line_drop_class",
    """SELECT linie, pct_arrival, CASE WHEN pct_arrival > 70 THEN 'arrival-drop' WHEN pct_arrival < 30 THEN 'departure-drop'
       ELSE 'mixed' END AS drop_category FROM by_line""",
)
def _(t):
    classed = diagnostics.line_drop_class(diagnostics.line_drop_type(_doors(t)))
    return classed.select("linie", "pct_arrival", "drop_category")


@query(
    "line_consistency",
    """, v AS (SELECT fzg_id, linie, count(*) AS n, count(*) FILTER (door_at_drop) / count(*) * 100 AS pct FROM doors
         GROUP BY 1, 2 HAVING count(*) >= 2)
       SELECT linie, count(*) AS n_vehicles, round(avg(pct), 1) AS mean_pct_arrival, round(stddev_samp(pct), 1) AS std_pct_arrival,
       round(min(pct), 1) AS min_pct_arrival, round(max(pct), 1) AS max_pct_arrival FROM v GROUP BY linie""",
)
def _(t):
    return diagnostics.line_consistency(_doors(t), min_events=2)


def _signals(t: Tables) -> DataFrame:
    return diagnostics.stop_signal(t.telemetry, series=t.pings)


@query(
    "signal_alignment",
    """SELECT count(*) FILTER (ort_changed) AS changes, count(*) FILTER (distanz_drop) AS drops,
       count(*) FILTER (ort_changed AND distanz_drop) AS both, count(*) FILTER (ort_changed AND NOT distanz_drop) AS change_only,
       count(*) FILTER (NOT ort_changed AND distanz_drop) AS drop_only, count(*) FILTER (ort_changed AND drop_before) AS drop_one_before,
       count(*) FILTER (ort_changed AND drop_after) AS drop_one_after,
       count(*) FILTER (ort_changed AND (distanz_drop OR drop_before OR drop_after)) AS covered FROM signals""",
)
def _(t):
    return diagnostics.signal_alignment(_signals(t))


@query(
    "distance_at_change",
    linear_sql(
        """(SELECT 'distanz' AS measure, distanz AS v FROM signals WHERE ort_changed UNION ALL
            SELECT 'delta_without_drop', delta FROM signals WHERE ort_changed AND NOT distanz_drop)""",
        "v", "measure", (0.05, 0.5, 0.95),
    ),
)
def _(t):
    return diagnostics.distance_at_change(_signals(t))


@query(
    "nodoor_change_rate",
    """SELECT count(*) AS n, count(*) FILTER (s.ort_changed) AS changed, round(count(*) FILTER (s.ort_changed) / count(*), 6) AS change_rate
       FROM core c LEFT JOIN signals s ON s.fzg_id = c.fzg_id AND s.row_idx = c.drop_row_idx WHERE c.stop_status = 'no_door'""",
)
def _(t):
    return diagnostics.nodoor_change_rate(core(t), _signals(t))


@query(
    "dwell_split",
    """SELECT count(*) AS total, count(*) FILTER (stop_status = 'no_door') AS no_door,
       count(*) FILTER (stop_status <> 'no_door' AND dwell_time < 0) AS negative,
       count(*) FILTER (stop_status <> 'no_door' AND dwell_time = 0) AS zero,
       count(*) FILTER (stop_status <> 'no_door' AND dwell_time > 0) AS positive FROM core""",
)
def _(t):
    return diagnostics.dwell_split(core(t))


@query(
    "zero_dwell_by_line",
    """SELECT linie, count(*) AS total, count(*) FILTER (dwell_time = 0) AS n_zero, count(*) FILTER (dwell_time > 0) AS n_positive,
       floor(median(CAST(round(dwell_time * 1e6) AS BIGINT)) FILTER (dwell_time > 0)) / 1e6 AS median_pos,
       round(count(*) FILTER (dwell_time = 0) / count(*) * 100, 1) AS pct_zero
       FROM core WHERE stop_status <> 'no_door' GROUP BY linie""",
)
def _(t):
    rows = core(t).withColumn("dwell_time", micros("dwell_time"))
    return diagnostics.zero_dwell_by_line(rows).withColumn("median_pos", F.floor("median_pos") / 1e6)


@query(
    "dwell_share",
    """SELECT CASE WHEN dwell_time < 0 THEN 'sentinel' WHEN dwell_time = 0 THEN 'zero' ELSE 'positive' END AS kind,
       count(*) AS count, round(100.0 * (count(*) / sum(count(*)) OVER ()), 1) AS pct FROM core GROUP BY 1""",
)
def _(t):
    kind = F.when(F.col("dwell_time") < 0, "sentinel").when(F.col("dwell_time") == 0, "zero").otherwise("positive")
    return stats.count_share(core(t).select(kind.alias("kind")), "kind")


@query(
    "core_status_share",
    "SELECT stop_status, count(*) AS count, round(100.0 * (count(*) / sum(count(*)) OVER ()), 1) AS pct FROM core GROUP BY 1",
)
def _(t):
    return stats.count_share(core(t).select("stop_status"), "stop_status")


@query(
    "zero_dwell_cause",
    """SELECT CASE WHEN arrival_time = drop_time THEN 'no_opening' ELSE 'no_closing' END AS zero_reason, count(*) AS count
       FROM core WHERE stop_status <> 'no_door' AND dwell_time = 0 GROUP BY 1""",
)
def _(t):
    return diagnostics.zero_dwell_cause(core(t), indexed(t))


# Events of vehicles that share their trips, matched to one timetable record: trip, stop and scheduled arrival.
_HITS = """, hits AS (SELECT fahrt_id, ort_nr_start, scheduled_arrival_time, count(*) AS n, count(DISTINCT fzg_id) AS v,
             string_agg(DISTINCT stop_status, '/' ORDER BY stop_status) AS s,
             (epoch_us(max(arrival_time)) - epoch_us(min(arrival_time))) // 1000000 AS gap FROM core
             WHERE scheduled_arrival_time IS NOT NULL GROUP BY 1, 2, 3)"""


@query(
    "collisions",
    _HITS + """ SELECT count(*) AS records, count(*) FILTER (n > 1) AS colliding_records,
                CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS colliding_events FROM hits""",
    oracle.SHARED_TRIPS,
)
def _(t):
    return diagnostics.collisions(shared_core(t))


@query(
    "collision_types",
    _HITS + """ SELECT CASE WHEN v = 1 THEN 'same_vehicle' ELSE 'diff_vehicle' END AS collision_type, s AS stop_statuses,
                count(*) AS n_records FROM hits WHERE n > 1 GROUP BY 1, 2""",
    oracle.SHARED_TRIPS,
)
def _(t):
    records = diagnostics.collision_records(shared_core(t))
    return records.groupBy("collision_type", "stop_statuses").agg(F.count(F.lit(1)).alias("n_records"))


@query("collision_gap", _HITS + " " + linear_sql("(SELECT gap FROM hits WHERE n > 1)", "gap", qs=(0.0, 0.25, 0.5, 0.75, 0.9, 1.0)), oracle.SHARED_TRIPS)
def _(t):
    records = diagnostics.collision_records(shared_core(t))
    return ranks.quantiles(records, "gap_sec", (0.0, 0.25, 0.5, 0.75, 0.9, 1.0))


# -- trips and vehicles -------------------------------------------------------


@query(
    "planned_route",
    """SELECT s.fahrt_id, stop_index, s.ort_nr, coalesce(stop_name, 'ort_nr=' || s.ort_nr) AS stop_name, o AS offset_sec,
       '+' || (o // 60) || ':' || lpad(CAST(o % 60 AS VARCHAR), 2, '0') AS offset_text
       FROM (SELECT *, scheduled_arrival_unix - min(scheduled_arrival_unix) OVER (PARTITION BY fahrt_id) AS o FROM schedule_from) s
       LEFT JOIN names ON names.ort_nr = s.ort_nr""",
)
def _(t):
    listed = timetable.planned_route(schedule(t, inclusive=False), enrich.stop_names(t.stop_geometry))
    return listed.select("fahrt_id", "stop_index", "ort_nr", "stop_name", "offset_sec", "offset_text")


@query(
    "trip_listing",
    f"""SELECT linie, fahrt_id, fzg_id, drop_row_idx, stop_index, coalesce(stop_name, 'ort_nr=' || ort_nr_start) AS stop,
        strftime(scheduled_arrival_time + INTERVAL 1 HOUR, '%H:%M:%S') AS planned,
        strftime(arrival_time + INTERVAL 1 HOUR, '%H:%M:%S') AS actual, round({CALC}, 6) AS {CALC}, stop_status
        FROM core LEFT JOIN names ON names.ort_nr = ort_nr_start""",
)
def _(t):
    return diagnostics.trip_listing(core(t), enrich.stop_names(t.stop_geometry))


_TRIPS = f""", summary AS (SELECT linie, fahrt_id, CAST(arrival_time + INTERVAL 1 HOUR AS DATE) AS day, count(*) AS n_stops,
    arg_min(fzg_id, (arrival_time, drop_row_idx)) AS fzg_id, min(arrival_time) + INTERVAL 1 HOUR AS start_time,
    max(arrival_time) + INTERVAL 1 HOUR AS end_time, round(avg({CALC}), 1) AS avg_delay_s FROM core GROUP BY 1, 2, 3)"""


def _trips(t: Tables) -> DataFrame:
    return diagnostics.trip_summary(core(t), tz="Europe/Berlin")


@query("trip_summary", _TRIPS + " SELECT * FROM summary")
def _(t):
    return _trips(t)


@query(
    "line_hours",
    _TRIPS + """ SELECT linie, day, count(*) AS n_trips, min(n_stops) AS min_stops, max(n_stops) AS max_stops,
                 min(start_time) AS first_start, max(end_time) AS last_end FROM summary GROUP BY 1, 2""",
)
def _(t):
    return diagnostics.line_hours(_trips(t))


@query(
    "longest_trips",
    _TRIPS + """ SELECT linie, day, CASE WHEN hour(start_time) < 12 THEN 'morning' ELSE 'afternoon' END AS half, fahrt_id, n_stops
                 FROM summary QUALIFY row_number() OVER (PARTITION BY linie, day, hour(start_time) < 12
                   ORDER BY n_stops DESC, fahrt_id) = 1""",
)
def _(t):
    return diagnostics.longest_trips(_trips(t)).select("linie", "day", "half", "fahrt_id", "n_stops")


@query(
    "vehicle_types",
    """SELECT regexp_matches(typ, '^[0-9]+$') AS numeric_type, typ, typ_text, min(replace(fzg_nr, ' ', '')) AS fzg_nr_min,
       max(replace(fzg_nr, ' ', '')) AS fzg_nr_max, count(DISTINCT fzg_id) AS num_vehicles FROM vehicles GROUP BY 1, 2, 3""",
)
def _(t):
    numeric = enrich.vehicle_types(t.vehicles, enrich.is_numeric_type()).withColumn("numeric_type", F.lit(True))
    named = enrich.vehicle_types(t.vehicles, ~enrich.is_numeric_type()).withColumn("numeric_type", F.lit(False))
    return numeric.unionByName(named)


@query(
    "vehicle_type_attributes",
    """SELECT typ, typ_nr, count(DISTINCT fzg_id) AS num_vehicles, arg_min(kapazitaet, fzg_id) AS kapazitaet,
       arg_min(laenge, fzg_id) AS laenge FROM vehicles WHERE NOT regexp_matches(typ, '^[0-9]+$') GROUP BY 1, 2""",
)
def _(t):
    return enrich.vehicle_type_attributes(t.vehicles)


# -- model preparation and scores ---------------------------------------------

MIN_ROWS = 50  # rows that make a day a full day in the given tables


def visits(t: Tables) -> DataFrame:
    return features.add_binary_features(t.stop_visits)


def matrix(t: Tables) -> DataFrame:
    return features.feature_matrix(visits(t))


def splits(t: Tables) -> DataFrame:
    return ablation.temporal_split(matrix(t), MIN_ROWS)


@query(
    "local_time_features",
    "SELECT fzg_id, drop_row_idx, local_date AS service_date, hour_of_day, day_of_week FROM prepared",
)
def _(t):
    return features.local_time_features(visits(t)).select("fzg_id", "drop_row_idx", "service_date", "hour_of_day", "day_of_week")


@query("next_travel_time", "SELECT fzg_id, drop_row_idx, fahrt_id, round(next_travel, 6) AS target FROM targets")
def _(t):
    prepared = features.sentinel_fill(features.local_time_features(visits(t)))
    return features.next_travel_time(prepared).select("fzg_id", "drop_row_idx", "fahrt_id", "target")


_MATRIX = f"""fahrt_id, service_date, round(CAST(dwell_time AS DOUBLE), 6) AS dwell_time, round({CALC}, 6) AS {CALC}, stop_index, besetztgrad, linie,
    ort_nr_start, stop_status :: BIGINT AS stop_status, is_peak_hour :: BIGINT AS is_peak_hour,
    is_workday :: BIGINT AS is_workday, hour_of_day, day_of_week, round(CAST(target AS DOUBLE), 6) AS target"""


@query("feature_matrix", f"SELECT {_MATRIX} FROM matrix")
def _(t):
    return matrix(t)


@query("temporal_split", f"SELECT {_MATRIX}, split FROM splits")
def _(t):
    return splits(t)


@query(
    "split_counts",
    """SELECT split, count(*) AS n, count(DISTINCT service_date) AS days, min(service_date) AS first_day,
       max(service_date) AS last_day FROM splits GROUP BY split""",
)
def _(t):
    return ablation.split_counts(splits(t))


@query("fixed_dwell", f"SELECT {_MATRIX}, split FROM fixed")
def _(t):
    return ablation.fixed_dwell(splits(t))


def _sets_with(column: str) -> list[str]:
    return [name for name, names in features.FEATURE_SETS.items() if column in names]


def _set_column(c: str) -> str:
    kind = "DOUBLE" if c in ("dwell_time", CALC) else "BIGINT"
    value = f"CASE WHEN feature_set IN ({', '.join(repr(n) for n in _sets_with(c))}) THEN CAST({c} AS {kind}) END"
    return f"round({value}, 6) AS {c}" if kind == "DOUBLE" else f"{value} AS {c}"


@query(
    "feature_sets",
    f"""SELECT fahrt_id, service_date, split, feature_set, {", ".join(map(_set_column, features.FEATURES))}
        FROM splits, (SELECT unnest([{", ".join(repr(n) for n in features.FEATURE_SETS)}]) AS feature_set)""",
)
def _(t):
    """Every row once for each set, with the features of that set."""
    names = F.array(*[F.lit(n) for n in features.FEATURE_SETS])
    rows = splits(t).withColumn("feature_set", F.explode(names))
    chosen = [F.when(F.col("feature_set").isin(_sets_with(c)), F.col(c)).alias(c) for c in features.FEATURES]
    return rows.select("fahrt_id", "service_date", "split", "feature_set", *chosen)


# The mean of the line in training stands in for a model's prediction.
_BASELINE = """, means AS (SELECT linie, avg(target) AS p FROM splits WHERE split = 'train' GROUP BY 1),
    scored AS (SELECT s.*, greatest(10, least(600, p)) AS pred FROM splits s JOIN means USING (linie) WHERE split = 'test')"""
_ERRORS = "count(*) AS n, round(avg(abs(target - pred)), 6) AS mae, round(sqrt(avg(pow(target - pred, 2))), 6) AS rmse"


def _baseline(t: Tables) -> DataFrame:
    from haltwerk.functions.scalars import clip

    rows = splits(t)
    means = rows.filter("split = 'train'").groupBy("linie").agg(F.avg("target").alias("p"))
    return rows.filter("split = 'test'").join(means, "linie").withColumn("pred", clip("p", 10, 600))


@query("error_metrics", f"{_BASELINE} SELECT {_ERRORS} FROM scored")
def _(t):
    return stats.error_metrics(_baseline(t))


@query("error_by_group", f"{_BASELINE} SELECT is_peak_hour :: BIGINT AS is_peak_hour, stop_status :: BIGINT AS stop_status, {_ERRORS} FROM scored GROUP BY 1, 2")
def _(t):
    return stats.error_metrics(_baseline(t), by=["is_peak_hour", "stop_status"])


def stored_splits(t: Tables) -> DataFrame:
    return stored(t, "splits", lambda: splits(t), "lineitem")


def model_folder(t: Tables) -> str:
    """The models of all sets and variants, trained once with the operator's full settings and stored."""
    return stored_folder(t, "models", lambda path: ablation.fit_models(stored_splits(t), path), "lineitem")


def predicted(t: Tables) -> DataFrame:
    """The stored models' predictions of the test rows, written once."""
    return stored(t, "predictions", lambda: ablation.predictions(stored_splits(t), model_folder(t)), "lineitem")


@query("gbt_ablation")
def _(t):
    return ablation.compared_sets(predicted(t))


@query("model_error_metrics")
def _(t):
    """Errors of the trained models; ``error_metrics`` scores the line mean that its check statement can express."""
    return stats.error_metrics(predicted(t), by=["feature_set", "variant"])


@query("model_error_by_group")
def _(t):
    return stats.error_metrics(predicted(t), by=["feature_set", "variant", "is_peak_hour", "stop_status"])


@query("feature_rank")
def _(t):
    return ablation.feature_rank(t.spark, model_folder(t))


# What must hold of trained models, whatever their numbers: rows, order of the errors, and no worse than a constant.
_MODELS = f"""models AS (SELECT unnest([{", ".join(repr(n) for n in features.FEATURE_SETS)}]) AS feature_set, variant
    FROM (SELECT unnest(['computed', 'fixed']) AS variant))"""


@query(
    "gbt_ablation_checks",
    f"""SELECT unnest([{", ".join(repr(n) for n in features.FEATURE_SETS)}]) AS feature_set, true AS errors_in_order, true AS improvement_fits""",
)
def _(t):
    rows = ablation.compared_sets(predicted(t))
    ordered = [(F.col(f"mae_{v}") > 0) & (F.col(f"mae_{v}") <= F.col(f"rmse_{v}")) for v in ablation.VARIANTS]
    fits = F.abs(F.col("mae_improvement_pct") * F.col("mae_fixed") / 100 - (F.col("mae_fixed") - F.col("mae_computed"))) < 1e-6
    return rows.select("feature_set", (ordered[0] & ordered[1]).alias("errors_in_order"), fits.alias("improvement_fits"))


@query(
    "model_error_checks",
    f""", {_MODELS}, test AS (SELECT count(*) AS n, sum(target) AS total FROM splits WHERE split = 'test')
        SELECT feature_set, variant, n, round(total, 6) AS total, true AS within_bounds, true AS no_worse_than_constant FROM models, test""",
)
def _(t):
    """Every model scores every test row, inside the bounds, and with an error that a constant's is not clearly below."""
    mean = stored_splits(t).filter("split = 'train'").agg(F.avg("target")).scalar()
    rows = predicted(t).groupBy("feature_set", "variant").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("target").alias("total"),
        F.min(F.col("pred").between(10, 600)).alias("within_bounds"),
        F.avg((F.col("pred") - F.col("target")) ** 2).alias("own"),
        F.avg((mean - F.col("target")) ** 2).alias("constant"),
    )
    return rows.withColumn("no_worse_than_constant", F.col("own") <= 1.02 * F.col("constant")).drop("own", "constant")


@query(
    "model_group_checks",
    f""", {_MODELS}, test AS (
            SELECT is_peak_hour :: BIGINT AS is_peak_hour, stop_status :: BIGINT AS stop_status, count(*) AS n FROM splits WHERE split = 'test' GROUP BY 1, 2)
        SELECT feature_set, variant, is_peak_hour, stop_status, n, true AS errors_in_order FROM models, test""",
)
def _(t):
    rows = stats.error_metrics(predicted(t), by=["feature_set", "variant", "is_peak_hour", "stop_status"])
    return rows.select("feature_set", "variant", "is_peak_hour", "stop_status", "n", ((F.col("mae") >= 0) & (F.col("mae") <= F.col("rmse") + 1e-9)).alias("errors_in_order"))


@query(
    "feature_rank_checks",
    f"SELECT unnest([{", ".join(repr(n) for n in features.FEATURES)}]) AS feature, true AS is_share, true AS sums_to_one, true AS ranks_fit",
)
def _(t):
    """Every feature has a share of the gain between 0 and 1, the shares add up to 1, and ranks follow them."""
    rows = ablation.feature_rank(t.spark, model_folder(t))
    whole = Window.partitionBy()  # a row per feature
    fits = F.coalesce(F.lag("importance").over(Window.orderBy("rank")) >= F.col("importance"), F.lit(True))
    return rows.select(
        "feature",
        F.col("importance").between(0, 1).alias("is_share"),
        (F.abs(F.sum("importance").over(whole) - 1) < 1e-9).alias("sums_to_one"),
        fits.alias("ranks_fit"),
    )
