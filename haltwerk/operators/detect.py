"""Stop events from vehicle pings.

A stop shows as a fall of the odometer-since-last-stop (``distanz``).  Around
each fall a window of up to ``n`` rows on either side, cut at the neighbouring
falls, is searched for door transitions.

A ping lies in the windows of at most two falls, the one before and the one
after it.  So each ping is sent to those two and aggregated; no range join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haltwerk.functions.ordered import (
    Series,
    across_slices,
    cut_rows,
    neighbours,
    running,
    slice_columns,
    slice_edges,
    unsliced,
    with_edges,
    within_slice,
)
from haltwerk.functions.scalars import false, true

DROP_THRESHOLD = 100
PING_SERIES = Series(keys=("fzg_id",), time="tst_iso")


def _links(pings: DataFrame, series: Series) -> tuple[dict[str, str], dict[str, str]]:
    lag = {"_distanz": "distanz", "_time_before": series.time}
    if "tuerkriterium" not in pings.columns:
        return lag, {}
    return {**lag, "door_before": "tuerkriterium"}, {"door_after": "tuerkriterium"}


def ping_edges(pings: DataFrame, series: Series = PING_SERIES) -> DataFrame:
    """Slice edges that :func:`index_pings` needs."""
    door = ["tuerkriterium"] if "tuerkriterium" in pings.columns else []
    return slice_edges(pings.select(*series.keys, *series.order, "distanz", *door), series, *_links(pings, series), index=True)


def index_pings(
    pings: DataFrame, series: Series = PING_SERIES, keep_slices: bool = False, edges: DataFrame | None = None, keep_before: bool = False
) -> DataFrame:
    """Add ``row_idx`` (from 0 per vehicle), ``delta``, and the door before and after.

    ``keep_before`` keeps the time of the row before as ``_time_before``.
    """
    lag, lead = _links(pings, series)
    indexed = neighbours(pings, series, lag, lead, index="row_idx", keep_slices=keep_slices, edges=edges)
    return indexed.withColumn("delta", F.col("distanz") - F.col("_distanz")).drop("_distanz", *([] if keep_before else ["_time_before"]))


def drops(
    pings: DataFrame, drop_threshold: float = DROP_THRESHOLD, series: Series = PING_SERIES, keep_slices: bool = False
) -> DataFrame:
    """Rows where the distance falls by more than the threshold."""
    narrow = pings.select(*series.keys, *series.order, "distanz")
    falls = index_pings(narrow, series, keep_slices=True).filter(F.col("delta") < -drop_threshold)
    return falls if keep_slices else unsliced(falls)


def drop_intervals(
    pings: DataFrame, drop_threshold: float = DROP_THRESHOLD, series: Series = PING_SERIES
) -> DataFrame:
    """Drops with the previous / next drop row and the rows and time since the previous one."""
    falls = drops(pings, drop_threshold, series, keep_slices=True)
    linked = neighbours(
        falls,
        series,
        lag={"prev_drop": "row_idx", "prev_time": series.time},
        lead={"next_drop": "row_idx"},
    )
    return linked.withColumn("rows_between", F.col("row_idx") - F.col("prev_drop"))


def _window_size(median: Column, n_min: int, n_max: int) -> Column:
    # least and greatest skip NULL, so no median must be told apart first
    half = (median / 2).cast("int")
    return F.when(half.isNotNull(), F.greatest(F.lit(n_min), F.least(F.lit(n_max), half)))


def window_size(
    intervals: DataFrame, n_min: int = 3, n_max: int = 10, n_default: int = 5
) -> DataFrame:
    """Half the median number of rows between drops, within bounds; one row.

    Values above ``4 * n_max`` are counted as ``4 * n_max``.  The result is the
    same, for a median that large is cut to ``n_max`` either way, and the exact
    median holds at most that many distinct values, whatever the input size.
    """
    capped = F.least(F.col("rows_between"), F.lit(4 * n_max))
    return intervals.filter("rows_between > 0").agg(
        F.coalesce(_window_size(F.percentile(capped, F.lit(0.5)), n_min, n_max), F.lit(n_default)).alias("n")
    )


def window_size_by_vehicle(
    intervals: DataFrame, key: str = "fzg_id", n_min: int = 3, n_max: int = 10
) -> DataFrame:
    """Window size per vehicle, for diagnosis."""
    capped = F.least(F.col("rows_between"), F.lit(4 * n_max))
    median = F.percentile(capped, F.lit(0.5))
    return intervals.filter("rows_between is not null").groupBy(key).agg(_window_size(median, n_min, n_max).alias("n"))


def transitions(indexed: DataFrame) -> DataFrame:
    """Door opening and closing flags.

    ``closes`` needs a seen closed door; ``shuts`` also takes a missing reading
    after an open door, the rule of the repair step.
    """
    return indexed.withColumns(
        {
            "opens": false("door_before") & true("tuerkriterium"),
            "closes": true("door_before") & false("tuerkriterium"),
            "shuts": true("door_before") & ~true("tuerkriterium"),
        }
    )


def _indexed_distances(
    pings: DataFrame, drop_threshold: float, series: Series, edges: DataFrame | None = None
) -> DataFrame:
    """Only key, order and distance, indexed and sliced, with the drop flag.

    The window size and the drops beyond a slice edge are both read from here,
    from the same columns, so that Spark shuffles them once.
    """
    narrow = pings.select(*series.keys, *series.order, "distanz")
    return _flag_drops(index_pings(narrow, series, keep_slices=True, edges=edges, keep_before=True), drop_threshold)


def _begins(series: Series) -> Column:
    """Whether a row is the first one of its instant; pings may share one."""
    return ~F.col(series.time).eqNullSafe(F.col("_time_before"))


def _flag_drops(indexed: DataFrame, drop_threshold: float) -> DataFrame:
    return indexed.withColumn("is_drop", F.coalesce(F.col("delta") < -drop_threshold, F.lit(False)))


def _edge_drops(narrow: DataFrame, series: Series) -> DataFrame:
    """Per slice: its first drop, the last drop before it, the first drop after it, and the last row before it that begins an instant."""
    part = slice_columns(series)
    drop_row = F.when(F.col("is_drop"), F.col("row_idx"))
    begin_row = F.when(_begins(series), F.col("row_idx"))
    found = cut_rows(narrow).groupBy(*part).agg(F.min(drop_row).alias("first_drop"), F.max(drop_row).alias("last_drop"), F.max(begin_row).alias("last_begin"))
    forward, backward = across_slices(series)
    return found.select(
        *part,
        "first_drop",
        F.max("last_drop").over(forward).alias("drop_before"),
        F.min("first_drop").over(backward).alias("drop_beyond"),
        F.max("last_begin").over(forward).alias("begin_before"),
    )


def row_intervals(pings: DataFrame, drop_threshold: float = DROP_THRESHOLD, series: Series = PING_SERIES) -> DataFrame:
    """Rows between successive drops of a vehicle, one row per pair, without the vehicle."""
    narrow = _indexed_distances(pings, drop_threshold, series, ping_edges(pings, series))
    across = _edge_drops(narrow, series).select((F.col("first_drop") - F.col("drop_before")).alias("rows_between"))
    within = narrow.filter("is_drop").select(
        (F.col("row_idx") - F.lag("row_idx").over(within_slice(series))).alias("rows_between")
    )
    return across.unionByName(within).filter("rows_between is not null")


def mark_drops(
    pings: DataFrame, drop_threshold: float = DROP_THRESHOLD, series: Series = PING_SERIES
) -> DataFrame:
    """Indexed pings with door transitions and the drops around each ping.

    ``prev_drop``/``next_drop`` are the drop rows strictly before / after.
    ``_open_gap_before``/``_open_gap_after`` are the rows to the nearest
    opening, or to the slice edge where that is nearer.

    ``late_shut`` marks the first row after an instant if its door is not open.
    It closes a door that opened at that instant (``_time_before``, first row
    ``_instant_row``), whatever the instant's other pings say.
    """
    edges = ping_edges(pings, series)
    indexed = _flag_drops(transitions(index_pings(pings, series, keep_slices=True, edges=edges, keep_before=True)), drop_threshold)
    narrow = _indexed_distances(pings, drop_threshold, series, edges)
    joined = with_edges(indexed, _edge_drops(narrow, series).drop("first_drop"), series)

    drop_row = F.when(F.col("is_drop"), F.col("row_idx"))
    open_row = F.when(F.col("opens"), F.col("row_idx"))
    begin_row = F.when(_begins(series), F.col("row_idx"))
    before = within_slice(series).rowsBetween(Window.unboundedPreceding, -1)
    after = within_slice(series, backward=True).rowsBetween(Window.unboundedPreceding, -1)
    up_to = within_slice(series).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down_to = within_slice(series, backward=True).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    row = F.col("row_idx")
    marked = joined.withColumns(
        {
            "prev_drop": F.coalesce(F.max(drop_row).over(before), F.col("drop_before")),
            "_instant_row": F.coalesce(F.max(begin_row).over(before), F.col("begin_before")),
            "late_shut": _begins(series) & (row > 0) & ~true("tuerkriterium"),
            "_open_gap_before": row - F.coalesce(F.max(open_row).over(up_to), F.min(row).over(up_to) - 1),
        }
    ).withColumns(
        {
            "next_drop": F.coalesce(F.min(drop_row).over(after), F.col("drop_beyond")),
            "_open_gap_after": F.coalesce(F.min(open_row).over(down_to), F.max(row).over(down_to) + 1) - row,
        }
    )
    return unsliced(marked.drop("drop_before", "drop_beyond", "begin_before"))


def _copies(marked: DataFrame, n: Column, reach: int) -> DataFrame:
    """One row per ping and drop whose window, or rescan interval, holds it."""
    row = F.col("row_idx")
    own = F.struct(
        F.when(F.col("is_drop"), row).otherwise(F.col("prev_drop")).alias("drop_row_idx"),
        # rows after the drop are past the lower bound anyway
        F.when(F.col("is_drop"), F.coalesce(F.col("prev_drop"), F.lit(-1))).otherwise(F.lit(-2)).alias("bound"),
    )
    following = F.struct(
        F.when(~F.col("is_drop"), F.col("next_drop")).alias("drop_row_idx"),
        F.coalesce(F.col("prev_drop"), F.lit(-1)).alias("bound"),
    )
    spread = marked.withColumn("n", n).withColumn("_copy", F.explode(F.array(own, following)))
    spread = spread.select("*", "_copy.*").drop("_copy").filter("drop_row_idx is not null")
    near = F.abs(row - F.col("drop_row_idx")) <= F.col("n")
    turns = F.col("opens") | F.col("shuts")
    # the instants that reach into the window are as many as its rows, so these rows are one more at most
    after_near = F.col("late_shut") & (F.col("_instant_row") <= F.col("drop_row_idx") + F.col("n")) & (row > F.col("drop_row_idx") - F.col("n"))
    spread = spread.withColumns({"near": near, "after_near": after_near}).filter(F.col("near") | turns | F.col("after_near"))
    lower = F.greatest(F.lit(0), F.col("drop_row_idx") - F.col("n"), F.col("bound") + 1)
    opening_inside = F.col("near") & F.col("opens") & (row > lower)
    # Rows that may lie between two openings of one window; a superset is
    # enough, for the fold below starts and ends at openings.
    between = F.col("near") & (F.col("_open_gap_before") <= reach) & (F.col("_open_gap_after") <= reach)
    return spread.withColumns(
        {
            "opening": opening_inside,
            "closing": F.col("near") & F.col("closes") & (row > lower),
            # the repair step sees no transition into the first row after the previous drop
            "reopening": F.col("opens") & (row > F.col("bound") + 1),
            "between": between,
        }
    )


def _is_true_multi_door(steps: Column, pair_drop: float, growth_limit: float) -> Column:
    """True if the distance neither falls nor grows much between successive openings."""
    start = F.struct(
        F.lit(False).alias("bad"),
        F.lit(False).alias("pending"),
        F.lit(None).cast("double").alias("low"),
        F.lit(None).cast("double").alias("high"),
    )

    def step(state: Column, ping: Column) -> Column:
        value = ping["distanz"]
        started = state["low"].isNotNull()
        low = F.least(state["low"], value)
        high = F.greatest(state["high"], value)
        pending = state["pending"] | F.coalesce(ping["delta"] < pair_drop, F.lit(False))
        closed = state["bad"] | pending | (high - low >= growth_limit)
        return (
            F.when(
                ping["opening"],
                F.struct(
                    F.when(started, closed).otherwise(F.lit(False)).alias("bad"),
                    F.lit(False).alias("pending"),
                    value.alias("low"),
                    value.alias("high"),
                ),
            )
            .when(
                started,
                F.struct(state["bad"].alias("bad"), pending.alias("pending"), low.alias("low"), high.alias("high")),
            )
            .otherwise(state)
        )

    return ~F.aggregate(F.array_sort(steps), start, step)["bad"]


def classify(opened: Column, near_drop: Column, true_multi: Column) -> Column:
    """Three-way stop status."""
    return (
        F.when((opened == 0) & ~near_drop, "no_door").when((opened >= 2) & true_multi, "multi_door").otherwise("normal")
    )


EVENT_COLUMNS = (
    "drop_row_idx",
    "drop_time",
    "linie",
    "window_lo",
    "window_hi",
    "arrival_time",
    "departure_time",
    "stop_status",
    "door_open_count",
    "door_close_count",
    "door_near_drop",
    "is_true_multi_door",
    "delta_at_drop",
    "min_distanz",
    "max_distanz",
)


def detect_stop_events(
    pings: DataFrame,
    drop_threshold: float = DROP_THRESHOLD,
    n_min: int = 3,
    n_max: int = 10,
    n_default: int = 5,
    pair_drop: float = -30,
    series: Series = PING_SERIES,
    carry: Sequence[str] = (),
    keep_rescan: bool = False,
) -> DataFrame:
    """One row per stop event.

    ``carry`` names ping columns to take over from the drop row, which saves
    the later join by (vehicle, row).  ``keep_rescan`` keeps what the repair
    step needs (first opening and last closing between the neighbouring drops,
    and the first closed door after the arrival's instant),
    so that detection and repair share one pass over the pings.
    """
    n = window_size(row_intervals(pings, drop_threshold, series), n_min, n_max, n_default)
    used = [*series.keys, *series.order, "distanz", "tuerkriterium", "linie", "fahrt_id", *carry]
    marked = mark_drops(pings.select(*dict.fromkeys(used)), drop_threshold, series)
    spread = _copies(marked, n.scalar(), reach=2 * n_max)

    row, time = F.col("row_idx"), F.col(series.time)
    at_drop = row == F.col("drop_row_idx")
    near = F.col("near")

    def of_drop(column: str | Column) -> Column:
        return F.max(F.when(at_drop, column if isinstance(column, Column) else F.col(column)))

    near_drop = F.coalesce(F.col("door_before"), F.lit(False)) | F.coalesce(
        F.col("tuerkriterium"), F.lit(False)
    ) | F.coalesce(F.col("door_after"), F.lit(False))
    step = F.struct("row_idx", F.col("distanz").cast("double").alias("distanz"), F.col("delta").cast("double").alias("delta"), "opening")
    grouped = spread.groupBy(*series.keys, "drop_row_idx").agg(
        of_drop(series.time).alias("drop_time"),
        F.min(F.when(near, row)).alias("window_lo"),
        F.max(F.when(near, row)).alias("window_hi"),
        F.count(F.when(F.col("opening"), 1)).alias("door_open_count"),
        F.count(F.when(F.col("closing"), 1)).alias("door_close_count"),
        F.min(F.when(F.col("opening"), row)).alias("_open_row"),
        F.min(F.when(F.col("opening"), time)).alias("_open_time"),
        F.max(F.when(F.col("closing"), row)).alias("_close_row"),
        F.max(F.when(F.col("closing"), time)).alias("_close_time"),
        of_drop(near_drop).alias("door_near_drop"),
        of_drop("delta").alias("delta_at_drop"),
        F.min(F.when(near, F.col("distanz"))).alias("min_distanz"),
        F.max(F.when(near, F.col("distanz"))).alias("max_distanz"),
        F.min(F.when(near, F.col("fahrt_id"))).alias("_trip_lo"),
        F.max(F.when(near, F.col("fahrt_id"))).alias("_trip_hi"),
        F.count(F.when(near & F.col("fahrt_id").isNull(), 1)).alias("_trip_missing"),
        F.collect_list(F.when(F.col("between"), step)).alias("_steps"),
        F.min(F.when(F.col("reopening"), time)).alias("rescan_open"),
        F.max(F.when(F.col("shuts"), time)).alias("rescan_close"),
        F.collect_list(F.when(F.col("after_near"), F.struct(F.col("_time_before").alias("instant"), time.alias("shut")))).alias("_late"),
        *[of_drop(c).alias(c) for c in dict.fromkeys(["linie", *carry])],
    )
    same_trip = F.when(F.col("_trip_lo").isNull(), F.lit(True)).otherwise(
        (F.col("_trip_lo") == F.col("_trip_hi")) & (F.col("_trip_missing") == 0)
    )
    arrival = F.coalesce("_open_time", "drop_time")
    departure = F.when(F.col("_close_row") > F.col("_open_row"), F.col("_close_time")).otherwise(arrival)
    events = grouped.withColumns(
        {
            "arrival_time": arrival,
            "departure_time": departure,
            "is_true_multi_door": F.when(
                (F.col("door_open_count") >= 2) & same_trip,
                _is_true_multi_door(F.col("_steps"), pair_drop, drop_threshold),
            ).otherwise(F.lit(False)),
        }
    ).withColumn(
        "stop_status", classify(F.col("door_open_count"), F.col("door_near_drop"), F.col("is_true_multi_door"))
    )
    events = events.withColumn("late_close", F.get(F.filter("_late", lambda x: x["instant"] == F.col("arrival_time")), F.lit(0))["shut"])
    extra = [c for c in carry if c not in EVENT_COLUMNS and c not in series.keys]
    rescan = ["rescan_open", "rescan_close", "late_close"] if keep_rescan else []
    return events.select(*series.keys, *EVENT_COLUMNS, *extra, *rescan)


def stop_changed(indexed: DataFrame, stop_col: str = "ort_nr_start", series: Series = PING_SERIES) -> DataFrame:
    """Flag rows whose stop differs from the row before; row 0 is false, a NULL on either side gives NULL."""
    linked = neighbours(indexed, series, lag={"_stop": stop_col})
    return linked.withColumn(
        "ort_changed", F.when(F.col("row_idx") == 0, F.lit(False)).otherwise(F.col(stop_col) != F.col("_stop"))
    ).drop("_stop")


def filter_stop_changed(
    events: DataFrame,
    pings: DataFrame,
    stop_col: str = "ort_nr_start",
    end_col: str = "ort_nr_ziel",
    series: Series = PING_SERIES,
) -> DataFrame:
    """Keep events whose drop row also changes the stop; adds ``ort_nr_end``."""
    used = dict.fromkeys([*series.keys, *series.order, stop_col, end_col])
    linked = neighbours(pings.select(*used), series, lag={"_stop": stop_col}, index="row_idx")
    changed = linked.filter((F.col("row_idx") > 0) & (F.col(stop_col) != F.col("_stop"))).select(
        *series.keys, F.col("row_idx").alias("drop_row_idx"), F.col(end_col).alias("ort_nr_end")
    )
    return events.join(changed, [*series.keys, "drop_row_idx"])


def drop_segments(pings: DataFrame, drop_threshold: float = DROP_THRESHOLD, series: Series = PING_SERIES) -> DataFrame:
    """Indexed pings with the running number of drops; rows before any distance step have none."""
    indexed = index_pings(pings, series, keep_slices=True)
    fall = F.when(F.col("delta") < -drop_threshold, 1).otherwise(0)
    counted = running(indexed, series, sums={"drop_segment": fall})
    # a row without a step has no flag to count
    return counted.withColumn("drop_segment", F.when(F.col("delta").isNotNull(), F.col("drop_segment")))
