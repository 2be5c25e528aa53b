"""Repair of events whose arrival and departure coincide.

The search runs over the whole interval between the neighbouring drops.  The
first opening and the last closing there are plain conditional minima and
maxima, taken in the same pass as detection.  Pings may share an instant: an
event's door counts as open at the end of its arrival's instant, so a closed
door right after it is a closing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltwerk.functions.ordered import Series, neighbours
from haltwerk.operators.detect import DROP_THRESHOLD, PING_SERIES, mark_drops

EVENT_SERIES = Series(keys=("fzg_id",), time="drop_time", ties=("drop_row_idx",))


def drop_neighbours(events: DataFrame, series: Series = EVENT_SERIES) -> DataFrame:
    """Previous and next drop row of each event."""
    return neighbours(events, series, lag={"prev_drop": "drop_row_idx"}, lead={"next_drop": "drop_row_idx"})


def last_rows(pings: DataFrame, key: str = "fzg_id") -> DataFrame:
    """Last row number per vehicle."""
    return pings.groupBy(key).agg((F.count(F.lit(1)) - 1).alias("max_row"))


def rescue_cases(events: DataFrame) -> DataFrame:
    """Label events: 0 fine, 1 opening found but no closing, 2 no opening found."""
    needs = (F.col("stop_status") != "no_door") & (F.col("departure_time") == F.col("arrival_time"))
    case = (
        F.when(needs & (F.col("arrival_time") == F.col("drop_time")), 2)
        .when(needs & (F.col("arrival_time") != F.col("drop_time")), 1)
        .otherwise(0)
    )
    return events.withColumn("rescue_case", case)


def _spread(marked: DataFrame) -> DataFrame:
    """Rows to the drops before and after them."""
    own = F.struct(
        F.when(F.col("is_drop"), F.col("row_idx")).otherwise(F.col("prev_drop")).alias("drop_row_idx"),
        F.when(F.col("is_drop"), F.coalesce(F.col("prev_drop"), F.lit(-1))).otherwise(F.lit(-2)).alias("bound"),
    )
    following = F.struct(
        F.when(~F.col("is_drop"), F.col("next_drop")).alias("drop_row_idx"),
        F.coalesce(F.col("prev_drop"), F.lit(-1)).alias("bound"),
    )
    return marked.withColumn("_copy", F.explode(F.array(own, following))).select("*", "_copy.*").filter("drop_row_idx is not null")


def rescan(events: DataFrame, pings: DataFrame, drop_threshold: float = DROP_THRESHOLD, series: Series = PING_SERIES) -> DataFrame:
    """Events with the first opening and last closing between the drops around theirs, and the first closed door after their arrival's instant."""
    used = dict.fromkeys([*series.keys, *series.order, "distanz", "tuerkriterium"])
    spread = _spread(mark_drops(pings.select(*used), drop_threshold, series).filter("opens or shuts or late_shut"))
    reopening = F.col("opens") & (F.col("row_idx") > F.col("bound") + 1)
    keys = [*series.keys, "drop_row_idx"]
    turns = spread.groupBy(*keys).agg(
        F.min(F.when(reopening, F.col(series.time))).alias("rescan_open"),
        F.max(F.when(F.col("shuts"), F.col(series.time))).alias("rescan_close"),
    )
    late = spread.filter("late_shut").select(*keys, F.col("_time_before").alias("arrival_time"), F.col(series.time).alias("late_close"))
    return events.join(turns, keys, "left").join(late, [*keys, "arrival_time"], "left")


def patch(events: DataFrame) -> DataFrame:
    """Patched times and status from the case label and the rescan columns."""
    case, opened, closed = F.col("rescue_case"), F.col("rescan_open"), F.col("rescan_close")
    # the last closing after the arrival's instant; the door counts as open at that instant's end
    later = F.greatest(F.when(closed > F.col("arrival_time"), closed), F.col("late_close"))
    found_close = (case == 1) & later.isNotNull()
    reopened = (case == 2) & opened.isNotNull()
    doorless = (case == 2) & opened.isNull()
    return events.withColumns(
        {
            "arrival_time": F.when(reopened, opened).otherwise(F.col("arrival_time")),
            "departure_time": F.when(found_close, later)
            .when(reopened & (closed > opened), closed)
            .when(reopened, opened)
            .otherwise(F.col("departure_time")),
            "stop_status": F.when(doorless, "no_door").otherwise(F.col("stop_status")),
            "is_patched": F.coalesce(found_close | (case == 2), F.lit(False)),
        }
    )


def rescue_dwell_times(
    events: DataFrame,
    pings: DataFrame | None = None,
    drop_threshold: float = DROP_THRESHOLD,
    series: Series = PING_SERIES,
    keep_labels: bool = False,
) -> DataFrame:
    """Repair arrival, departure and status.

    Events that carry the rescan columns of detection need no second look at
    the pings; others are joined with :func:`rescan`.
    """
    if "rescan_open" not in events.columns:
        if pings is None:
            raise ValueError("pings are needed unless the events carry rescan columns")
        events = rescan(events, pings, drop_threshold, series)
    patched = patch(rescue_cases(events))
    return patched if keep_labels else patched.drop("rescue_case", "is_patched", "rescan_open", "rescan_close", "late_close")


def patch_merge(base: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Overwrite columns of the base with non-null values of an update table."""
    renamed = updates.select(*keys, *[F.col(c).alias(f"_u_{c}") for c in columns])
    merged = base.join(renamed, keys, "left")
    return merged.withColumns({c: F.coalesce(F.col(f"_u_{c}"), F.col(c)) for c in columns}).drop(
        *[f"_u_{c}" for c in columns]
    )


def rescue_counts(labelled: DataFrame) -> DataFrame:
    """Number of events per case and of patched events."""
    return labelled.agg(
        F.count(F.when(F.col("rescue_case") == 1, 1)).alias("case_1"),
        F.count(F.when(F.col("rescue_case") == 2, 1)).alias("case_2"),
        F.count(F.when(F.col("is_patched"), 1)).alias("patched"),
    )
