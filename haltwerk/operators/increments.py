"""Stop events of new pings, without reading the old ones again.

A run leaves a *state* behind: per vehicle the pings from the last drop but one
on, each with its row number.  The next run reads the state and the new pings
only.  A drop's event is final once a later drop of its vehicle is known; the
last drop of a vehicle is open, and its event is given out again, with all its
pings, by the run that closes it.  Final events of all runs and the open ones of
the last run are the events of all pings at once.

The state holds what two stops of each vehicle need, whatever the history; for
a vehicle without two drops yet it holds all its pings.  New pings must come
after those of their vehicle's state in the series' order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltwerk.functions.ordered import Series
from haltwerk.operators.detect import DROP_THRESHOLD, PING_SERIES, detect_stop_events, drop_intervals, index_pings

BASE, DONE = "_base", "_done"  # row number of a vehicle's first ping in the state; its last final drop


def _match(left: str, right: str, keys: Sequence[str]) -> list:
    return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]


def _with_offsets(rows: DataFrame, state: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Rows with the first row number and the last final drop of their vehicle's state."""
    if state is None:
        return rows.withColumns({BASE: F.lit(0).cast("long"), DONE: F.lit(-1).cast("long")})
    known = state.groupBy(*keys).agg(F.min("row_idx").alias(BASE), F.max(DONE).alias(DONE))  # a row per vehicle
    joined = rows.alias("r").join(known.alias("k"), _match("r", "k", keys), "left")
    return joined.select("r.*", F.coalesce(BASE, F.lit(0)).alias(BASE), F.coalesce(DONE, F.lit(-1)).alias(DONE))


def joined_pings(new: DataFrame, state: DataFrame | None) -> DataFrame:
    """The pings a run works on."""
    return new if state is None else state.select(*new.columns).unionByName(new)


def last_drops(pings: DataFrame, drop_threshold: float = DROP_THRESHOLD, series: Series = PING_SERIES) -> DataFrame:
    """Per vehicle its last drop and the one before, by row number within ``pings``."""
    falls = drop_intervals(pings, drop_threshold, series)
    return falls.groupBy(*series.keys).agg(F.max("row_idx").alias("last_drop"), F.max_by("prev_drop", "row_idx").alias("drop_before_last"))


def increment_events(
    new: DataFrame,
    state: DataFrame | None,
    n: int,
    drop_threshold: float = DROP_THRESHOLD,
    series: Series = PING_SERIES,
    carry: Sequence[str] = (),
    keep_rescan: bool = False,
) -> DataFrame:
    """Events of the state's open drops and of new ones, with ``is_final``; row numbers are those of the whole history.

    ``n`` is the window size; it is given, as a size that followed the data
    would change events of the past.
    """
    pings = joined_pings(new, state)
    found = detect_stop_events(pings, drop_threshold, n, n, n, series=series, carry=carry, keep_rescan=keep_rescan)
    last = last_drops(pings, drop_threshold, series).select(*series.keys, "last_drop")
    marked = found.alias("e").join(last.alias("d"), _match("e", "d", series.keys), "left").select("e.*", (F.col("drop_row_idx") < F.col("last_drop")).alias("is_final"))
    placed = _with_offsets(marked, state, series.keys)
    rows = {c: F.col(c) + F.col(BASE) for c in ("drop_row_idx", "window_lo", "window_hi")}
    return placed.withColumns(rows).filter(F.col("drop_row_idx") > F.col(DONE)).drop(BASE, DONE)


def next_state(new: DataFrame, state: DataFrame | None, drop_threshold: float = DROP_THRESHOLD, series: Series = PING_SERIES) -> DataFrame:
    """What the run after this one needs: pings with ``row_idx`` and the last final drop.

    The row before the last drop but one is kept too, as a drop shows by its fall.
    """
    pings = joined_pings(new, state)
    indexed = index_pings(pings, series).select(*new.columns, "row_idx")
    last = last_drops(pings, drop_threshold, series)
    kept = indexed.alias("p").join(last.alias("d"), _match("p", "d", series.keys), "left")
    kept = kept.filter(F.col("row_idx") >= F.coalesce(F.col("drop_before_last") - 1, F.lit(0))).select("p.*", "drop_before_last")
    placed = _with_offsets(kept, state, series.keys)
    done = F.greatest(F.col(DONE), F.col("drop_before_last") + F.col(BASE))
    return placed.withColumns({"row_idx": F.col("row_idx") + F.col(BASE), DONE: done}).drop(BASE, "drop_before_last")
