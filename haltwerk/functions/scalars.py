"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def seconds_between(later: str | Column, earlier: str | Column) -> Column:
    """Exact difference in seconds, taken on whole microseconds."""
    return (F.unix_micros(as_column(later)) - F.unix_micros(as_column(earlier))) / F.lit(1_000_000.0)


def whole_seconds_between(later: str | Column, earlier: str | Column) -> Column:
    """Difference cut to whole seconds, toward zero."""
    micros = F.unix_micros(as_column(later)) - F.unix_micros(as_column(earlier))
    return F.when(micros >= 0, F.floor(micros / 1_000_000)).otherwise(F.ceil(micros / 1_000_000)).cast("long")


def service_date(moment: str | Column, cutoff_hours: int = 4) -> Column:
    """Calendar day after moving the day change to ``cutoff_hours``."""
    return F.to_date(as_column(moment) - F.expr(f"INTERVAL {int(cutoff_hours)} HOURS"))


def local_time(moment: str | Column, tz: str) -> Column:
    return as_column(moment) if tz == "UTC" else F.from_utc_timestamp(as_column(moment), tz)


def iso_weekday(moment: str | Column) -> Column:
    """Monday = 1 … Sunday = 7."""
    return F.weekday(as_column(moment)) + 1


def clip(value: str | Column, low: float, high: float) -> Column:
    """Clip to bounds; NULL stays NULL (``least``/``greatest`` would skip it)."""
    v = as_column(value)
    return F.when(v < low, F.lit(float(low))).when(v > high, F.lit(float(high))).otherwise(v.cast("double"))


def true(value: str | Column) -> Column:
    return as_column(value).eqNullSafe(F.lit(True))


def false(value: str | Column) -> Column:
    return as_column(value).eqNullSafe(F.lit(False))


def all_present(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns], F.lit(True))


def share(part: Column, whole: Column) -> Column:
    """Ratio, NULL when the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def haversine_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column, radius: float = EARTH_RADIUS_M) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.radians(lat_b - lat_a) / 2
    half_lon = F.radians(lon_b - lon_a) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(half_lon), 2)
    return 2 * radius * F.asin(F.sqrt(chord))


def status_code(status: str | Column) -> Column:
    """Stop status as a number."""
    s = as_column(status)
    # fixed values: normal 0, multi_door 1, no_door 2
    return (
        F.when(s == "normal", 0).when(s == "multi_door", 1).when(s == "no_door", 2).otherwise(F.lit(None)).cast("tinyint")
    )
