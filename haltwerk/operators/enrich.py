"""Weather, vehicles, special days and stop names joined to stop events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haltwerk.functions.ordered import Series, keep_first, neighbours, running, spread_hot

# fixed values: columns of the station file, sentinel of a missing reading
WEATHER_COLUMNS = ("TMK", "TXK", "TNK", "TGK", "RSK", "RSKF", "SDK", "SHK_TAG", "FM")
WEATHER_MISSING = -999.0
VEHICLE_COLUMNS = ("fahrzueg_type", "fahrgasttüren", "länge_m", "sitzplätze", "stehplätze", "kapazitaet")


def strip_names(df: DataFrame) -> DataFrame:
    """Trim blanks from column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def clean_weather(raw: DataFrame, missing: float = WEATHER_MISSING) -> DataFrame:
    """Station text to dates and numbers; the sentinel becomes NULL."""
    df = strip_names(raw)

    def number(name: str) -> Column:
        value = F.trim(F.col(name).cast("string")).try_cast("double")
        return F.nullif(value, F.lit(float(missing))).alias(name)

    day = F.to_date(F.trim(F.col("MESS_DATUM").cast("string")), "yyyyMMdd").alias("MESS_DATUM")
    return df.select(day, *[number(c) for c in WEATHER_COLUMNS])


def join_weather(core: DataFrame, weather: DataFrame) -> DataFrame:
    """Weather of the arrival's date; events without a reading keep NULLs."""
    dated = core.withColumn("MESS_DATUM", F.to_date("arrival_time"))
    return dated.join(weather, "MESS_DATUM", "left").drop("MESS_DATUM")


def vehicle_number(text: str | Column) -> Column:
    """Number to look a vehicle up by.

    Only digits count.  Numbers that begin with 232 use digits 3 to 6, all
    others the first six.
    """
    digits = F.regexp_replace(F.col(text) if isinstance(text, str) else text, "[^0-9]", "")
    part = F.when(digits.startswith("232"), F.substring(digits, 3, 4)).otherwise(F.substring(digits, 1, 6))
    return part.try_cast("long")


def is_numeric_type(typ: str = "typ") -> Column:
    return F.col(typ).rlike("^[0-9]+$")


def real_vehicles(vehicles: DataFrame) -> DataFrame:
    """Rows with a named (not all-digit) type and a vehicle number."""
    return vehicles.filter(F.col("typ").isNotNull() & ~is_numeric_type() & F.col("fzg_nr").isNotNull())


_POINTS = Series(keys=("_all",), time="_at", ties=("_tie",))


def _at(value: Column) -> Column:
    """A whole number as an instant, the order that series know."""
    return F.timestamp_micros(value.cast("long"))


def elementary_intervals(ranges: DataFrame, lo: str, hi: str, rows_per_slice: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """The intervals between the sorted ends of all ranges, and which ranges cover them.

    Returns the ends (``_at``, ``_no`` from 0: the interval that begins there)
    and the ranges, each once per interval it covers (with ``_no``).  A range
    covers its intervals as a whole, so a number's ranges are those of its
    interval.
    """
    valid = ranges.filter(F.col(lo) <= F.col(hi))
    ends = valid.select(F.explode(F.array(F.col(lo).cast("long"), F.col(hi).cast("long") + 1)).alias("_end")).distinct()
    ends = ends.select("_end", _at(F.col("_end")).alias("_at"), F.lit(0).alias("_all"), F.lit(0).alias("_tie"))
    numbered = neighbours(ends, spread_hot(ends, _POINTS, rows_per_slice), index="_no").select("_end", "_at", "_no")
    first = numbered.select(F.col("_end").alias("_lo"), F.col("_no").alias("_first"))
    last = numbered.select(F.col("_end").alias("_hi"), F.col("_no").alias("_last"))
    placed = valid.join(first, F.col(lo) == F.col("_lo")).join(last, F.col(hi) + 1 == F.col("_hi"))
    covered = placed.withColumn("_no", F.explode(F.sequence(F.col("_first"), F.col("_last") - 1)))
    return numbered.drop("_end"), covered.drop("_lo", "_hi", "_first", "_last")


def range_lookup(
    df: DataFrame,
    key: str,
    ranges: DataFrame,
    lo: str,
    hi: str,
    how: str = "left",
    rows_per_slice: int = 200_000,
) -> DataFrame:
    """Rows joined with every integer range that holds their key; with ``left``, rows in no range have NULLs.

    Keys and the ends of the ranges are merged in order, which gives each row
    the elementary interval it lies in; one equi-join on the interval gives the
    ranges, and rows without any fall out of the same join.  No row is compared
    with a range that does not hold it, and none is copied before the join.  The
    merge is cut into slices of ``rows_per_slice`` rows.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is 'inner' or 'left'")
    ends, covered = elementary_intervals(ranges, lo, hi, rows_per_slice)
    spread = F.shiftrightunsigned(F.xxhash64(*[F.col(c) for c in df.columns]), 1)  # equal keys can be cut apart
    asked = df.withColumns({"_at": _at(F.col(key)), "_all": F.lit(0), "_tie": spread, "_asks": F.lit(True)})
    marks = ends.withColumns({"_all": F.lit(0), "_tie": F.lit(-1).cast("long"), "_asks": F.lit(False)})
    merged = asked.unionByName(marks, allowMissingColumns=True)
    cut = spread_hot(merged.select("_all", "_at", "_tie"), _POINTS, rows_per_slice)
    placed = running(merged, cut, latest={"_in": F.when(~F.col("_asks"), F.col("_no"))}).filter("_asks")
    inside = placed.withColumn("_in", F.when(F.col(key).isNotNull(), F.col("_in"))).drop("_at", "_all", "_tie", "_asks", "_no")
    return inside.join(covered, F.col("_in") == F.col("_no"), how).drop("_in", "_no")


def vehicle_info(vehicles: DataFrame, ranges: DataFrame) -> DataFrame:
    """One row per vehicle (and matching range) with seats, doors and capacity."""
    single = keep_first(real_vehicles(vehicles).select("fzg_id", "fzg_nr", "typ"), ["fzg_id"], ["fzg_nr", "typ"])
    numbered = single.withColumn("fzg_nr_int", vehicle_number("fzg_nr"))
    lookup = strip_names(ranges).select(
        F.col("fzg_nr_from").cast("long").alias("fzg_nr_from"),
        F.col("fzg_nr_to").cast("long").alias("fzg_nr_to"),
        *[c for c in VEHICLE_COLUMNS if c != "kapazitaet"],
        (F.col("sitzplätze") + F.col("stehplätze")).alias("kapazitaet"),
    )
    found = range_lookup(numbered, "fzg_nr_int", lookup, "fzg_nr_from", "fzg_nr_to")
    return found.select("fzg_id", "fzg_nr", "fzg_nr_int", "typ", *VEHICLE_COLUMNS)


def join_vehicle_info(core: DataFrame, info: DataFrame) -> DataFrame:
    """Vehicle attributes by id."""
    columns = info.select(F.col("fzg_id").cast("long").alias("fzg_id"), *VEHICLE_COLUMNS)
    return core.join(columns, "fzg_id", "left")


def unmatched_vehicles(numbered: DataFrame, matched: DataFrame) -> DataFrame:
    """Vehicles whose id is not among the matched ones."""
    return numbered.join(matched.select("fzg_id").distinct(), "fzg_id", "left_anti")


def clean_special_days(raw: DataFrame) -> DataFrame:
    return raw.withColumn("date", F.to_date("date", "yyyy-MM-dd"))


def join_special_days(core: DataFrame, days: DataFrame, dedupe: bool = False) -> DataFrame:
    """Special days by arrival date with a flag.

    Two entries on one date duplicate the events of that date, unless
    ``dedupe`` keeps the first entry per date only.
    """
    if dedupe:
        days = keep_first(days, ["date"], ["event_id"])
    renamed = days.withColumnsRenamed(
        {"location": "event_location", "latitude": "event_latitude", "longitude": "event_longitude"}
    ).drop("event_id")
    dated = core.withColumn("date", F.to_date("arrival_time"))
    return dated.join(renamed, "date", "left").withColumn("has_special_event", F.col("event_type").isNotNull()).drop("date")


def stop_names(geometry: DataFrame) -> DataFrame:
    """One name per stop, the first in alphabetical order."""
    return geometry.groupBy("ort_nr").agg(F.min("stop_name").alias("stop_name"))


def vehicle_types(vehicles: DataFrame, keep: Column, by: Sequence[str] = ("typ", "typ_text")) -> DataFrame:
    """Number range and vehicles per type."""
    cleaned = F.regexp_replace("fzg_nr", " ", "")
    return (
        vehicles.filter(keep)
        .groupBy(*by)
        .agg(
            F.min(cleaned).alias("fzg_nr_min"),
            F.max(cleaned).alias("fzg_nr_max"),
            F.count_distinct("fzg_id").alias("num_vehicles"),
        )
    )


def vehicle_type_attributes(vehicles: DataFrame) -> DataFrame:
    """Vehicles and attributes per named type; attributes of the lowest vehicle id."""
    named = vehicles.filter(~is_numeric_type() & F.col("typ").isNotNull())
    first = {c: F.min_by(c, "fzg_id").alias(c) for c in ("kapazitaet", "laenge", "masse") if c in vehicles.columns}
    return named.groupBy("typ", "typ_nr").agg(F.count_distinct("fzg_id").alias("num_vehicles"), *first.values())


def named_and_numeric(vehicles: DataFrame, named_pattern: str) -> DataFrame:
    """Numeric-type rows of vehicles that also appear under a named type."""
    named = vehicles.filter(F.col("typ").rlike(named_pattern)).select("fzg_id").distinct()
    return vehicles.filter(is_numeric_type()).join(named, "fzg_id", "left_semi")
