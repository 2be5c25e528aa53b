"""Data quality of the ping feed: duplicates, missing values and gaps, noise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haltwerk.functions.ordered import Series, neighbours
from haltwerk.functions.scalars import all_present, share, whole_seconds_between
from haltwerk.functions.stats import null_rates

TRIP_SERIES = Series(keys=("fahrt_id",), time="tst_iso")

# fixed values: columns by importance
FIELD_GROUPS = {
    "core": ("distanz", "tuerkriterium", "fahrt_id", "ort_nr_start"),
    "analysis": ("lage", "besetztgrad", "pos_lat", "pos_lon"),
    "secondary": ("linie_text", "zieltext", "status_text"),
    "ignore": ("topic", "qos", "retain", "payloadlen"),
}
# fixed values: status texts
ON_SCHEDULE = "planm"
BAD_STATUSES = ("posUnklar", "ohneFahrt", "keinFunk")
NOISE = ("n1", "n2", "n3", "n4", "n5", "n6")


# -- duplicates ---------------------------------------------------------------


def hard_duplicates(df: DataFrame) -> DataFrame:
    """Rows that have an identical twin (all of them), and their rate."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    return groups.agg(
        F.coalesce(F.sum("_c"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col("_c") > 1, F.col("_c"))), F.lit(0)).alias("hard_dup_count"),
    ).withColumn("hard_dup_rate", F.round(share(F.col("hard_dup_count"), F.col("total_rows")), 6))


def soft_duplicates(df: DataFrame, keys: Sequence[str] = ("fzg_id", "tst_iso")) -> DataFrame:
    """Rows beyond the first per key, keys that repeat, and the rate."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    return groups.agg(
        F.coalesce(F.sum("_c"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("soft_dup_extra_rows"),
        F.count(F.when(F.col("_c") > 1, 1)).alias("soft_dup_affected_groups"),
    ).withColumn("soft_dup_rate", F.round(share(F.col("soft_dup_extra_rows"), F.col("total_rows")), 6))


def soft_dup_rows(df: DataFrame, keys: Sequence[str] = ("fzg_id", "tst_iso")) -> DataFrame:
    """All rows whose key repeats."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").drop("_c")
    return df.join(repeated, list(keys), "left_semi")


def soft_dup_by_line(
    df: DataFrame, keys: Sequence[str] = ("fzg_id", "tst_iso"), line_col: str = "linie"
) -> DataFrame:
    """Rows with a repeated key per line, with the line's rows and rate.

    Counts per (key, line) are compared with the count of their key; the rows
    themselves are never joined back.  A repeated NULL key joins nothing and so
    is not counted.
    """
    per_line = df.groupBy(*keys, line_col).agg(F.count(F.lit(1)).alias("_c"))
    in_key = F.sum("_c").over(Window.partitionBy(*keys))
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    repeated = per_line.withColumn("_rep", (in_key > 1) & keyed)
    return (
        repeated.groupBy(line_col)
        .agg(
            F.coalesce(F.sum(F.when(F.col("_rep"), F.col("_c"))), F.lit(0)).alias("soft_dup_rows"),
            F.sum("_c").alias("total_rows"),
        )
        .filter("soft_dup_rows > 0")
        .withColumn("soft_dup_rate", share(F.col("soft_dup_rows"), F.col("total_rows")))
    )


# -- missing values -----------------------------------------------------------


def field_missing(df: DataFrame, groups: Mapping[str, Sequence[str]] = FIELD_GROUPS) -> DataFrame:
    """Null count and rate per column with its group; absent columns are skipped."""
    group_of = {c: g for g, columns in groups.items() for c in columns if c in df.columns}
    label = F.coalesce(*[F.when(F.col("column") == c, F.lit(g)) for c, g in group_of.items()])
    return null_rates(df, list(group_of)).select(
        "column", label.alias("group"), "null_count", F.round("null_rate", 6).alias("null_rate")
    )


def core_completeness(df: DataFrame, columns: Sequence[str] = FIELD_GROUPS["core"]) -> DataFrame:
    """Share of rows in which every core field is present; one row."""
    present = [c for c in columns if c in df.columns]
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count(F.when(all_present(present), 1)).alias("complete_rows")
    ).withColumn("core_completeness_rate", F.round(share(F.col("complete_rows"), F.col("total_rows")), 6))


def missing_by_line(
    df: DataFrame, columns: Sequence[str] = FIELD_GROUPS["core"], line_col: str = "linie"
) -> DataFrame:
    """Null rate of each core field per line."""
    present = [c for c in columns if c in df.columns]
    return df.groupBy(line_col).agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.avg(F.col(c).isNull().cast("int")).alias(f"{c}_null_rate") for c in present],
    )


def sampling_intervals(df: DataFrame, series: Series = TRIP_SERIES) -> DataFrame:
    """Whole seconds since the previous ping of the trip, NULL on its first."""
    linked = neighbours(df, series, lag={"_prev_time": series.time})
    return linked.withColumn("gap_sec", whole_seconds_between(series.time, "_prev_time")).drop("_prev_time")


def trip_gaps(df: DataFrame, gap_threshold_sec: int = 30, series: Series = TRIP_SERIES) -> DataFrame:
    """Pings that follow a gap longer than the threshold."""
    return sampling_intervals(df, series).filter(F.col("gap_sec") > gap_threshold_sec)


def gap_summary(df: DataFrame, gap_threshold_sec: int = 30, series: Series = TRIP_SERIES) -> DataFrame:
    """Gaps, their rate and affected trips; one row.

    Trips are reduced to distinct ones before they are counted.
    """
    spaced = sampling_intervals(df.select(*series.keys, *series.order), series)
    per_trip = spaced.groupBy(*series.keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("gap_sec") > gap_threshold_sec, 1)).alias("gaps")
    )
    return per_trip.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("gaps"), F.lit(0)).alias("trip_gap_count"),
        F.count(F.when(F.col("gaps") > 0, 1)).alias("affected_trips"),
    ).withColumn("trip_gap_rate", F.round(share(F.col("trip_gap_count"), F.col("total_rows")), 6))


# -- noise --------------------------------------------------------------------


def point_flags() -> dict[str, Column]:
    """Noise tests that need one row only."""
    return {
        "n1": (F.col("pos_lat") == 0) | (F.col("pos_lon") == 0),
        "n5": (F.col("lage") == 0) & (F.col("status_text") != ON_SCHEDULE),
        "n6": F.col("status_text").isin(*BAD_STATUSES),
    }


def noise_flags(
    df: DataFrame, spike: float = 300, small_drop: float = 50, extreme: float = 900, series: Series = TRIP_SERIES
) -> DataFrame:
    """Six noise flags per ping, never NULL.

    n1 zero coordinate, n2 distance step above ``spike`` within the trip, n3
    fall from a value below ``small_drop``, n4 reported delay beyond
    ``extreme``, n5 zero delay although not on schedule, n6 unreliable status.
    """
    linked = neighbours(df, series, lag={"_distanz": "distanz"})
    step = F.col("distanz") - F.col("_distanz")
    flags = {
        **point_flags(),
        "n2": step > spike,
        # distance minus step is the distance before the fall
        "n3": (step < 0) & (F.col("distanz") - step < small_drop),
        "n4": F.abs(F.col("lage")) > extreme,
    }
    return linked.withColumns({n: F.coalesce(flags[n], F.lit(False)) for n in NOISE}).drop("_distanz")


def gps_zero(df: DataFrame) -> DataFrame:
    """Rows with a zero coordinate."""
    return df.filter(point_flags()["n1"])


def lage_extreme(df: DataFrame, extreme: float = 900) -> DataFrame:
    """Rows whose reported delay is beyond the limit."""
    return df.filter(F.abs(F.col("lage")) > extreme)


def default_zero_by_status(df: DataFrame) -> DataFrame:
    """Zero delays that are no on-schedule reading, per status."""
    return df.filter(point_flags()["n5"]).groupBy("status_text").agg(F.count(F.lit(1)).alias("count"))


def bad_status_by_status(df: DataFrame) -> DataFrame:
    """Rows of unreliable status, per status."""
    return df.filter(point_flags()["n6"]).groupBy("status_text").agg(F.count(F.lit(1)).alias("count"))


def noisy_union(flagged: DataFrame) -> DataFrame:
    """Counts per category, true union, and the largest category; one row."""
    any_noise = reduce(lambda a, b: a | b, [F.col(n) for n in NOISE])
    counted = flagged.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count(F.when(F.col(n), 1)).alias(f"{n}_count") for n in NOISE],
        F.count(F.when(any_noise, 1)).alias("noisy_union_count"),
    )
    return counted.withColumns(
        {
            "noisy_union_legacy": F.greatest(*[F.col(f"{n}_count") for n in NOISE]),
            "noisy_union_rate": F.round(share(F.col("noisy_union_count"), F.col("total_rows")), 6),
        }
    )


def noisy_by_line(flagged: DataFrame, line_col: str = "linie", include_n3: bool = False) -> DataFrame:
    """Counts per line and category; ``any`` leaves n3 out unless asked for."""
    counted = [n for n in NOISE if include_n3 or n != "n3"]
    any_noise = reduce(lambda a, b: a | b, [F.col(n) for n in counted])
    return (
        flagged.groupBy(line_col)
        .agg(
            F.count(F.lit(1)).alias("total_rows"),
            *[F.count(F.when(F.col(n), 1)).alias(f"{n}_count") for n in NOISE],
            F.count(F.when(any_noise, 1)).alias("any_noisy_count"),
        )
        .withColumn("noisy_rate", share(F.col("any_noisy_count"), F.col("total_rows")))
    )


# -- summary documents --------------------------------------------------------

LONGEST = 100  # entries of a document's list


def _heaviest(frame: DataFrame, by: str, label: str, columns: Sequence[str], longest: int) -> Column:
    """The entries with the largest ``by`` as one list, in that order; ties go by label.

    Entries are groups, counted in parallel; each task passes on its ``longest``
    heaviest ones, so the list is bounded whatever the number of groups.  Whole
    lists are tables: see the functions that make them.
    """
    top = frame.orderBy(F.desc(by), F.asc(label)).limit(longest)
    entry = F.struct((-F.col(by)).alias("_least"), *dict.fromkeys([label, *columns]))
    listed = F.array_sort(F.collect_list(entry))
    fields = list(dict.fromkeys([label, *columns]))
    return top.agg(F.transform(listed, lambda e: F.struct(*[e[c].alias(c) for c in fields])).alias("l")).scalar()


def redundant_summary(
    df: DataFrame, keys: Sequence[str] = ("fzg_id", "tst_iso"), line_col: str = "linie", longest: int = LONGEST
) -> DataFrame:
    """Duplicate report as one nested row; it lists the lines with the most repeated rows, ``longest`` at most."""
    lines = soft_dup_by_line(df, keys, line_col)
    hard = hard_duplicates(df)
    return soft_duplicates(df, keys).withColumns(
        {
            "hard_dup_count": hard.select("hard_dup_count").scalar(),
            "hard_dup_rate": hard.select("hard_dup_rate").scalar(),
            "soft_dup_by_line": _heaviest(lines, "soft_dup_rows", line_col, ["soft_dup_rows", "total_rows", "soft_dup_rate"], longest),
        }
    )


def missing_summary(
    df: DataFrame,
    groups: Mapping[str, Sequence[str]] = FIELD_GROUPS,
    gap_threshold_sec: int = 30,
    series: Series = TRIP_SERIES,
    longest: int = LONGEST,
) -> DataFrame:
    """Missing-data report as one nested row; it lists all fields, and the lines with the most rows, ``longest`` at most."""
    fields = field_missing(df, groups).agg(
        F.sort_array(F.collect_list(F.struct("group", "column", "null_count", "null_rate"))).alias("l")
    )  # one entry per column
    by_line = missing_by_line(df, groups["core"])
    rates = [c for c in by_line.columns if c != "linie"]
    return gap_summary(df, gap_threshold_sec, series).withColumns(
        {
            "core_completeness_rate": core_completeness(df, groups["core"]).select("core_completeness_rate").scalar(),
            "field_missing": fields.scalar(),
            "missing_by_line": _heaviest(by_line, "total_rows", "linie", rates, longest),
        }
    )


def zero_vehicles(df: DataFrame) -> DataFrame:
    """Vehicles with a zero coordinate."""
    return gps_zero(df).select("fzg_id").distinct()


def noisy_summary(
    df: DataFrame,
    spike: float = 300,
    small_drop: float = 50,
    extreme: float = 900,
    series: Series = TRIP_SERIES,
    longest: int = LONGEST,
) -> DataFrame:
    """Noise report as one nested row; its lists hold the statuses and lines with the most noise, ``longest`` at most.

    Affected vehicles are counted; :func:`zero_vehicles` lists them as a table.
    """
    flagged = noise_flags(df, spike, small_drop, extreme, series)
    lines = noisy_by_line(flagged)
    return noisy_union(flagged).withColumns(
        {
            "n1_affected_vehicles": zero_vehicles(df).agg(F.count(F.lit(1))).scalar(),
            "n5_by_status": _heaviest(default_zero_by_status(df), "count", "status_text", ["count"], longest),
            "n6_by_status": _heaviest(bad_status_by_status(df), "count", "status_text", ["count"], longest),
            "noisy_by_line": _heaviest(lines, "any_noisy_count", "linie", lines.columns, longest),
        }
    )


def summary_rows(document: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """A document's numbers in long form: measure, label, value.  ``labels`` names the label field of each list."""
    plain = [c for c in document.columns if c not in labels]
    whole = F.array(*[F.struct(F.lit(c).alias("measure"), F.lit("").alias("label"), F.col(c).cast("double").alias("value")) for c in plain])
    parts = [document.select(F.inline(whole))]
    for name, label in labels.items():
        entries = document.select(F.explode(name).alias("e")).select("e.*")
        numbers = [c for c, kind in entries.dtypes if c != label and kind != "string"]
        cells = F.array(
            *[F.struct(F.lit(f"{name}.{c}").alias("measure"), F.col(label).cast("string").alias("label"), F.col(c).cast("double").alias("value")) for c in numbers]
        )
        parts.append(entries.select(F.inline(cells)))
    return reduce(DataFrame.unionByName, parts)
