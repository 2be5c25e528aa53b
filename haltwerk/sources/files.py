"""Readers and writers for the files of the pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haltwerk.functions.ordered import Series, unsliced
from haltwerk.operators.detect import PING_SERIES, index_pings
from haltwerk.operators.enrich import clean_special_days, clean_weather, vehicle_info

# fixed values: lines of the regular network, and those run by tram
REGULAR_LINES = (
    1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12, 13, 47, 59, 60, 61, 62, 63, 64, 65, 66, 68, 70, 72, 73, 74, 77, 78, 79,
    80, 81, 84, 85, 86, 87, 88, 104, 106, 108, 112, 113, 162, 166, 477, 520, 521,
)
TRAM_LINES = (1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12, 13, 20)

TELEMETRY = (
    "fzg_id bigint, tst_iso timestamp, tst string, linie bigint, linie_text string, zieltext string,"
    " status_text string, fahrt_id bigint, ort_nr_start bigint, ort_nr_ziel bigint, ort_nr_start_vvo string,"
    " ort_nr_ziel_vvo string, distanz double, tuerkriterium boolean, lage bigint, besetztgrad bigint,"
    " pos_lat double, pos_lon double, topic string, qos int, retain boolean, payloadlen int"
)
TIMETABLE = "fahrt_id bigint, zp_abfahrt bigint, segmente string, tst_iso string"
VEHICLES = (
    "fzg_id bigint, fzg_nr string, typ string, typ_text string, typ_nr bigint, kapazitaet bigint, laenge double,"
    " masse double"
)
VEHICLE_RANGES = (
    "typ string, fzg_nr_from bigint, fzg_nr_to bigint, fahrzueg_type string, `fahrgasttüren` bigint,"
    " `länge_m` double, `sitzplätze` bigint, `stehplätze` bigint"
)
SPECIAL_DAYS = (
    "event_id bigint, date string, event_type string, location string, latitude double, longitude double"
)
STOP_GEOMETRY = "ort_nr bigint, stop_name string, lat double, lon double"


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def with_timestamps(pings: DataFrame, column: str = "tst_iso") -> DataFrame:
    """ISO text, or a timestamp without zone, to a timestamp."""
    return pings.withColumn(column, F.col(column).cast("timestamp"))


def load_telemetry(spark: SparkSession, path: str, series: Series = PING_SERIES) -> DataFrame:
    """Pings from Parquet, times parsed, rows numbered per vehicle from 0."""
    return unsliced(index_pings(with_timestamps(spark.read.parquet(path), series.time), series))


def read_csv(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """The named columns of a CSV with a header, whatever their order and whatever stands between them.

    The header line is read first; types come from ``schema`` by name, other
    columns are read as text and dropped.  A missing column raises, and so does
    a file of the folder whose header differs.
    """
    wanted = {f.name: f for f in T._parse_datatype_string(schema).fields}
    settings = {"header": True, "mode": "PERMISSIVE", **options}
    header = require_columns(spark.read.options(**settings).csv(path), list(wanted)).columns
    found = T.StructType([wanted.get(c, T.StructField(c, T.StringType())) for c in header])
    return spark.read.options(**settings, enforceSchema=False).schema(found).csv(path).select(*[f"`{c}`" for c in wanted])


def read_telemetry_csv(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry CSV, columns by name."""
    return read_csv(spark, path, TELEMETRY)


def load_timetable(spark: SparkSession, path: str) -> DataFrame:
    """Timetable CSV; the JSON stop list stands in one line, quoted with doubled quotes, so that files can be split."""
    return read_csv(spark, path, TIMETABLE, quote='"', escape='"')


def load_weather(spark: SparkSession, path: str, missing: float = -999.0) -> DataFrame:
    """Daily station file, ``;``-separated with padded headers and values."""
    raw = spark.read.options(header=True, sep=";", inferSchema=False).csv(path)
    return clean_weather(raw, missing)


def load_vehicle_info(spark: SparkSession, vehicle_path: str, lookup_path: str) -> DataFrame:
    return vehicle_info(read_csv(spark, vehicle_path, VEHICLES), read_csv(spark, lookup_path, VEHICLE_RANGES))


def load_special_days(spark: SparkSession, path: str) -> DataFrame:
    return clean_special_days(read_csv(spark, path, SPECIAL_DAYS))


def regular_lines(df: DataFrame, lines: Sequence[int] = REGULAR_LINES, line_col: str = "linie") -> DataFrame:
    """Pings of the given lines; the test reaches the file scan."""
    return df.filter(F.col(line_col).isin(*lines))


def week_slice(df: DataFrame, first: str, last: str, text_col: str = "tst") -> DataFrame:
    """Rows whose local date text lies between two dates, both included."""
    return df.filter(F.substring(text_col, 1, 10).between(first, last))


def outside_week(df: DataFrame, first: str, last: str, text_col: str = "tst") -> DataFrame:
    """Rows outside the dates, to audit a slice."""
    day = F.substring(text_col, 1, 10)
    return df.filter((day < first) | (day > last))


def mode_column(lines: Sequence[int] = TRAM_LINES, line_col: str = "linie") -> Column:
    return F.when(F.col(line_col).isin(*lines), "tram").when(F.col(line_col).isNotNull(), "bus")


def split_mode(df: DataFrame, tram_lines: Sequence[int] = TRAM_LINES, line_col: str = "linie") -> DataFrame:
    """Add the mode; rows without a line belong to neither."""
    return df.withColumn("mode", mode_column(tram_lines, line_col)).filter("mode is not null")


def write_modes(df: DataFrame, path: str, tram_lines: Sequence[int] = TRAM_LINES) -> None:
    """One Parquet folder per mode, from a single pass."""
    split_mode(df, tram_lines).write.mode("overwrite").partitionBy("mode").parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_summary_json(summary: DataFrame, path: str) -> None:
    """A one-row nested frame as a JSON document."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def write_clustered(df: DataFrame, table: str, path: str, keys: Sequence[str], order: Sequence[str], rows_per_bucket: int = 2_000_000, buckets: int | None = None) -> DataFrame:
    """A table bucketed by its keys and sorted by time in each bucket; returns it as read back.

    What runs by vehicle (row numbers, detection, gaps, noise, speed) reads such
    a table without an exchange.  The number of buckets follows the rows unless
    it is given; one task writes and reads one bucket.  ``table`` names it in the
    session's catalog, ``path`` holds the files.
    """
    if buckets is None:
        buckets = max(1, min(-(-df.count() // rows_per_bucket), 100_000))
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*keys, *order).saveAsTable(table)
    return df.sparkSession.table(table)
