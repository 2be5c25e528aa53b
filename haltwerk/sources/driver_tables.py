"""Telemetry, timetable, weather and vehicle views over the given tables.

The same definitions stand in SQL in ``haltwerk/plans/oracle.py``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haltwerk.functions.ordered import Series, spread_hot
from haltwerk.session import configure

# Keys with more rows than this are cut into slices.
HOT_ROWS = 2_000_000
# Trips of one task that builds the timetable: ids of a few bytes become lists of kilobytes, so sizes of shuffles say
# nothing about the rows behind them.
TRIPS_PER_TASK = 2_000


_SERIES: dict[tuple, Series] = {}
_TRIP_TASKS: dict[tuple, int] = {}


def _trip() -> Column:
    return F.col("user_id") * 10 + F.expr("(day(ts) - 1) div 10")


@dataclass(frozen=True)
class Tables:
    """The given tables as the views the operators read."""

    spark: SparkSession
    folder: str
    hot_rows: int = HOT_ROWS

    def __post_init__(self) -> None:
        configure(self.spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    def _spread(self, key: Column) -> Series:
        """Ping series by a key, its hot keys found in a scan of key and time."""
        narrow = self.events.select(key, F.col("ts").alias("tst_iso"), F.col("event_id").alias("ping_id"))
        series = Series(keys=tuple(narrow.columns[:1]), time="tst_iso", ties=("ping_id",))
        place = (self.spark.sparkContext.applicationId, self.folder, series.keys, self.hot_rows)
        if place not in _SERIES:  # a cut changes plans, never results, so an old one does no harm
            _SERIES[place] = spread_hot(narrow, series, self.hot_rows)
        return _SERIES[place]

    @property
    def pings(self) -> Series:
        return self._spread(F.col("user_id").alias("fzg_id"))

    @property
    def trips(self) -> Series:
        return self._spread(_trip().alias("fahrt_id"))

    @property
    def drops(self) -> Series:
        """Stop events by drop; a vehicle has fewer of them than pings, so its cut serves."""
        return self.pings.over("drop_time", "drop_row_idx")

    @property
    def arrivals(self) -> Series:
        return self.pings.over("arrival_time", "drop_row_idx")

    @property
    def telemetry(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("long")
        return self.events.withColumn("k", k).select(
            F.col("event_id").alias("ping_id"),
            F.col("user_id").alias("fzg_id"),
            F.col("ts").alias("tst_iso"),
            F.date_format(F.from_utc_timestamp("ts", "Europe/Berlin"), "yyyy-MM-dd HH:mm:ss").alias("tst"),
            F.col("value").alias("distanz"),
            F.col("event_type").isin("purchase", "click").alias("tuerkriterium"),
            (F.col("user_id") % 13).alias("linie"),
            _trip().alias("fahrt_id"),
            "k",
            (F.col("k") % 5).alias("ort_nr_start"),
            ((F.col("k") + 1) % 5).alias("ort_nr_ziel"),
            F.concat(F.lit("V"), (F.col("k") % 5).cast("string")).alias("ort_nr_start_vvo"),
            (F.floor(F.col("value") * 4) - 400).cast("long").alias("lage"),
            F.when(F.col("k") % 10 == 0, F.lit(-1)).otherwise(F.col("k") % 7).cast("long").alias("besetztgrad"),
            F.when(F.col("event_id") % 500 == 0, F.lit(0.0)).otherwise(51 + F.col("k") / 1000).alias("pos_lat"),
            (13.7 + F.col("value") / 10000).alias("pos_lon"),
            F.when(F.col("event_type") == "signup", "planm")
            .when(F.col("event_type") == "error", "posUnklar")
            .when(F.col("event_type") == "view", "ohneFahrt")
            .when(F.col("event_type") == "click", "vvo")
            .otherwise("dispo")
            .alias("status_text"),
            F.when(F.col("event_id") % 50 != 0, F.concat(F.lit("L"), (F.col("user_id") % 13).cast("string"))).alias(
                "linie_text"
            ),
        )

    @property
    def raw_timetable(self) -> DataFrame:
        """Two snapshots per trip seen in the telemetry; every 17th trip has an empty list."""
        trips = self.telemetry.select("fahrt_id").distinct()
        place = (self.spark.sparkContext.applicationId, type(self), self.folder)
        if place not in _TRIP_TASKS:  # the number changes plans, never results, so an old one does no harm
            _TRIP_TASKS[place] = max(1, -(-trips.count() // TRIPS_PER_TASK))
        snapshots = trips.repartition(_TRIP_TASKS[place], "fahrt_id").withColumn("_s", F.explode(F.array(F.lit(9000), F.lit(10800))))
        text = F.expr(
            "concat('[', array_join(transform(sequence(0, 79),"
            " i -> concat('{\"ort_nr\":', i % 4, ',\"lenkzeit\":', _s, '}')), ','), ']')"
        )
        return snapshots.select(
            "fahrt_id",
            (F.lit(1704067200) + (F.col("fahrt_id") % 10) * 864000).cast("long").alias("zp_abfahrt"),
            F.when(F.col("fahrt_id") % 17 == 0, "[]").otherwise(text).alias("segmente"),
            F.when(F.col("_s") == 9000, "2023-12-01T00:00:00.000Z")
            .otherwise("2023-12-15T06:30:00.500Z")
            .alias("tst_iso"),
        )

    @property
    def weather_text(self) -> DataFrame:
        """Daily station file text from the day's events: padded values, -999 where missing."""
        daily = self.events.groupBy(F.to_date("ts").alias("d")).agg(
            F.count(F.lit(1)).alias("n"), F.max("event_id").alias("top"), F.countDistinct("user_id").alias("users")
        )
        day = F.dayofmonth("d")

        def cell(value):
            return F.lpad(value.cast("decimal(12,1)").cast("string"), 8, " ")

        # the last days of a month are filed a century later, so that the feed has days without weather
        filed = F.when(day <= 25, F.col("d")).otherwise(F.add_months("d", 1200))
        return daily.select(
            F.lpad(F.date_format(filed, "yyyyMMdd"), 10, " ").alias(" MESS_DATUM"),
            F.when(day % 7 == 3, "    -999").otherwise(cell((F.col("n") % 300) / 10)).alias(" TMK"),
            cell((F.col("n") % 350) / 10).alias(" TXK"),
            cell((F.col("top") % 90) / 10).alias(" TNK"),
            cell((F.col("top") % 70) / 10 - 3).alias(" TGK"),
            F.when(day % 5 == 0, " -999.0").otherwise(cell((F.col("users") % 40) / 10)).alias(" RSK"),
            cell(F.col("n") % 9).alias("RSKF"),
            cell((F.col("users") % 110) / 10).alias(" SDK"),
            cell(F.col("top") % 4).alias("SHK_TAG"),
            cell((F.col("n") % 80) / 10).alias("  FM"),
        )

    @property
    def special_days_text(self) -> DataFrame:
        """Event calendar from the days of the feed: the 5th twice, the 12th and 26th once, others a century later."""
        days = self.events.select(F.to_date("ts").alias("d")).distinct()
        listed = days.withColumn("i", F.explode(F.sequence(F.lit(1), F.when(F.dayofmonth("d") == 5, 2).otherwise(1))))
        date = F.when(F.dayofmonth("d").isin(5, 12, 26), F.col("d")).otherwise(F.add_months("d", 1200))
        return listed.select(
            (F.dayofmonth("d") * 10 + F.col("i")).cast("long").alias("event_id"),
            F.date_format(date, "yyyy-MM-dd").alias("date"),
            F.concat(F.lit("type"), F.col("i").cast("string")).alias("event_type"),
            F.concat(F.lit("place"), F.dayofmonth("d").cast("string")).alias("location"),
            (51 + F.col("i") / 10).alias("latitude"),
            F.lit(13.7).alias("longitude"),
        )

    @property
    def vehicles(self) -> DataFrame:
        """Vehicle list from the parts: every 4th has a numeric type, every 7th no number."""
        part = self.table("part")
        key = F.col("p_partkey")
        number = F.when(
            key % 3 == 0, F.concat(F.lit("232 9"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("-"), (key % 10).cast("string"))
        ).otherwise(F.concat(F.lpad((400 + F.col("p_size")).cast("string"), 3, "0"), F.lit(" 001-"), (key % 10).cast("string")))
        return part.select(
            key.alias("fzg_id"),
            F.when(key % 7 != 0, number).alias("fzg_nr"),
            F.when(key % 4 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand")).alias("typ"),
            F.col("p_type").alias("typ_text"),
            F.col("p_size").cast("long").alias("typ_nr"),
            (F.col("p_size") * 5).cast("long").alias("kapazitaet"),
            F.col("p_retailprice").alias("laenge"),
        )

    @property
    def vehicle_ranges(self) -> DataFrame:
        """Number ranges from the parts: one tram and one bus range per size class; classes over 40 far from any number."""
        size_class = F.expr("(p_size - 1) div 8")
        classes = self.table("part").groupBy(size_class.alias("c")).agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
        away = F.when(F.col("c") > 4, 10_000_000).otherwise(0)
        classes = classes.select("c", (F.col("lo") + away).alias("lo"), (F.col("hi") + away).alias("hi"))
        tram = classes.select("c", (2900 + F.col("lo")).alias("a"), (2900 + F.col("hi")).alias("b"), F.lit("T").alias("g"))
        bus = classes.select(
            "c", ((400 + F.col("lo")).cast("long") * 1000).cast("long").alias("a"), ((400 + F.col("hi")).cast("long") * 1000 + 999).cast("long").alias("b"), F.lit("B").alias("g")
        )
        return tram.unionByName(bus).select(
            F.concat("g", F.col("c").cast("string")).alias("typ"),
            F.col("a").cast("long").alias("fzg_nr_from"),
            F.col("b").cast("long").alias("fzg_nr_to"),
            F.concat(F.lit("kind"), F.col("g")).alias("fahrzueg_type"),
            (F.col("c") + 2).cast("long").alias("fahrgasttüren"),
            (10.0 + F.col("c") * 2.5).alias("länge_m"),
            (30 + F.col("c") * 10).cast("long").alias("sitzplätze"),
            (50 + F.col("c") * 15).cast("long").alias("stehplätze"),
        )

    @property
    def stop_geometry(self) -> DataFrame:
        """Stops seen in the telemetry, each under two names; stops over 3 are filed under another number."""
        number = F.when(F.col("ort_nr_start") < 4, F.col("ort_nr_start")).otherwise(F.col("ort_nr_start") + 100)
        stops = self.telemetry.select(number.alias("ort_nr")).distinct()
        named = stops.withColumn("i", F.explode(F.array(F.lit(1), F.lit(2))))
        return named.select(
            "ort_nr",
            F.concat(F.lit("Halt "), F.col("ort_nr").cast("string"), F.lit(" "), F.col("i").cast("string")).alias("stop_name"),
            (51 + F.col("ort_nr") / 100).alias("lat"),
            (13.7 + F.col("ort_nr") / 100).alias("lon"),
        )

    @property
    def stop_visits(self) -> DataFrame:
        """A core-shaped table from the order lines, for the model queries.

        A supplier is a trip, the first of the shipping month its day, and a
        line a visit at some time of that day.
        """
        line = self.table("lineitem")
        second = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 4001) % 72000
        month = F.trunc(F.col("l_shipdate").cast("date"), "month").cast("timestamp")
        arrival = F.timestamp_micros(F.unix_micros(month) + second * 1_000_000)
        status = (
            F.when(F.col("l_returnflag") == "R", "no_door").when(F.col("l_quantity") > 45, "multi_door").otherwise("normal")
        )
        return line.select(
            F.col("l_suppkey").alias("fzg_id"),
            ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("drop_row_idx"),
            arrival.alias("arrival_time"),
            (F.col("l_suppkey") % 13).alias("linie"),
            F.col("l_suppkey").alias("fahrt_id"),
            (F.col("l_partkey") % 50).alias("ort_nr_start"),
            (F.col("l_partkey") % 40).alias("stop_index"),
            status.alias("stop_status"),
            (F.col("l_extendedprice") / 100 - 200).alias("delay_calculated_sec"),
            F.when(F.col("l_returnflag") == "R", F.lit(-1.0)).otherwise(F.col("l_quantity") * 3).alias("dwell_time"),
            (F.col("l_quantity") * 14 + F.col("l_discount") * 100).alias("travel_time"),
            F.col("l_quantity").cast("long").alias("besetztgrad"),
        )


@dataclass(frozen=True)
class SharedTrips(Tables):
    """The same feed with trips that several vehicles drive, so that events of two vehicles meet one timetable record."""

    @property
    def telemetry(self) -> DataFrame:
        own = super().telemetry
        return own.withColumn("fahrt_id", (F.col("fzg_id") % 15) * 10 + F.col("fahrt_id") % 10)


@dataclass(frozen=True)
class CoarseOdometer(Tables):
    """The same feed with an odometer that counts hundreds, so that vehicles stand still."""

    @property
    def telemetry(self) -> DataFrame:
        return super().telemetry.withColumn("distanz", F.floor(F.col("distanz") / 100).cast("double") * 100)


@dataclass(frozen=True)
class GappyFeed(Tables):
    """The same feed with core fields missing here and there."""

    @property
    def telemetry(self) -> DataFrame:
        own = super().telemetry
        gaps = {"fahrt_id": 40, "ort_nr_start": 55, "tuerkriterium": 77, "distanz": 90}
        return own.withColumns({c: F.when(F.col("ping_id") % n != 0, F.col(c)) for c, n in gaps.items()})
