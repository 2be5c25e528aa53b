"""Session settings the operators rely on."""

from __future__ import annotations

import atexit
import os
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

# Time zone: every hour, date and weekday below is computed in UTC unless a
# zone is named.  Skew: a hot trip in the timetable join is split at run time.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a running session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "haltwerk") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("HALTWERK_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.warehouse.dir", os.environ.get("HALTWERK_WAREHOUSE", "/tmp/haltwerk-warehouse"))
        .config("spark.ui.enabled", "false")
        # call sites of column functions cost several round trips each
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """Folder for written intermediate tables: ``spark.checkpoint.dir``, which all executors must share.

    A session on one machine may do without the setting and uses a folder below
    its warehouse; a cluster without it gets an error instead of a folder that
    each executor would have for itself.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"{spark.conf.get('spark.sql.warehouse.dir')}/_intermediate"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared)
    return shared.rstrip("/")


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def newest_change(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """Name, length and modification time of the files of a table."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files, found = system.listFiles(place, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


_WRITTEN: list[tuple[SparkSession, str]] = []


def _delete_written() -> None:
    while _WRITTEN:
        with suppress(Exception):
            delete_folder(*_WRITTEN.pop())


def delete_at_exit(spark: SparkSession, path: str) -> str:
    """Have a folder deleted when Python ends, whether or not its session still runs then."""
    if not _WRITTEN:
        atexit.register(_delete_written)
    _WRITTEN.append((spark, path))
    return path


def temporary_table(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back; it is deleted when Python ends."""
    spark = df.sparkSession
    path = delete_at_exit(spark, f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
