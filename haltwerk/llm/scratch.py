"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from haltwerk.session import checkpoint_folder, delete_at_exit, temporary_table


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or its stand-in in a session on one machine."""
    return checkpoint_folder(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps start from the files.

    The files are deleted when Python ends.
    """
    return temporary_table(df, name)


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder, deleted when Python ends."""
    return delete_at_exit(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")


def text_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a text column over all rows."""
    from pyspark.sql import functions as F

    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)
