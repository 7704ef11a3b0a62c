"""Stored tables, column names of any kind, and what a session is asked before work in Python."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._ship import ship
from .._tables import discard, shared_dir, stored

__all__ = ["col", "discard", "quoted", "release", "shared_dir", "small_batches", "stored", "with_row"]


def quoted(name: str) -> str:
    """A column name for F.col that may hold dots, spaces or backticks."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str):
    return F.col(quoted(name))


def with_row(packed: DataFrame, more: str) -> T.StructType:
    """The schema of rows that carry a struct ``row``, whatever its columns are called, and more columns as DDL."""
    return T.StructType([packed.schema["row"], *T.StructType.fromDDL(more).fields])


def small_batches(spark: SparkSession) -> None:
    """Before work in Python: sends the package along, and bounds the rows and bytes of an Arrow batch, so that long texts fit a worker.

    Results are lazy, so the bounds hold for the session. They are the same for all operators.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of tables that have been stored: it does so when their plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
