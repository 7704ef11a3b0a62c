"""Card verification over a stream. The decision keeps no state, so a stream runs the batch function as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.verify import ATTEMPTS, verify


def verified_stream(cases: DataFrame) -> DataFrame:
    """verify() on a streaming DataFrame; attempts outside 1 to ATTEMPTS are dropped."""
    return verify(cases.where(F.col("attempt").between(1, ATTEMPTS)))


def outcomes_by_window(verified: DataFrame, time: str = "ts", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(window, status, n): counts of outcomes; rows later than ``late`` are left out by the watermark."""
    return verified.withWatermark(time, late).groupBy(F.window(time, window), "status").agg(F.count("*").alias("n"))
