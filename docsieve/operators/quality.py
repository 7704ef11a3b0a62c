"""Verdicts on photo quality from measured values and a small table of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Zone, metric, sense, doubtful from, bad from, and whether bad only counts as doubtful.
RULES = (
    ("global", "nitidez", "min", 60.0, 25.0, False), ("global", "brillo_bajo", "min", 70.0, 45.0, False), ("global", "brillo_alto", "max", 200.0, 225.0, False),
    ("global", "oscuros", "max", 0.40, 0.65, True), ("global", "quemados", "max", 0.08, 0.20, False), ("global", "contraste", "min", 35.0, 20.0, False),
    ("global", "reflejo", "max", 0.004, 0.015, True), ("global", "lado_min_px", "min", 900.0, 600.0, False),
    ("mrz", "nitidez", "min", 500.0, 200.0, False), ("mrz", "brillo_bajo", "min", 90.0, 60.0, False), ("mrz", "brillo_alto", "max", 235.0, 248.0, False),
    ("mrz", "quemados", "max", 0.10, 0.25, False), ("mrz", "contraste", "min", 40.0, 25.0, False), ("mrz", "reflejo", "max", 0.01, 0.04, False), ("mrz", "altura_linea_px", "min", 26.0, 16.0, False),
    ("documento", "nitidez", "min", 80.0, 30.0, False), ("documento", "brillo_bajo", "min", 90.0, 60.0, False), ("documento", "oscuros", "max", 0.25, 0.45, True),
    ("documento", "contraste", "min", 18.0, 8.0, False), ("documento", "reflejo", "max", 0.01, 0.04, False), ("documento", "altura_letra_px", "min", 16.0, 10.0, False),
)
LEVELS, VERDICTS = ("ok", "dudoso", "mal"), ("apta", "riesgo", "rechazar")


def rules(spark: SparkSession, table: tuple = RULES) -> DataFrame:
    """A few dozen rows; joins broadcast it."""
    return spark.createDataFrame([*table], "zone string, metric string, sense string, warn double, bad double, warn_only boolean")


def levels(measured: DataFrame, table: DataFrame) -> DataFrame:
    """Adds ``level`` (0 ok, 1 dudoso, 2 mal) to (photo_id, zone, metric, value); metrics without a rule go, as do null values."""
    worse = lambda limit: F.when(F.col("sense") == "min", F.col("value") < F.col(limit)).otherwise(F.col("value") > F.col(limit))
    level = F.when(worse("bad"), F.when(F.col("warn_only"), 1).otherwise(2)).when(worse("warn"), 1).otherwise(0)
    return measured.where("value is not null").join(F.broadcast(table), ["zone", "metric"]).select("photo_id", "zone", "metric", "value", level.alias("level"))


def verdicts(levelled: DataFrame) -> DataFrame:
    """(photo_id, verdict, warnings): the worst level decides; warnings are zone.metric:level, sorted."""
    name = F.concat_ws(":", F.concat_ws(".", "zone", "metric"), F.element_at(F.array(*map(F.lit, LEVELS)), F.col("level") + 1))
    got = levelled.groupBy("photo_id").agg(F.max("level").alias("worst"), F.array_sort(F.collect_list(F.when(F.col("level") > 0, name))).alias("warnings"))
    return got.select("photo_id", F.element_at(F.array(*map(F.lit, VERDICTS)), F.col("worst") + 1).alias("verdict"), "warnings")


def worst_page(pages: DataFrame) -> DataFrame:
    """(doc_id, verdict, warnings) of the worst page; warnings in page order, each once."""
    place = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict")).cast("int")
    got = pages.groupBy("doc_id").agg(F.max(place).alias("worst"), F.array_sort(F.collect_list(F.struct("page", "warnings"))).alias("p"))
    return got.select("doc_id", F.element_at(F.array(*map(F.lit, VERDICTS)), F.col("worst")).alias("verdict"), F.array_distinct(F.flatten(F.transform("p", lambda x: x["warnings"]))).alias("warnings"))
