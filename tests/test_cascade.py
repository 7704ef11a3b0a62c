"""Readers are asked in turn, and only about what is still open."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docsieve.operators import cascade

ZONE = ["IDESPBAA000589499999999R<<<<<<", "8001014F2501017ESP<<<<<<<<<<<7", "ESPANOLA<ESPANOLA<<CARMEN<<<<<"]


@pytest.fixture
def as_of():
    return F.lit("2020-06-30").cast("date")


def reader(asked: list, name: str, ids: tuple, lines: list):
    """Notes what it is asked for, and reads lines for some of the photos."""
    def read(photos):
        asked.append((name, sorted(r[0] for r in photos.collect())))
        return photos.where(F.col("photo_id").isin(*ids)).select("photo_id", F.lit(1).alias("attempt"), F.array(*map(F.lit, lines)).alias("candidates"))

    return name, read


def test_no_reader_sees_a_valid_zone_again(spark, as_of):
    from docsieve.functions import zone

    built = spark.range(1).select(zone.build_zone(F.lit("BAA000589"), F.lit("99999999R"), F.lit("800101"), F.lit("F"), F.lit("250101"), F.lit("ESPANOLA ESPANOLA"), F.lit("CARMEN")).alias("z")).first()["z"]
    good = list(built)
    bad = [good[0], good[1][:3] + str((int(good[1][3]) + 1) % 10) + good[1][4:], good[2]]
    worse = [good[0], good[1][:3] + str((int(good[1][3]) + 1) % 10) + good[1][4:29] + "X", good[2].replace("<<CARMEN", "CARMEN<<")]
    asked: list = []
    photos = spark.createDataFrame([(i,) for i in range(6)], "photo_id long")
    readers = [reader(asked, "a", (0, 1), good), reader(asked, "b", (2, 3), worse), reader(asked, "c", (2, 3, 4), bad), reader(asked, "d", (4,), good), reader(asked, "e", (), good)]
    got = {r["photo_id"]: (r["valid"], r["reader"], r["readings"]) for r in cascade.read_backs(photos, readers, as_of).collect()}
    assert asked == [("a", [0, 1, 2, 3, 4, 5]), ("b", [2, 3, 4, 5]), ("c", [2, 3, 4, 5]), ("d", [2, 3, 4, 5]), ("e", [2, 3, 5])]
    # the reading with most true checks stays, of those that are not valid
    assert got == {0: (True, "a", 1), 1: (True, "a", 1), 2: (False, "c", 5), 3: (False, "c", 5), 4: (True, "d", 4), 5: (False, None, 5)}


def test_readers_after_the_last_open_photo_are_not_asked(spark, as_of):
    asked: list = []
    front = lambda name, ids: (name, lambda photos: (asked.append((name, sorted(r[0] for r in photos.collect()))), photos.where(F.col("photo_id").isin(*ids)).select("photo_id", F.lit("12345678Z").alias("dni"), F.lit(True).alias("dni_ok"), F.lit("BAA000589").alias("num_soporte"), F.lit("T").alias("text")))[1])
    photos = spark.createDataFrame([(1,), (2,)], "photo_id long")
    got = {r["photo_id"]: (r["dnis"], r["complete"], r["readings"]) for r in cascade.read_fronts(photos, [front("a", (1,)), front("b", (2,)), front("c", (1, 2))]).collect()}
    assert asked == [("a", [1, 2]), ("b", [2])]
    assert got == {1: (["12345678Z"], True, 1), 2: (["12345678Z"], True, 2)}
