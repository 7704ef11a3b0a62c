"""Readings in rounds: every reader sees only what no earlier one has settled.

A reader costs far more than anything else here, so what it reads is stored before the
next one is asked, and a lost executor never makes it read again. Photos themselves are
not copied: each round reads those that are left by their keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._tables import stored
from ..functions import zone
from . import front

#: A name, and what turns photos into rows of readings.
Reader = tuple[str, Callable[[DataFrame], DataFrame]]


def rounds(items: DataFrame, key: str, readers: Sequence[Reader], settled: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """All readings, with ``turn`` and ``reader``: each reader in turn gets the items that are not settled by what is read so far.

    ``settled`` takes all readings so far and gives the keys to leave out. Readers after
    the last open item are not asked. None without readers.
    """
    so_far, left = None, items
    for turn, (name, read) in enumerate(readers):
        if so_far is not None:
            left = items.join(settled(so_far).select(key).distinct(), key, "left_anti")
            if not left.limit(1).count():
                break
        got = stored(read(left).withColumns({"turn": F.lit(turn), "reader": F.lit(name)}))
        so_far = got if so_far is None else so_far.unionByName(got)
    return so_far


def checks_held(z: str) -> Column:
    """How many checks of a zone hold."""
    names = ("structure", "dates", "name_shape", "support", "birth", "expiry", "composite", "support_shape", "dni_letter")
    return sum(F.coalesce(F.col(f"{z}.checks.{n}"), F.lit(False)).cast("int") for n in names)


def zones_of(attempts: DataFrame, as_of: Column) -> DataFrame:
    """(photo_id, zone, valid, checks): the zone of the first valid attempt, else of the one with most true checks, the first on ties.

    attempts: photo_id, attempt, candidates (lines as read). Photos whose attempts hold no zone have no row.
    """
    one = attempts.select(F.struct("photo_id", "attempt").alias("at"), "candidates")
    read = zone.read_zones(one, "at", "candidates", as_of).where("zone is not null")
    read = read.select("at.photo_id", "at.attempt", "zone", F.coalesce("zone.valid", F.lit(False)).alias("valid"), checks_held("zone").alias("checks"))
    order = F.struct(~F.col("valid"), F.when(F.col("valid"), 0).otherwise(-F.col("checks")), F.col("attempt"))
    return read.groupBy("photo_id").agg(F.min_by(F.struct("zone", "valid", "checks"), order).alias("b")).select("photo_id", "b.*")


def read_backs(photos: DataFrame, readers: Sequence[Reader], as_of: Column) -> DataFrame:
    """(photo_id, zone, valid, checks, reader, readings) for each photo: its valid zone, or the best of all readers.

    A reader turns photos into attempts (photo_id, attempt, candidates); usually there is
    one for each engine and variant of a photo. ``readings`` counts those that were asked
    until a zone was valid. Photos without any zone have nulls, but for the count.
    """
    with_zones = [(name, lambda left, read=read: zones_of(read(left), as_of)) for name, read in readers]
    got = rounds(photos, "photo_id", with_zones, lambda so_far: so_far.where("valid"))
    order = F.struct(~F.col("valid"), F.when(F.col("valid"), 0).otherwise(-F.col("checks")), F.col("turn"))
    best = got.groupBy("photo_id").agg(F.min_by(F.struct("zone", "valid", "checks", "reader", "turn"), order).alias("b"))
    out = photos.select("photo_id").join(best, "photo_id", "left")
    asked = F.when(F.col("b.valid"), F.col("b.turn") + 1).otherwise(len(readers))
    return out.select("photo_id", "b.zone", F.coalesce("b.valid", F.lit(False)).alias("valid"), "b.checks", "b.reader", asked.cast("long").alias("readings"))


def front_lines(read: Callable[[DataFrame], DataFrame], as_of: Column) -> Callable[[DataFrame], DataFrame]:
    """A reader of fronts by labels, from one that gives lines (photo_id, line_no, text, x, y, w, h)."""
    def run(photos: DataFrame) -> DataFrame:
        got = front.read_fronts(read(photos).withColumnRenamed("photo_id", "doc_id"), as_of)
        return got.select(F.col("doc_id").alias("photo_id"), "dni", "dni_ok", "num_soporte", "text")

    return run


def front_zones(read: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A reader of fronts by the zones of a template, from one that gives their texts (photo_id, key, text)."""
    def run(photos: DataFrame) -> DataFrame:
        texts = read(photos)
        said = texts.groupBy("photo_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "text"))), lambda t: F.replace(front.row_form(t["text"]), F.lit(" "), F.lit(""))), "|").alias("text"))
        got = front.read_zones_of(texts).join(said, "photo_id")
        return got.select("photo_id", F.col("fields")["dni"].alias("dni"), "dni_ok", F.col("fields")["num_soporte"].alias("num_soporte"), "text")

    return run


def read_fronts(photos: DataFrame, readers: Sequence[Reader]) -> DataFrame:
    """(photo_id, dnis, supports, text, complete, readings) for each photo: candidates in the order of the readers, until a number and a support number are there.

    Readers are those of front_lines() and front_zones(). A number counts only with its right letter.
    """
    number, support = F.coalesce("dni_ok", F.lit(False)), F.col("num_soporte").isNotNull()

    def whole(so_far: DataFrame) -> DataFrame:
        both = so_far.groupBy("photo_id").agg(F.min(F.when(number, F.col("turn"))).alias("a"), F.min(F.when(support, F.col("turn"))).alias("b"))
        return both.where("a is not null and b is not null").select("photo_id", F.greatest("a", "b").alias("at"))

    got = rounds(photos, "photo_id", readers, whole)
    out = photos.select("photo_id").join(front.front_candidates(got), "photo_id", "left").join(whole(got), "photo_id", "left")
    none = F.array().cast("array<string>")
    return out.select("photo_id", F.coalesce("dnis", none).alias("dnis"), F.coalesce("supports", none).alias("supports"), F.coalesce("text", F.lit("")).alias("text"), F.col("at").isNotNull().alias("complete"), F.coalesce(F.col("at") + 1, F.lit(len(readers))).cast("long").alias("readings"))
