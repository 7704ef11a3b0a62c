"""Choices between readings: of attempts, of engines and of their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let
from .labels import alike

COVER, GOOD_CONFIDENCE = 0.9, 0.9


def best_attempt(attempts: DataFrame) -> DataFrame:
    """One attempt for each photo and engine: valid ones first, then those with most true checks, then the first."""
    w = Window.partitionBy("photo_id", "engine").orderBy(F.desc("valid"), F.desc("checks"), "attempt")
    return attempts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_valid_engine(readings: DataFrame) -> DataFrame:
    """Engines in turn until one is valid: (photo_id, engine, valid, checks, ms), ms being what all engines up to it took.

    Without a valid one, the engine with most true checks, the first on ties, and the time of all.
    """
    turn = Window.partitionBy("photo_id").orderBy("turn")
    r = readings.withColumn("spent", F.sum("ms").over(turn.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("ms").over(Window.partitionBy("photo_id")))
    order = F.struct((~F.col("valid")).alias("a"), F.when(F.col("valid"), F.lit(0)).otherwise(-F.col("checks")).alias("b"), F.col("turn").alias("c"))
    best = r.groupBy("photo_id").agg(F.min_by(F.struct("engine", "valid", "checks", "spent", "total"), order).alias("x"))
    return best.select("photo_id", "x.engine", "x.valid", "x.checks", F.when(F.col("x.valid"), F.col("x.spent")).otherwise(F.col("x.total")).alias("ms"))


def side(front_like: Column, any_zone: Column, valid_zone: Column) -> Column:
    """Which side of a card a photo shows."""
    return F.when(valid_zone, "reverso").when(front_like, "anverso").when(any_zone, "reverso").otherwise("desconocido")


def same_row(a: str, b: str) -> Column:
    """Centres less than 0.6 of the larger height apart."""
    c = lambda t: F.col(f"{t}.y") + F.col(f"{t}.h") / 2
    return F.abs(c(a) - c(b)) < 0.6 * F.greatest(f"{a}.h", f"{b}.h")


def cover(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, share) of lines of a: how much of their width lines of b in the same row overlay; overlaps add up, to 1 at most."""
    overlap = F.greatest(F.lit(0.0), F.least(F.col("a.x") + F.col("a.w"), F.col("b.x") + F.col("b.w")) - F.greatest("a.x", "b.x"))
    pairs = a.alias("a").join(b.alias("b"), (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & same_row("a", "b"), "left")
    return pairs.groupBy("a.doc_id", "a.page", "a.line_no").agg(F.least(F.lit(1.0), F.coalesce(F.sum(overlap), F.lit(0.0)) / F.max("a.w")).alias("share"))


def combine(a: DataFrame, b: DataFrame, least: float = COVER) -> DataFrame:
    """Lines of b, each replaced by those of a in its row if they cover it; lines of a that meet none of b stay too."""
    covered = cover(b, a).where(F.col("share") >= least).select("doc_id", "page", "line_no")
    kept_b = b.join(covered, ["doc_id", "page", "line_no"], "left_anti")
    met = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & same_row("a", "b") & (F.col("a.x") < F.col("b.x") + F.col("b.w")) & (F.col("b.x") < F.col("a.x") + F.col("a.w"))
    kept_a = a.alias("a").join(kept_b.alias("b"), met, "left_anti")
    return kept_a.unionByName(kept_b)


def unmatched(extra: DataFrame, lines: DataFrame) -> DataFrame:
    """Extra lines that overlap none of the others."""
    met = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & same_row("a", "b") & (F.col("a.x") < F.col("b.x") + F.col("b.w")) & (F.col("b.x") < F.col("a.x") + F.col("a.w"))
    return extra.alias("a").join(lines.alias("b"), met, "left_anti")


ALIKE = 0.8


def same_reading(a: Column, b: Column) -> Column:
    """Are two readings alike in upper case, without signs? Empty ones are alike to nothing."""
    plain = lambda t: F.regexp_replace(F.upper(F.coalesce(t, F.lit(""))), r"[^\p{L}\p{N}_]", "")
    return let(F.struct(plain(a).alias("a"), plain(b).alias("b")), lambda p: alike(p["a"], p["b"], ALIKE))


def chosen_lines(readings: DataFrame) -> DataFrame:
    """Adds ``text``, ``conf``, ``origin`` and ``alt`` to two readings of each line; lines that neither reads go.

    readings: text_a, conf_a, text_b, conf_b and ``reread``, whether b was asked. The first
    stands unless it is empty, or b was asked, differs, and is surer. Where they agree the
    surer confidence counts; the other text stays as an alternative.
    """
    d = readings.withColumn("_same", F.col("reread") & same_reading(F.col("text_a"), F.col("text_b")))
    b = F.when(F.col("reread"), F.coalesce("text_b", F.lit(""))).otherwise("")
    cb = F.when(F.col("reread"), F.coalesce("conf_b", F.lit(0.0))).otherwise(0.0)
    first_one = (F.coalesce("text_a", F.lit("")) != "") & (~F.col("reread") | F.col("_same") | (F.col("conf_a") >= cb))
    other = F.when(first_one, b).otherwise(F.coalesce("text_a", F.lit("")))
    d = d.withColumns({
        "text": F.when(first_one, F.col("text_a")).otherwise(b), "origin": F.when(first_one, "a").otherwise("b"),
        "conf": F.bround(F.when(first_one, F.greatest(F.col("conf_a"), F.when(F.col("_same"), cb).otherwise(0.0))).otherwise(cb), 3),
    })
    return d.withColumn("alt", F.when((other != "") & (other != F.col("text")), other)).drop("_same").where(F.trim("text") != "")


def reused(boxes: DataFrame, previous: DataFrame) -> DataFrame:
    """Lines of an earlier reading that cover a box by COVER, all of them sure: (doc_id, page, box_no, line_no), no need to read these boxes again."""
    at = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & same_row("a", "b") & (F.col("b.x") + F.col("b.w") > F.col("a.x")) & (F.col("b.x") < F.col("a.x") + F.col("a.w"))
    over = F.least(F.col("a.x") + F.col("a.w"), F.col("b.x") + F.col("b.w")) - F.greatest("a.x", "b.x")
    met = boxes.alias("a").join(previous.alias("b"), at).select("a.doc_id", "a.page", "a.box_no", F.col("a.w").alias("w"), F.col("b.line_no").alias("line_no"), F.col("b.conf").alias("conf"), over.alias("over"))
    whole = met.groupBy("doc_id", "page", "box_no").agg(F.sum("over").alias("over"), F.max("w").alias("w"), F.min("conf").alias("conf"), F.collect_set("line_no").alias("lines"))
    return whole.where((F.col("conf") >= GOOD_CONFIDENCE) & (F.col("over") >= COVER * F.col("w"))).select("doc_id", "page", "box_no", F.explode("lines").alias("line_no"))


def doubtful(lines: DataFrame, limit: int = 40) -> DataFrame:
    """At most ``limit`` lines of a page to read again: those with digits first, then the least sure; a limit of the feature."""
    w = Window.partitionBy("doc_id", "page").orderBy(F.desc(F.col("text").rlike(r"\d")), "conf", "line_no")
    return lines.where(F.col("conf") < GOOD_CONFIDENCE).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def enough(lines: DataFrame) -> DataFrame:
    """(doc_id, page, enough): five lines of four signs or more, and a mean confidence of theirs of 0.6.

    Confidences are added in the order of ``line_no``, as sums of doubles near 0.6 would else depend on how the rows are split.
    """
    useful = F.length("text") >= 4
    sure = F.collect_list(F.when(useful & F.col("conf").isNotNull(), F.struct("line_no", F.col("conf").cast("double").alias("conf"))))
    got = lines.groupBy("doc_id", "page").agg(F.count_if(useful).alias("n"), F.array_sort(sure).alias("s"))
    mean = F.aggregate("s", F.lit(0.0), lambda total, x: total + x["conf"]) / F.nullif(F.size("s"), F.lit(0))
    return got.select("doc_id", "page", ((F.col("n") >= 5) & (mean >= 0.6)).alias("enough"))
