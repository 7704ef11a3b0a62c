"""Line deduplication with DataFrame functions only.

Plan: lines are hashed and exploded with their positions once, and these places are
stored. One partial and one final aggregation count the distinct documents of each
hash, and the hashes of enough documents go back to the places they are found at. A
text is put together again by position, from the places that are left. Texts are
exchanged once, for that last join; lines never are, only their hashes and places. The
hashes that repeat are stored before they are joined, so adaptive execution splits the
places of a very common line over many tasks.

Counting needs no exchange by document: the places of a row are sorted by hash, and
only the first of each hash counts. Ids that stand in several rows are told apart
beforehand, and only their places are made distinct by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import col, stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed value: the white space that counts at the ends of a line.
BLANK = " \t\n\x0b\x0c\r"


def ascii_lower(c: Column) -> Column:
    """A-Z only; lower() has a fast path for ASCII, where both agree."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def _hash(text: Column, *seeds: int) -> tuple[Column, Column]:
    """Two chains of xxhash64 from different seeds: 128 bits."""
    return F.xxhash64(F.lit(seeds[0]), text), F.xxhash64(F.lit(seeds[1]), text)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2, copies: bool = False) -> DataFrame:
    """Drops lines whose key is found in ``min_docs`` documents or more, except in the smallest id that holds it.

    Returns one row per input row: ``row`` (a struct of all input columns),
    ``kept`` (text), ``n_lines`` and ``n_dropped`` (long). Keys of fewer than
    ``min_chars`` code points always stay. A null or empty text is one empty
    line; a very long text is put together whole. Rows that share an id are one
    document. A row whose id is null is kept as it is and counts for nothing. An
    empty table gives no rows. With ``copies``, ``copy`` tells whether ``min_docs``
    documents or more hold the very text and this is not the first. Column names of
    the input, whatever they are, cannot clash: they stay inside ``row``.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    # a document's places are those of one text, also where an id has several
    ta, tb = _hash(text, 104729, 15485863)
    work = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), col(id_col).alias("id"), ta.alias("ta"), tb.alias("tb"), F.split(text, "\n", -1).alias("lines"))
    # place 0 is the whole text
    whole = F.array(F.struct(F.col("ta").alias("a"), F.col("tb").alias("b"), F.lit(0).alias("pos")))

    def place(line: Column, i: Column) -> Column:
        key = line_key(line)
        a, b = _hash(key, 42, 7919)
        return F.when(F.char_length(key) >= min_chars, F.struct(a.alias("a"), b.alias("b"), (i + 1).alias("pos")))

    places = F.filter(F.transform("lines", place), lambda x: x.isNotNull())
    named = work.where("id is not null").select("id", "ta", "tb", F.sort_array(F.concat(whole, places) if copies else places).alias("places"))

    def marked(x: Column, i: Column) -> Column:
        before = F.get("places", i - 1)
        return F.struct(x["pos"].alias("pos"), x["a"].alias("a"), x["b"].alias("b"), ((i == 0) | (before["a"] != x["a"]) | (before["b"] != x["b"])).alias("fresh"))

    spots = stored(named.select("id", "ta", "tb", F.inline(F.transform("places", marked))))
    holders = spots.where("fresh").select("id", "a", "b")
    several = stored(docs.select(col(id_col).alias("id")).where("id is not null").groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id"))
    if several.limit(1).count():
        holders = holders.join(several, "id", "left_anti").unionAll(holders.join(several, "id", "left_semi").distinct())
    repeated = stored(holders.groupBy("a", "b").agg(F.min("id").alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_docs).select("a", "b", "first"))
    gone = spots.join(repeated, ["a", "b"]).where("id > first").groupBy("id", "ta", "tb").agg(F.collect_set("pos").alias("gone"))
    left = F.array_except(F.sequence(F.lit(1), F.size("lines")), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(left, lambda i: F.element_at("lines", i)))
    copy = [F.coalesce(F.array_contains("gone", 0), F.lit(False)).alias("copy")] if copies else []
    return (
        work.join(gone, ["id", "ta", "tb"], "left")
        .select("row", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"), *copy)
        .select("row", F.array_join("kept", "\n").alias("kept"), "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), *["copy"] * copies)
    )
