"""Documents out of positioned lines: reading order, rows and running text.

A document is one row with arrays, as its extractors compare lines with lines of the
same document only. Documents have a bounded number of pages, so these arrays do too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import row_form

LINE = ("page", "cy", "x", "y", "w", "h", "line_no", "text", "norm", "origin", "conf", "alt")


def with_centre(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"cy": F.col("y") + F.col("h") / 2, "norm": row_form(F.col("text"))})


def _row_numbers(ordered: Column) -> Column:
    """The row of each line, from 0: a line joins the last row if its centre is within half a height of that row's first line.

    The fold carries the first line of the row and the numbers so far, not the lines.
    """
    start = F.struct(F.lit(-1).alias("row"), F.lit(0).alias("page"), F.lit(0.0).alias("cy"), F.lit(0.0).alias("h"), F.array().cast("array<int>").alias("rows"))

    def step(s: Column, ln: Column) -> Column:
        near = (s["row"] >= 0) & (s["page"] == ln["page"]) & (F.abs(s["cy"] - ln["cy"]) < F.greatest(s["h"], ln["h"]) * 0.5)
        joins = lambda kept, new: F.when(near, kept).otherwise(new)
        row = joins(s["row"], s["row"] + 1)
        return F.struct(row.alias("row"), joins(s["page"], ln["page"]).cast("int").alias("page"), joins(s["cy"], ln["cy"]).cast("double").alias("cy"), joins(s["h"], ln["h"]).cast("double").alias("h"), F.array_append(s["rows"], row).alias("rows"))

    return F.aggregate(ordered, start, step, lambda s: s["rows"])


def _ordered(lines: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(doc_id, _o): the columns of the lines of each document in reading order."""
    d = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_l"))
    # rows from the top, and from the left in a row
    placed = F.zip_with("_l", _row_numbers(F.col("_l")), lambda v, r: F.struct(r.alias("_r"), v["x"].alias("_x"), v["line_no"].alias("_n"), v.alias("v")))
    return d.select("doc_id", F.transform(F.sort_array(placed), lambda s: s["v"]).alias("_o"))


def documents(lines: DataFrame) -> DataFrame:
    """(doc_id, lines, rows, text): lines in reading order with ``row``; rows are normalised; text is the rows, one below the other.

    lines: doc_id, line_no, page, text, x, y, w, h (fractions of the page), origin, conf, alt.
    """
    d = _ordered(with_centre(lines), LINE)
    # the rows of a document are folded again over the reading order
    d = d.select("doc_id", F.zip_with("_o", _row_numbers(F.col("_o")), lambda v, r: F.struct(r.alias("row"), *[v[c].alias(c) for c in LINE])).alias("lines"))
    return d.select("doc_id", "lines", _texts(F.col("lines")).alias("rows")).withColumn("text", F.array_join("rows", "\n"))


def _texts(lines: Column) -> Column:
    """The normalised text of each row; two blanks part its lines before blanks are made one."""
    empty = F.array().cast("array<string>")

    def step(s: Column, ln: Column) -> Column:
        new = ln["row"] != s["row"]
        done = F.when(new & (s["row"] >= 0), F.array_append(s["rows"], s["text"])).otherwise(s["rows"])
        return F.struct(ln["row"].alias("row"), F.when(new, ln["norm"]).otherwise(F.concat(s["text"], F.lit("  "), ln["norm"])).alias("text"), done.alias("rows"))

    start = F.struct(F.lit(-1).alias("row"), F.lit("").alias("text"), empty.alias("rows"))
    texts = F.aggregate(lines, start, step, lambda s: F.array_append(s["rows"], s["text"]))
    return F.transform(texts, lambda t: F.trim(F.regexp_replace(t, r"\s+", " ")))


def reading_order(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, place): the place of each line in reading order, from 1."""
    placed = _ordered(with_centre(lines), LINE[: LINE.index("text")])
    return placed.select("doc_id", F.posexplode_outer("_o").alias("p", "l")).where("l is not null").select("doc_id", "l.line_no", (F.col("p") + 1).alias("place"))


def column_text(lines: DataFrame) -> DataFrame:
    """(doc_id, row, text): lines in the row of the line before them, two blanks between columns.

    Here a line is compared with the line before it, which a lag and a running sum express.
    """
    o = documents(lines).select("doc_id", F.posexplode_outer("lines").alias("place", "l")).where("l is not null").select("doc_id", "place", "l.*")
    w = Window.partitionBy("doc_id").orderBy("place")
    before = lambda c: F.lag(c).over(w)
    same = (before("page") == F.col("page")) & (F.abs(before("cy") - F.col("cy")) < F.greatest(before("h"), F.col("h")) * 0.5)
    o = o.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("line_row", F.sum("_new").over(w))
    got = o.groupBy("doc_id", "line_row").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("t"))
    return got.select("doc_id", F.col("line_row").alias("row"), F.array_join(F.transform("t", lambda x: x["text"]), "  ").alias("text"))


def letter_height(lines: DataFrame, least: int = 4) -> DataFrame:
    """(doc_id, height): the upper median of the heights of lines of four signs or more."""
    got = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.length("text") >= least, F.col("h")))).alias("a"))
    return got.select("doc_id", F.get("a", F.floor(F.size("a") / 2).cast("int")).alias("height"))


