"""Where a value comes from: the rows and lines of a document that hold it, with confidence, page, box and origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import dates_found
from ..functions.text import first, let, row_form


def row_starts(rows: Column) -> Column:
    """Where each row begins in the running text, which is the rows with a line end between them."""
    return F.transform(rows, lambda _, i: F.aggregate(F.slice(rows, 1, i), F.lit(0), lambda s, r: s + F.length(r) + 1))


def lines_at(lines: Column, rows: Column, start: Column, end: Column) -> Column:
    """Lines of the rows that a span of the running text touches; its ends and the line end between rows count in."""
    starts = row_starts(rows)

    def inside(a: Column) -> Column:
        hit = lambda i: (F.get(a, i) <= end) & (F.get(a, i) + F.length(F.get(rows, i)) >= start)
        return F.filter(lines, lambda ln: hit(ln["row"]))

    return let(starts, inside)


def field_of(value: Column, lines: Column) -> Column:
    """A field: the value, the least confidence of its lines, page and box of the first, and the origin of most (the first seen on ties).

    Null for a value that is null or empty.
    """
    def made(a: Column) -> Column:
        count = lambda all_: F.transform(F.array_distinct(all_), lambda o, i: F.struct(F.size(F.filter(all_, lambda x: x == o)).alias("n"), (-i).alias("turn"), o.alias("origin")))
        counted = let(F.transform(a, lambda ln: ln["origin"]), count)
        top = first(a)
        box = F.when(top.isNotNull(), F.struct(*[top[c].alias(c) for c in ("x", "y", "w", "h")]))
        return F.struct(value.alias("value"), F.array_min(F.transform(a, lambda ln: ln["conf"])).alias("confidence"), top["page"].alias("page"), box.alias("box"), F.array_max(counted)["origin"].alias("origin"))

    return F.when(F.coalesce(value.cast("string"), F.lit("")) != "", let(lines, made))


def all_matches(lines: Column, rows: Column, pattern: str, group: int = 0) -> Column:
    """Every match of a pattern in the rows, with the lines of its row, in order."""
    of = lambda r, i: F.transform(F.regexp_extract_all(r, F.lit(pattern), F.lit(group)), lambda v: F.struct(v.alias("value"), F.filter(lines, lambda ln: ln["row"] == i).alias("lines")))
    return F.flatten(F.transform(rows, of))


def holding_lines(lines: Column, rows: Column, value: Column, as_of: Column) -> Column:
    """The lines of the first row that holds a value as it is written, without regard to blanks and case, or as a date."""
    tight = lambda t: F.regexp_replace(row_form(t), r"[\s.\-]", "")

    def place(sought: Column) -> Column:
        """Rows are read for dates only if a date is sought."""
        dated = lambda r: sought["day"].isNotNull() & F.exists(dates_found(r, as_of), lambda s: s["date"] == sought["day"])
        return F.array_position(F.transform(rows, lambda r: F.contains(tight(r), sought["tight"]) | F.coalesce(dated(r), F.lit(False))), True) - 1

    at = let(F.struct(tight(value).alias("tight"), value.try_cast("date").alias("day")), place)
    return let(at, lambda i: F.filter(lines, lambda ln: ln["row"] == i))


def placed_fields(documents: DataFrame, extracted: DataFrame, as_of: Column) -> DataFrame:
    """(doc_id, field, value, confidence, page, x, y, w, h, origin) of what extract() read: one row for each field.

    Fields that stand nowhere in the text, as they are computed, have nulls but for the value.
    What extract() was told to keep of ``lines`` and ``rows`` is not joined again.
    """
    own = [c for c in ("lines", "rows") if c in extracted.columns]
    d = extracted.select("doc_id", *own, F.explode_outer("fields").alias("field", "v")).where("field is not null")
    if len(own) < 2:
        d = d.select("doc_id", "field", "v").join(documents.select("doc_id", "lines", "rows"), "doc_id")
    f = d.select("doc_id", "field", field_of(F.col("v"), holding_lines(F.col("lines"), F.col("rows"), F.col("v"), as_of)).alias("f"))
    return f.select("doc_id", "field", "f.value", "f.confidence", "f.page", "f.box.x", "f.box.y", "f.box.w", "f.box.h", "f.origin")
