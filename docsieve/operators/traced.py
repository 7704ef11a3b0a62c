"""Where the rules of a type have read their values: carried from the match, and not searched for afterwards.

A place is a span of the running text, or the number of a line. Spans become rows by
the offsets of the rows, so a value that stands in several rows gets the one that its
rule has read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import dates_found
from ..functions.ids import company_ids, person_ids
from ..functions.text import first, found, let, spans
from . import extract as E
from . import field_rules as R
from . import lookup as L
from .provenance import field_of, holding_lines, lines_at, row_starts

def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(None).cast("int").alias("line"))


def _line(n: Column) -> Column:
    return F.when(n.isNotNull(), F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), n.cast("int").alias("line")))


def _row(i: Column) -> Column:
    start = F.get("starts", i)
    return F.when(i >= 0, _span(start, start + F.length(F.get("rows", i))))


def _match(pattern: str) -> Column:
    """The first match in the running text."""
    start = F.regexp_instr("text", F.lit(pattern)) - 1
    return F.when(F.col("text").rlike(pattern), _span(start, start + F.length(F.regexp_extract("text", pattern, 0))))


def phrase(pattern: str) -> Column:
    """Of lookup.phrase(): the first matching row, else the span of the running text."""
    at = F.array_position(F.transform("rows", lambda r: r.rlike(pattern)), True).cast("int") - 1
    return F.coalesce(_row(at), _match(pattern))


def after(label: str, value: str, window: int) -> Column:
    """Of lookup.after(): the value's own span."""
    def of(s: Column) -> Column:
        end = s["pos"] + F.length(s["value"])
        rest = F.substring(F.col("text"), end + 1, F.lit(window))
        start = end + F.regexp_instr(rest, F.lit(value)) - 1
        return F.when(rest.rlike(value), _span(start, start + F.length(F.regexp_extract(rest, value, 0))))

    return first(F.filter(F.transform(spans(F.col("text"), label), of), lambda v: v.isNotNull()))


def labelled(label: str, value: str | None = None, kind: str = "text", part: str | None = None) -> Column:
    return _line(L.labelled_at(label, value, lines=E.PARTS[part]() if part else None, valid=E.KINDS[kind][0])["n"])


def dated(label: str, rows: int, as_of: Column) -> Column:
    return _row(L.date_at_row(label, rows, as_of)["row"])


def document_date(as_of: Column) -> Column:
    """The row of the labelled date, else that of the first place of the date that was taken."""
    by_label = let(L.date_at_row(L.ISSUED, 2, as_of), lambda d: F.when(d["date"] <= as_of, _row(d["row"])))
    day = L.document_date(as_of)
    at = let(day, lambda x: first(F.filter(dates_found(F.col("text"), as_of), lambda s: s["date"] == x))["pos"])
    return F.coalesce(by_label, F.when(at.isNotNull(), _span(at, at + 1)))


def _holder() -> Column:
    return F.when(L.clean_name(L.phrase(R.PERSON, 2)).isNotNull(), phrase(R.PERSON)).otherwise(labelled(R.PERSON_LABELS, L.NAME))


def _person_id() -> Column:
    near = F.when(first(person_ids(found(F.col("text"), R.ID_NEAR_NAME, 2))).isNotNull(), _match(R.ID_NEAR_NAME))
    own = let(near, lambda p: F.when(p.isNotNull(), _span(p["end"] - F.length(F.regexp_extract("text", R.ID_NEAR_NAME, 2)), p["end"])))
    return F.coalesce(own, labelled(R.PERSON_ID_LABEL, R.PERSON_ID_VALUE, "person id"))


def _company_name(label: str, part: str | None) -> Column:
    named = L.company_like(L.labelled(label, lines=E.PARTS[part]() if part else None))
    by_label = F.when(F.coalesce(named, F.lit(False)), labelled(label, part=part))
    return by_label if part else F.coalesce(by_label, phrase(R.COMPANY))


def _row_with(label: str, some) -> Column:
    """The first row that holds the label and a value."""
    at = F.array_position(F.transform("rows", lambda r: r.rlike(label) & F.coalesce(some(r), F.lit(False))), True).cast("int") - 1
    return _row(at)


def _whole(name: str, label: str | None, as_of: Column) -> Column | None:
    name, _, part = name.partition(" in ")
    match name:
        case "holder" | "only_holder":
            return _holder()
        case "honorific":
            return phrase(R.PERSON)
        case "person_id":
            return _person_id()
        case "company_id":
            return labelled(R.COMPANY_ID_LABEL, R.ID_VALUE, "any id", part or None)
        case "company_name":
            return _company_name(label, part or None)
        case "document_date":
            return document_date(as_of)
        case "period_start" | "period_end" | "stated" | "degree":
            return phrase(label)
        case "only_option":
            return _match(label)
        case "largest_amount":
            return _row_with(label, lambda r: F.size(E.amounts(r)) > 0)
        case "row_date":
            return _row_with(label, lambda r: F.size(dates_found(r, as_of)) > 0)
        case "id_from":
            at = F.array_position(F.transform("rows", lambda r: r.rlike(label)), True).cast("int") - 1
            held = lambda i: F.size(F.concat(company_ids(F.get("rows", i)), person_ids(F.get("rows", i)))) > 0
            return let(at, lambda a: F.when(a >= 0, _row(first(F.filter(F.transform(F.array(*map(F.lit, range(4))), lambda j: a + j), lambda i: F.coalesce(held(i), F.lit(False)))))))
    return None


def where(rule: object, as_of: Column) -> Column:
    """The place that a rule reads, as a struct of start, end and line; null for values that are computed, or unique in the text."""
    none = F.lit(None).cast("struct<start:int,end:int,line:int>")
    match rule:
        case R.Said(patterns, _, _):
            return F.coalesce(*map(phrase, patterns))
        case R.Beside(label, value, kind, part, _):
            return labelled(label, value, kind, part)
        case R.Behind(label, value, window):
            return after(label, value, window)
        case R.Dated(label, rows):
            return dated(label, rows, as_of)
        case R.OneOf(names):
            return F.coalesce(*[phrase(r"\b" + r"\s+".join(n.split(" ")) + r"\b") for n in names])
        case R.Told(table):
            out = none
            for tests, _ in reversed(table):
                holds = F.lit(True)
                for t in tests:
                    holds = holds & E.holds(t)
                said = [t for t in tests if t not in E.CONDITIONS and not t.startswith("!")]
                out = F.when(holds, phrase(said[0]) if said else none).otherwise(out)
            return out
        case R.Whole(name, label):
            found_ = _whole(name, label, as_of)
            return none if found_ is None else found_
        case R.First(rules):
            out = none
            for r in reversed(rules):
                out = F.when(E.column(r, as_of).isNotNull(), where(r, as_of)).otherwise(out)
            return out
        case R.If(test, inner, other):
            return F.when(E.holds(test), where(inner, as_of)).otherwise(none if other is None else where(other, as_of))
    return none


def traced_fields(documents: DataFrame, kind: str, as_of: Column, fields: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, field, value, confidence, page, x, y, w, h, origin) of the fields of a type, one row for each that is read.

    The lines of a field are those of the row, of the span over rows, or the one line that
    its rule has read; of an identifier that the text holds only once, the row that holds it.
    Values that are computed have nulls but for the value.
    """
    rules = R.RULES[kind][0]
    chosen = [k for k in rules if fields is None or k in fields]
    d = E.extract(documents.withColumn("starts", row_starts(F.col("rows"))), kind, as_of, keep=("lines", "rows", "starts"))
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), F.col("fields")[k].alias("value"), where(rules[k], as_of).alias("at")) for k in chosen])
    d = d.select("doc_id", "lines", "rows", F.explode_outer(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("p")).where("p is not null").select("doc_id", "lines", "rows", "p.*")
    own = F.filter("lines", lambda ln: ln["line_no"] == F.col("at.line"))
    searched = F.col("field").isin([k for k in chosen if not isinstance(rules[k], R.Of)])
    lines = (
        F.when(F.col("at.line").isNotNull(), own).when(F.col("at.start").isNotNull(), lines_at(F.col("lines"), F.col("rows"), F.col("at.start"), F.col("at.end")))
        .when(searched, holding_lines(F.col("lines"), F.col("rows"), F.col("value"), as_of))
    )
    f = d.select("doc_id", "field", field_of(F.col("value"), lines).alias("f"))
    return f.select("doc_id", "field", "f.value", "f.confidence", "f.page", "f.box.x", "f.box.y", "f.box.w", "f.box.h", "f.origin")
