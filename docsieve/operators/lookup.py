"""Values of documents by phrase, by label and by place, as columns over layout.documents()."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dates import dates_found, first_date
from ..functions.text import first, fold, found, let, row_form, spans

# What counts as a form label, as a name, and words that no name holds.
LABEL = (
    r"^(?:(?:C\.?I\.?F|N\.?I\.?F|N\.?I\.?E|D\.?N\.?I)\.?(?:\s*/\s*[A-Z.]{2,5})*\s*:?|"
    r"(?:FECHA|N[º°O]\.?|NUMERO|DOMICILIO|DIRECCION|RAZON\s+SOCIAL|NOMBRE|APELLIDOS|PUESTO|TOMADOR|"
    r"ENTIDAD|POLIZA|NACIONALIDAD|MUNICIPIO|CODIGO\s+POSTAL|PAIS|NIVEL\s+FORMATIVO|FIRMA|D\./DÑA\.)(?![A-Z])[^0-9]{0,45})$"
)
GLUED_LABELS = (
    "NOMBREORAZONSOCIAL", "RAZONSOCIAL", "NOMBREYAPELLIDOS", "APELLIDOSYNOMBRE", "TOMADORDELSEGURO", "ENTIDADASEGURADORA", "DIRECCIONDELAOBRA",
    "FECHADE", "DOMICILIOSOCIAL", "CODIGOPOSTAL", "NIVELFORMATIVO", "CIFNIF", "NIFNIE",
)
NUM = r"(?:NUMERO|\bN\s?[º°O'?*\"9]?\.?)"
TITLE = r"(?: (?:[A-ZÑ]{2,}|Y|E)(?= |$|[,.;:)\n]))+"
_WORD = r"(?!(?:CON|NIF|DNI|NIE|CUYO|CUYA|QUE|HA|EN|MAYOR|TITULAR|PROVISTO|PROVISTA|NACIDO|NACIDA)\b)[A-ZÑ][A-ZÑ'\-]+"
NAME = rf"({_WORD}(?:,?\s+(?:DE\s+LA\s+|DE\s+LOS\s+|DEL\s+|DE\s+|Y\s+)?{_WORD}){{1,6}})"
NOT_NAMES = (
    "FECHA", "NACIMIENTO", "NIF", "NIE", "DNI", "DOMICILIO", "MUNICIPIO", "NACIONALIDAD", "CODIGO", "POSTAL", "PAIS", "NIVEL", "FORMATIVO", "EMPRESA", "FIRMA", "DATOS", "SOCIAL", "CUENTA",
    "REGIMEN", "CALIDAD", "CONCEPTO", "ACTIVIDAD", "RAZON", "CENTRO", "TRABAJO", "SEGURIDAD", "CURSO", "PREVENCION", "RIESGOS", "LABORALES", "TITULO", "UNIVERSIDAD", "MASTER", "TECNICO",
    "SUPERIOR", "CERTIFICADO", "CERTIFICA", "REGISTRO", "SERVICIO", "PERSONA", "TRABAJADORA", "TRABAJADOR", "RESPONSABLE", "PROYECTO", "GRUPO", "NOMBRE", "APELLIDOS", "TELEFONO", "CORREO",
    "LEY", "ARTICULO", "DECRETO", "REAL", "CONVENIO", "ORDEN", "RESOLUCION", "SOCIEDAD", "SL", "SA",
)
PARTICLES = ("DE", "LA", "DEL", "LOS", "LAS", "Y", "E", "EL")
LEGAL_FORM = r"(?:S\.?\s?L\.?\s?(?:U|L|N\.?E)?|S\.?\s?A\.?\s?U?|S\.?\s?COOP\.?(?:\s?AND|\s?V)?|C\.?\s?B|S\.?\s?C|A\.?\s?I\.?\s?E)\.?"
EDGE = " :.-\t|[]_'`\",;!¡"


def phrase(pattern: str, group: int = 1) -> Column:
    """What the first matching row holds, else the running text, where a sentence may be broken over two rows."""
    return F.coalesce(first(F.transform(F.filter("rows", lambda r: r.rlike(pattern)), lambda r: F.regexp_extract(r, pattern, group))), found(F.col("text"), pattern, group))


def says(pattern: str) -> Column:
    return F.exists("rows", lambda r: r.rlike(pattern)) | F.col("text").rlike(pattern)


def after(label: str, value: str, window: int = 250) -> Column:
    """The first value within ``window`` signs after a label in the running text."""
    behind = F.regexp_extract_all("text", F.lit(rf"(?s)(?:{label})(?=(.{{0,{window}}}))"), F.lit(_groups(label) + 1))
    return first(F.filter(F.transform(behind, lambda t: found(t, value, 1)), lambda v: v.isNotNull()))


def is_label(t: Column) -> Column:
    """A form's label rather than a value, also with its words glued together."""
    def test(n: Column) -> Column:
        glued = F.regexp_replace(n, "[^A-ZÑ]", "")
        known = F.exists(F.array(*map(F.lit, GLUED_LABELS)), lambda e: F.startswith(glued, e) & (F.length(glued) <= F.length(e) + 12))
        return n.rlike(LABEL) | known

    return let(row_form(t), test)


def labelled(label: str, value: str | None = None, rows_below: float = 3.0, lines: Column | None = None, valid: Callable[[Column], Column] | None = None) -> Column:
    """The value of labelled_at()."""
    return labelled_at(label, value, rows_below, lines, valid)["value"]


def labelled_at(label: str, value: str | None = None, rows_below: float = 3.0, lines: Column | None = None, valid: Callable[[Column], Column] | None = None) -> Column:
    """(value, n): the value beside a label, behind it in its line, else to its right, else below it, and the number of its line.

    A label without a colon with something right below it is a form's box: then below
    comes before right. What is a label itself is no value; where a line does not fit,
    its other reading is tried. Labels are tried in reading order.
    """
    all_ = F.col("lines") if lines is None else lines

    def accept(t: Column) -> Column:
        def test(x: Column) -> Column:
            usable = (F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", "")) >= 2) & ~is_label(x)
            got = x if value is None else let(row_form(x), lambda n: found(n, value, 1 if "(" in value.replace("(?", "") else 0))
            got = F.when(usable, got)
            return F.when(F.coalesce(got, F.lit("")) != "", got) if valid is None else let(got, lambda g: F.when((F.coalesce(g, F.lit("")) != "") & valid(g), g))

        return let(F.btrim(t, F.lit(EDGE)), test)

    def of(ln: Column) -> Column:
        rest = F.regexp_extract(ln["norm"], rf"(?s)(?:{label})(.*)", _groups(label) + 1)
        tall = F.greatest(ln["h"], F.lit(0.008))
        other = lambda o: (o["line_no"] != ln["line_no"]) & (o["page"] == ln["page"])
        right = F.filter(all_, lambda o: other(o) & (F.abs(o["cy"] - ln["cy"]) < tall * 0.7) & (o["x"] >= ln["x"] + ln["w"] - tall))
        below = F.filter(all_, lambda o: other(o) & (o["y"] - ln["y"] > 0) & (o["y"] - ln["y"] <= tall * (rows_below + 1)) & (o["x"] < ln["x"] + ln["w"] + 0.15) & (o["x"] + o["w"] > ln["x"] - 0.02))
        boxed = ~F.endswith(F.rtrim(ln["norm"]), F.lit(":")) & F.exists(below, lambda o: (F.abs(o["x"] - ln["x"]) < 0.03) & (o["y"] - ln["y"] - ln["h"] < tall * 2.5))
        keyed = lambda a, *k: F.transform(F.array_sort(F.transform(a, lambda o: F.struct(*[f(o).alias(f"k{i}") for i, f in enumerate(k)], o["line_no"].alias("n"), o["text"].alias("text"), o["alt"].alias("alt"), o["norm"].alias("norm")))), lambda s: F.struct(s["text"].alias("text"), s["alt"].alias("alt"), s["norm"].alias("norm"), s["n"].alias("n")))
        to_right, under = keyed(right, lambda o: o["x"]), keyed(below, lambda o: o["y"], lambda o: F.abs(o["x"] - ln["x"]))
        tried = F.when(boxed, F.concat(under, to_right)).otherwise(F.concat(to_right, under))
        said = lambda t, n: F.struct(accept(t).alias("value"), n.alias("n"))
        others = F.flatten(F.transform(F.filter(tried, lambda o: ~o["norm"].rlike(label)), lambda o: F.array(said(o["text"], o["n"]), said(o["alt"], o["n"]))))
        return first(F.filter(F.concat(F.array(said(rest, ln["line_no"])), others), lambda v: v["value"].isNotNull()))

    hits = F.transform(F.filter(all_, lambda ln: ln["norm"].rlike(label)), of)
    return first(F.filter(hits, lambda v: v.isNotNull()))


def _groups(pattern: str) -> int:
    return re.compile(pattern).groups


def section(start: str, end: str | None) -> Column:
    """The lines strictly between the first line that matches start and the next that matches end."""
    at = F.array_position(F.transform("lines", lambda ln: ln["norm"].rlike(start)), True)
    rest = F.when(at > 0, F.slice("lines", at.cast("int") + 1, F.size("lines"))).otherwise(F.slice("lines", 1, 0))
    if end is None:
        return rest
    stop = lambda a: F.array_position(F.transform(a, lambda ln: ln["norm"].rlike(end)), True).cast("int")
    return let(rest, lambda a: F.when(stop(a) > 0, F.slice(a, 1, stop(a) - 1)).otherwise(a))


def clean_name(t: Column) -> Column:
    """A name with single blanks and ", "; null for what is hardly one."""
    n = F.btrim(F.regexp_replace(F.trim(F.regexp_replace(t, r"\s+", " ")), r"\s*,\s*", ", "), F.lit(" ,."))

    def test(x: Column) -> Column:
        words = F.filter(F.split(x, r"[\s,]+"), lambda w: w != "")
        plain = F.transform(words, fold)
        real = F.filter(plain, lambda w: ~w.isin(*PARTICLES))
        ok = F.size(words).between(2, 7) & ~F.exists(words, lambda w: F.length(w) > 20) & ~x.rlike(r"\d") & ~F.arrays_overlap(plain, F.array(*map(F.lit, NOT_NAMES))) & (F.size(real) >= 2)
        return F.when(ok, x)

    return let(n, test)


def company_like(t: Column) -> Column:
    """Two words of letters at least, or a legal form; an end of one or two letters that is none is a misreading."""
    def test(n: Column) -> Column:
        words = F.split(F.trim(F.regexp_replace(F.replace(n, F.lit(","), F.lit(" ")), r"\s+", " ")), " ")
        last = F.regexp_replace(F.get(words, F.size(words) - 1), "[^A-Z0-9Ñ]", "")
        legal = n.rlike(rf"\b{LEGAL_FORM}$")
        many = F.size(F.regexp_extract_all(n, F.lit("([A-ZÑ]{2,})"), F.lit(1))) >= 2
        return F.length(n).between(4, 90) & ~is_label(n) & ~((F.size(words) >= 3) & (F.length(last) <= 2) & ~legal) & (many | legal)

    return let(row_form(t), test)


def date_at(pattern: str, rows: int, as_of: Column) -> Column:
    """The date of date_at_row()."""
    return date_at_row(pattern, rows, as_of)["date"]


def date_at_row(pattern: str, rows: int, as_of: Column) -> Column:
    """(date, row): the first date after the pattern in its row, else in the next rows, there only below the label's own column."""
    def of(i: Column) -> Column:
        r = F.get("rows", i)
        rest = F.regexp_extract(r, rf"(?:{pattern})(.*)", _groups(pattern) + 1)
        mark = first(F.filter("lines", lambda ln: (ln["row"] == i) & ln["norm"].rlike(pattern)))
        dates = [first_date(rest, as_of), *[first_date(_under(mark, i, j), as_of) for j in range(1, rows + 1)]]
        return first(F.filter(F.array(*[F.struct(d.alias("date"), (i + j).alias("row")) for j, d in enumerate(dates)]), lambda s: s["date"].isNotNull()))

    hits = F.filter(F.transform("rows", lambda r, i: F.when(r.rlike(pattern), i)), lambda i: i.isNotNull())
    return first(F.filter(F.transform(hits, of), lambda v: v.isNotNull()))


def _under(mark: Column, i: Column, j: int) -> Column:
    def text(m: Column) -> Column:
        inside = lambda o: m.isNull() | ((o["x"] < m["x"] + m["w"]) & (o["x"] + o["w"] > m["x"]))
        return F.array_join(F.transform(F.filter("lines", lambda o: (o["row"] == i + j) & inside(o)), lambda o: o["text"]), " ")

    return let(mark, text)


#: Dates that are not the document's own, and labels of the one that is.
NOT_ITS_DATE = (
    r"(?:NACID[OA]\s+(?:EL\s+)?(?:DIA\s+)?|FECHA\s+(?:DE\s+)?(?:APROB|REVIS|VERSI|EDICI|ACTUALIZ)\w*\W{0,4}|"
    r"\b(?:REVISION|VERSION|EDICION)\s*:?\s*\w{0,3}\W{0,4})"
)
ISSUED = r"\b(?:FECHA\s+DE\s+(?:EXPEDICION|EMISION)|EXPEDID[OA]\s+(?:EN|EL)|EMITID[OA]\s+(?:EN|EL)|DADO\s+EN|EXPIDE|FIRMADO\s+EN|FECHA\s*:)"
ISSUE_LABEL = r"\b(?:DADO\s+EN|FECHA\s+DE\s+(?:EXPEDICION|EMISION)|EXPEDID[OA]\s+(?:EN|EL))"


def document_date(as_of: Column) -> Column:
    """The labelled date of issue; with a label that cannot be read, none; else the latest date since 1950 that is not another's."""
    labelled_ = let(date_at(ISSUED, 2, as_of), lambda d: F.when(d <= as_of, d))

    def latest(others: Column) -> Column:
        own = F.filter(dates_found(F.col("text"), as_of), lambda s: s["date"].between(F.lit("1950-01-01").cast("date"), as_of) & ~F.exists(others, lambda e: (s["pos"] - e).between(0, 3)))
        return F.array_max(F.transform(own, lambda s: s["date"]))

    ends = F.transform(spans(F.col("text"), NOT_ITS_DATE), lambda s: s["pos"] + F.length(s["value"]))
    return F.coalesce(labelled_, F.when(~F.col("text").rlike(ISSUE_LABEL), let(ends, latest)))
