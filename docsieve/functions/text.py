"""Normal forms of text. They look alike and differ on purpose; each has one name."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Capital Latin letters that decompose into one ASCII letter and marks, but for Ñ, and those letters."""
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if c != "Ñ" and c.upper() == c and base != c and len(base) == 1:
            pairs[c] = base
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _accents()


#: Where all of ACCENTED lies, and marks that stand alone.
MAY_HOLD_MARKS = r"[\u00C0-\u00D0\u00D2-\u024F\u0300-\u036F\u1E00-\u1EFF]"


def fold(t: Column) -> Column:
    """Upper case without accents; Ñ stays.

    Signs are replaced one by one, which costs much, and only in texts that may hold such a sign.
    """
    def plain(u: Column) -> Column:
        return F.regexp_replace(F.translate(F.regexp_replace(u, "Ñ", "Ñ"), ACCENTED, PLAIN), "[̀-ͯ]", "")

    return let(F.upper(t), lambda u: F.when((F.octet_length(u) == F.length(u)) | ~u.rlike(MAY_HOLD_MARKS), u).otherwise(plain(u)))


def squeeze(t: Column) -> Column:
    """One blank for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def row_form(t: Column) -> Column:
    """fold, then squeeze: how rows of a document are compared."""
    return squeeze(fold(t))


def compact(t: Column) -> Column:
    """Upper case without white space, full stops and hyphens."""
    return F.regexp_replace(F.upper(t), r"(?U)[\s.\-]", "")


def zone_form(t: Column) -> Column:
    """Machine-readable characters only; what readers take for a filler becomes one."""
    return F.regexp_replace(F.translate(F.upper(t), "«‹([{¢", "<<<<<<"), "[^A-Z0-9<]", "")


def name_form(t: Column) -> Column:
    """A name as the zone spells it: letters A-Z and single blanks; null is empty."""
    return F.trim(F.regexp_replace(F.translate(row_form(F.coalesce(t, F.lit(""))), "ÑÇ", "NC"), "[^A-Z]+", " "))


def id_form(t: Column) -> Column:
    """Upper-case letters and digits only; null is empty."""
    return F.regexp_replace(F.upper(F.coalesce(t, F.lit(""))), "[^0-9A-Z]", "")


def ascii_form(t: Column) -> Column:
    """Upper case in ASCII: accents go, Ñ becomes N, other letters vanish."""
    return F.regexp_replace(F.translate(fold(t), "Ñ", "N"), r"[^\x00-\x7f]", "")


def truth_form(value: Column, field: Column) -> Column:
    """How card fields are compared with the truth: dates as dd/mm/yyyy, all else as words; null is empty."""
    v = ascii_form(value)
    t = F.trim(v)
    iso, dmy = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})$"
    two = lambda p, g: F.lpad(F.regexp_extract(t, p, g), 2, "0")
    date = (
        F.when(t.rlike(iso), F.concat_ws("/", two(iso, 3), two(iso, 2), F.regexp_extract(t, iso, 1)))
        .when(t.rlike(dmy), F.concat_ws("/", two(dmy, 1), two(dmy, 2), F.regexp_extract(t, dmy, 3)))
        .otherwise(t)
    )
    return F.coalesce(F.when(field.startswith("fecha"), date).otherwise(F.trim(F.regexp_replace(v, "[^A-Z0-9]+", " "))), F.lit(""))


def report_form(value: Column) -> Column:
    """How document fields are compared with the truth: numbers without a zero fraction, yes and no as booleans, no last full stop."""
    def words(s: Column) -> Column:
        return F.when(s.isin("TRUE", "SI"), "true").when(s.isin("FALSE", "NO"), "false").when(s.rlike(r"^-?\d+\.0+$"), F.regexp_extract(s, r"^(-?\d+)", 1)).otherwise(s)

    return let(F.rtrim(row_form(F.coalesce(value, F.lit(""))), F.lit(".")), words)


def unglue(t: Column) -> Column:
    """Puts blanks back where readers drop them: before capitals, between letters and digits, after a comma."""
    letter = "A-Za-zÁÉÍÓÚÑáéíóúñ"
    t = F.regexp_replace(t, "(?<=[a-záéíóúñ])(?=[A-ZÁÉÍÓÚÑ]{2})", " ")
    t = F.regexp_replace(t, rf"(?<=[{letter}])(?=\d)|(?<=\d)(?=[{letter}]{{2}})", " ")
    return F.regexp_replace(t, f",(?=[{letter}])", ", ")


#: Signs that count as legible beside letters and digits.
LEGIBLE_SIGNS = ".,;:-/()ºª€%'\""


def legibility(t: Column) -> Column:
    """(good, ratio): legible characters, and their share of the visible ones; nothing visible gives a ratio of 0."""
    visible = F.length(F.regexp_replace(t, r"(?U)\s", ""))
    good = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}.,;:\-/()ºª€%'" + '"' + "]", ""))
    return F.struct(good.cast("long").alias("good"), F.when(visible > 0, good / visible).otherwise(F.lit(0.0)).alias("ratio"))


#: A page has a usable text layer from so many legible characters and such a share.
DIGITAL_CHARS, DIGITAL_RATIO = 40, 0.6


def is_digital(t: Column) -> Column:
    q = legibility(t)
    return (q["good"] >= DIGITAL_CHARS) & (q["ratio"] >= DIGITAL_RATIO)


def spans(t: Column, pattern: str, group: int = 0) -> Column:
    """All matches as array<struct<pos, value>>: positions from 0, by the lengths of what lies between."""
    whole = F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1))
    value = F.regexp_extract_all(t, F.lit(pattern), F.lit(group)) if group else whole
    between = F.split(t, pattern, -1)
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    at = lambda i: total(F.slice(between, 1, i + 1)) + total(F.slice(whole, 1, i))
    return F.transform(value, lambda v, i: F.struct(at(i).alias("pos"), v.alias("value")))


def first(a: Column) -> Column:
    """First element, or null."""
    return F.get(a, F.lit(0))


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def found(t: Column, pattern: str, group: int = 0) -> Column:
    """What the first match of the pattern holds in its group; null without a match."""
    return F.when(t.rlike(pattern), F.regexp_extract(t, pattern, group))
