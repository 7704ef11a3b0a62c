"""Verification codes, and what the metadata of a PDF say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import fold, let

# Code patterns, and editors that give a warning.
CODE_PATTERNS = (
    ("CSV", r"(?:\bCODIGO\s+SEGURO\s+DE\s+VERIFICACION|\bC\.?\s?S\.?\s?V(?![A-Z]))\.?\s*(?:\(CSV\))?\s*[:.]?\s*([A-Z0-9]{4,}(?:[ \-][A-Z0-9]{4,}){0,5})"),
    ("CEA", r"(?:\bCODIGO\s+ELECTRONICO\s+DE\s+AUTENTICIDAD|\bC\.?E\.?A(?![A-Z]))\.?\s*(?:\(CEA\))?\s*[:.]?\s*([A-Z0-9]{4,}(?:[ \-][A-Z0-9]{3,}){0,6})"),
)
EDITORS = ("photoshop", "gimp", "paint", "canva", "ilovepdf", "smallpdf", "sejda", "pdfescape", "pdffiller", "sodapdf", "foxit phantompdf", "pdf-xchange editor", "inkscape")


def tight(t: Column) -> Column:
    return F.regexp_replace(t, r"[\s\-]", "")


def codes(t: Column) -> Column:
    """array<struct<kind, code>>: codes of eight signs or more with a digit, the first kind that has a code."""
    n = fold(t)

    def of(kind: str, pattern: str) -> Column:
        raw = F.transform(F.regexp_extract_all(n, F.lit(pattern), F.lit(1)), tight)
        return F.transform(F.array_distinct(F.filter(raw, lambda c: (F.length(c) >= 8) & c.rlike(r"\d"))), lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("code")))

    (a, pa), (b, pb) = CODE_PATTERNS
    one = of(a, pa)
    return F.concat(one, F.filter(of(b, pb), lambda x: ~F.exists(one, lambda y: y["code"] == x["code"])))


def confirmed(code: Column, origin: Column, readings: Column) -> Column:
    """A code has no check digit: if a reader saw it, two readings or more must all hold it."""
    held = F.filter(readings, lambda r: F.coalesce(r, F.lit("")) != "")
    return ~F.startswith(origin, F.lit("ocr:")) | ((F.size(held) >= 2) & F.forall(held, lambda r: F.contains(tight(fold(r)), code)))


def revisions(content: Column) -> Column:
    """How often a PDF was saved: ends of file, but for the extra one of a linearised file; one at least."""
    raw = F.decode(content, "ISO-8859-1")
    return F.greatest(F.lit(1), F.regexp_count(raw, F.lit("%%EOF")) - F.contains(F.substring(raw, 1, 2048), F.lit("Linearized")).cast("int"))


def signature_ranges(content: Column) -> Column:
    """array<struct<start, gap, resume, end, covers, changed_after>> of the /ByteRange arrays of a file, in their order.

    A signature vouches for its bytes from ``start`` to ``gap`` and from ``resume`` to ``end``.
    It covers the file if nothing else is in it but the gap where the signature itself
    stands. ``changed_after`` is true where bytes follow that no later signature covers,
    and null where one does: then only a validator can tell what was changed. Arrays that
    are no two intervals in a row, or go beyond the file, cover nothing.
    """
    raw, size = F.decode(content, "ISO-8859-1"), F.length(content).cast("long")
    number = r"\s*(\d{1,15})"
    found = F.regexp_extract_all(raw, F.lit(r"/ByteRange\s*\[([\d\s]+)\]"), F.lit(1))

    def of(t: Column) -> Column:
        n = [F.regexp_extract(t, "^" + number * 4 + r"\s*$", i).try_cast("long") for i in range(1, 5)]
        return F.struct(n[0].alias("start"), (n[0] + n[1]).alias("gap"), n[2].alias("resume"), (n[2] + n[3]).alias("end"))

    def judged(a: Column) -> Column:
        covers = lambda r: F.coalesce((r["start"] == 0) & (r["gap"] > 0) & (r["gap"] < r["resume"]) & (r["end"] == size), F.lit(False))
        later = lambda i: F.exists(F.slice(a, i + 2, F.size(a)), covers)
        return F.transform(a, lambda r, i: F.struct(r["start"].alias("start"), r["gap"].alias("gap"), r["resume"].alias("resume"), r["end"].alias("end"), covers(r).alias("covers"), F.when(covers(r), False).when(~later(i), True).alias("changed_after")))

    return let(F.transform(found, of), judged)


# What stands for a sign after a backslash in a literal string.
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def _string(raw: Column) -> Column:
    """The text of a string's bytes (as Latin-1): UTF-16 or UTF-8 by its mark, else Latin-1."""
    data = lambda n: F.encode(F.substring(raw, F.lit(n), F.length(raw)), "ISO-8859-1")
    return F.when(F.startswith(raw, F.lit("\xfe\xff")), F.decode(data(3), "UTF-16BE")).when(F.startswith(raw, F.lit("\xff\xfe")), F.decode(data(3), "UTF-16LE")).when(F.startswith(raw, F.lit("\xef\xbb\xbf")), F.decode(data(4), "UTF-8")).otherwise(raw)


def _unescaped(t: Column) -> Column:
    """A literal string without its brackets: backslashes stand for signs, for octal codes, or for nothing before a line end."""
    signs = F.regexp_extract_all(t, F.lit(r"(?s)\\[0-7]{1,3}|\\\r\n|\\.|[^\\]"), F.lit(0))
    code = lambda x: F.chr(F.conv(F.substring(x, F.lit(2), F.length(x)), 8, 10).cast("long") % 256)
    named = F.create_map(*[F.lit(x) for k, v in ESCAPES.items() for x in (k, v)])

    def sign(x: Column) -> Column:
        c = F.substring(x, 2, 1)
        return F.when(~F.startswith(x, F.lit("\\")), x).when(c.rlike("[0-7]"), code(x)).when(c.isin("\n", "\r"), "").otherwise(F.coalesce(F.try_element_at(named, c), c))

    return F.array_join(F.transform(signs, sign), "")


def information(content: Column, keys: tuple[str, ...] = ("Producer", "Creator", "CreationDate", "ModDate")) -> Column:
    """map<string, string> of a PDF's information dictionary, as its bytes have it: literal, hexadecimal and Unicode strings.

    The last /Info of the file counts, and the last object of that number, as saving again
    appends both. Empty values are left out, and so is all of an encrypted file or of a
    dictionary that is compressed.
    """
    raw = F.decode(content, "ISO-8859-1")
    last = lambda a: F.try_element_at(a, F.lit(-1))
    ref = last(F.regexp_extract_all(raw, F.lit(r"/Info\s+(\d+\s+\d+)\s+R"), F.lit(1)))
    pattern = F.concat(F.lit(r"(?s)(?<!\d)"), F.array_join(F.split(ref, r"\s+"), r"\s+"), F.lit(r"\s+obj(.*?)endobj"))
    body = last(F.call_function("regexp_extract_all", raw, pattern, F.lit(1)))
    inner = r"[^()\\]|\\."
    literal = rf"\(((?:{inner}|\((?:{inner}|\((?:{inner})*\))*\))*)\)"

    def value(b: Column, key: str) -> Column:
        head = rf"(?s)/{key}(?![A-Za-z0-9])\s*"
        digits = F.regexp_replace(F.regexp_extract(b, head + r"<([0-9A-Fa-f\s]*)>", 1), r"\s", "")
        padded = F.concat(digits, F.repeat(F.lit("0"), F.length(digits) % 2))
        return F.when(b.rlike(head + literal), _string(_unescaped(F.regexp_extract(b, head + literal, 1)))).when(b.rlike(head + r"<[0-9A-Fa-f\s]*>"), _string(F.decode(F.unhex(padded), "ISO-8859-1")))

    def of(b: Column) -> Column:
        pairs = F.array(*[F.struct(F.lit(k).alias("key"), value(b, k).alias("value")) for k in keys])
        return F.map_from_entries(F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != ""))

    known = F.when(~F.contains(raw, F.lit("/Encrypt")), body)
    return F.coalesce(let(known, lambda b: F.when(b.isNotNull(), of(b))), F.create_map().cast("map<string,string>"))


def metadata_warnings(producer: Column, creator: Column, saves: Column, signatures: Column) -> Column:
    """Warnings: the first known editor, saved again without a signature, broken or outdated signatures.

    signatures: array<struct<intact boolean, changed_after boolean>>.
    """
    programs = F.lower(F.concat_ws(" ", F.coalesce(producer, F.lit("")), F.coalesce(creator, F.lit(""))))
    editor = F.get(F.filter(F.array(*map(F.lit, EDITORS)), lambda e: F.contains(programs, e)), F.lit(0))
    per = F.transform(signatures, lambda s: F.when(~s["intact"], "signature_invalid").when(s["changed_after"], "changed_after_signing"))
    out = F.concat(F.array(F.concat(F.lit("editor:"), editor)), F.array(F.when((saves > 1) & (F.size(signatures) == 0), "saved_again")), per)
    return F.filter(out, lambda w: w.isNotNull())
