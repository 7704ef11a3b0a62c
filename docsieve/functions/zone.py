"""Machine-readable zones of cards: three lines of thirty characters (TD1).

Corrections are only made where a position's type is fixed, or where check digits
confirm one single result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dates import date_of, full_year
from .ids import CARD_LETTER_READ_AS, dni_letter, lookup
from .text import first, let, zone_form

LENGTH = 30
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Letters read as digits and digits read as letters in a zone.
TO_DIGIT = ("OQDUILTZSGB", "00001112568")
TO_LETTER = ("012568", "OIZSGB")
#: Signs of a field that may be swapped at once.
MAX_AMBIGUOUS = 6


def fit(t: Column) -> Column:
    return F.rpad(t, LENGTH, "<")


def check_digit(t: Column, width: int) -> Column:
    """Weights 7, 3, 1 over 0-9 and A-Z = 10-35, over the first ``width`` signs; null for null."""
    weights = F.array(F.lit(7), F.lit(3), F.lit(1))
    # locate() gives 0 for a sign that is not in the alphabet, and 1 for none
    value = lambda x, i: F.greatest(F.call_function("locate", F.substring(x, i, F.lit(1)), F.lit(ALPHABET)) - 1, F.lit(0)) * F.get(weights, (i - 1) % 3)
    return let(t, lambda x: (F.aggregate(F.sequence(F.lit(1), F.lit(width)), F.lit(0), lambda s, i: s + value(x, i)) % 10).cast("string"))


def digits(t: Column) -> Column:
    return F.translate(t, *TO_DIGIT)


def letters(t: Column) -> Column:
    return F.translate(t, *TO_LETTER)


def anchor(line: Column) -> Column:
    """Cuts what readers see before the start of the first line."""
    spanish, general = "I[D<]ESP", "[IAC][A-Z<][A-Z]{3}"

    def cut(x: Column) -> Column:
        head = F.substring(x, 1, 8)
        at = F.when(head.rlike(spanish), F.regexp_instr(head, F.lit(spanish))).when(F.length(x) > LENGTH, F.regexp_instr(head, F.lit(general))).otherwise(F.lit(0))
        return let(at, lambda p: F.when((p > 1) & (F.length(x) - p + 1 >= LENGTH - 6), F.substring(x, p, F.length(x))).otherwise(x))

    return let(line, cut)


def structure_score(l1: Column, l2: Column, l3: Column) -> Column:
    """How well three fitted lines look like a zone, 0 to 11."""
    count = lambda t, p: F.length(F.regexp_replace(t, p, ""))
    points = (
        (F.substring(l1, 1, 1).isin("I", "A", "C"), 2), (F.substring(l1, 3, 3) == "ESP", 2),
        (count(F.substring(l2, 1, 6), r"\D") >= 5, 2), (count(F.substring(l2, 9, 6), r"\D") >= 5, 2),
        (F.substring(l2, 8, 1).isin("M", "F", "<"), 1), (F.contains(l3, F.lit("<<")) & (count(l3, "[^A-Z]") >= 4), 2),
    )
    return reduce(lambda a, b: a + b, [F.when(c, p).otherwise(0) for c, p in points])


def choose_lines(candidates: Column) -> Column:
    """Of lines in reading order, the three that look most like a zone, the first on ties; null under 4 points."""
    usable = F.filter(F.transform(candidates, zone_form), lambda t: F.length(t).between(15, 34))

    def scored(u: Column) -> Column:
        def one(i: Column) -> Column:
            fitted = F.array(fit(anchor(F.get(u, i))), fit(F.get(u, i + 1)), fit(F.get(u, i + 2)))
            score = let(fitted, lambda f: structure_score(F.get(f, F.lit(0)), F.get(f, F.lit(1)), F.get(f, F.lit(2))))
            return F.struct(score.alias("score"), (-i).alias("order"), F.struct(*[F.get(u, i + k).alias(f"l{k + 1}") for k in range(3)]).alias("lines"))

        return F.when(F.size(u) >= 3, F.transform(F.sequence(F.lit(0), F.size(u) - 3), one))

    return let(F.array_max(let(usable, scored)), lambda best: F.when(best["score"] >= 4, best["lines"]))


def _grow(c: Column, swap: Column):
    """Both ways to go on from a prefix, or the only one."""
    return lambda p: F.when(swap != c, F.array(F.concat(p, c), F.concat(p, swap))).otherwise(F.array(F.concat(p, c)))


def variants(field: Column, width: int) -> Column:
    """All ways to swap letters and digits that look alike, without the field itself; none beyond MAX_AMBIGUOUS."""
    signs = "".join(TO_DIGIT[0]) + TO_LETTER[0]
    other = TO_DIGIT[1] + TO_LETTER[1]
    ambiguous = F.length(F.regexp_replace(field, f"[^{signs}]", ""))
    grown = F.array(F.lit(""))
    for i in range(width):
        c = F.substring(field, i + 1, 1)
        swap = F.translate(c, signs, other)
        grown = F.flatten(F.transform(grown, _grow(c, swap)))
    return F.when(ambiguous.between(1, MAX_AMBIGUOUS), F.filter(grown, lambda v: v != field)).otherwise(F.array().cast("array<string>"))


def mend_by_check(field: Column, control: Column, width: int) -> Column:
    """The field, or its only variant whose check digit fits where its own does not."""
    fitting = lambda f: F.filter(variants(f, width), lambda v: check_digit(v, width) == digits(control))
    return let(field, lambda f: F.when(check_digit(f, width) == digits(control), f).otherwise(let(fitting(f), lambda v: F.when(F.size(v) == 1, first(v)).otherwise(f))))


def _zone_date(t: Column, as_of: Column, future: bool) -> Column:
    y, m, d = (F.substring(t, i, 2).try_cast("int") for i in (1, 3, 5))
    year = y + 2000 if future else full_year(y, as_of, 0)
    return F.when(t.rlike(r"^\d{6}$"), date_of(year, m, d))


def parse_zone(df: DataFrame, l1: str, l2: str, l3: str, as_of: Column, out: str = "zone") -> DataFrame:
    """Adds a struct of fields, checks and the corrected lines for three lines as read.

    Staged projections keep each step's expression small; none of them is a UDF.
    Checks are a struct of booleans; ``valid`` is their conjunction. Null lines give an
    invalid zone.
    """
    s = lambda c, a, n: F.substring(c, a + 1, n)
    keep = [c for c in df.columns]
    q = lambda c: F.col(f"`{c}`")
    d = df.select(*[q(c) for c in keep], F.coalesce(anchor(zone_form(q(l1))), F.lit("")).alias("_a"), F.coalesce(zone_form(q(l2)), F.lit("")).alias("_b"), F.coalesce(zone_form(q(l3)), F.lit("")).alias("_c"))
    d = d.withColumns({"_a": fit(F.col("_a")), "_b": fit(F.col("_b")), "_c": letters(fit(F.col("_c")))})
    a, b = F.col("_a"), F.col("_b")
    d = d.withColumns({
        "_head": letters(s(a, 0, 5)), "_birth": digits(s(b, 0, 6)), "_sex": letters(s(b, 7, 1)), "_end": digits(s(b, 8, 6)), "_nation": letters(s(b, 15, 3)),
        "_cb": digits(s(b, 6, 1)), "_ce": digits(s(b, 14, 1)), "_cc": digits(s(b, 29, 1)), "_rest": s(a, 24, 6),
        "_dni": F.concat(digits(s(a, 15, 8)), letters(s(a, 23, 1))), "_read": s(a, 23, 1), "_cs": digits(s(a, 14, 1)),
    })
    spanish = s(F.col("_head"), 2, 3) == "ESP"
    d = d.withColumns({"_es": spanish})
    forced = F.concat(letters(s(a, 5, 3)), digits(s(a, 8, 6)))
    d = d.withColumns({"_support": F.when(F.col("_es"), forced).otherwise(mend_by_check(s(a, 5, 9), s(a, 14, 1), 9))})
    d = d.withColumns({
        "_l2": F.concat("_birth", "_cb", "_sex", "_end", "_ce", "_nation", s(b, 18, 11), "_cc"),
        "_tail": F.concat("_birth", "_cb", "_end", "_ce", s(b, 18, 11)),
        "_expected": dni_letter(s(F.col("_dni"), 0, 8)),
    })
    body = lambda dni: F.concat("_support", "_cs", dni, "_rest", "_tail")
    d = d.withColumns({"_c0": check_digit(body(F.col("_dni")), 50), "_fixed": F.concat(s(F.col("_dni"), 0, 8), F.coalesce("_expected", F.lit("")))})
    d = d.withColumns({"_c1": check_digit(body(F.col("_fixed")), 50)})
    options, more = lookup(CARD_LETTER_READ_AS, F.col("_read")), lookup(CARD_LETTER_READ_AS, s(F.col("_dni"), 8, 1))
    letter_ok = F.coalesce(F.col("_expected") == s(F.col("_dni"), 8, 1), F.lit(False))
    known = F.contains(F.concat(options, more), F.col("_expected"))
    mended = F.coalesce(F.col("_es") & ~letter_ok & known & (F.col("_c1") == F.col("_cc")) & (F.col("_c0") != F.col("_cc")), F.lit(False))
    d = d.withColumns({"_mended": mended})
    d = d.withColumns({"_number": F.when(F.col("_mended"), F.col("_fixed")).otherwise(F.col("_dni")), "_lok": F.col("_mended") | letter_ok, "_comp": F.when(F.col("_mended"), F.col("_c1")).otherwise(F.col("_c0"))})
    d = d.withColumns({"_db": _zone_date(F.col("_birth"), as_of, False), "_de": _zone_date(F.col("_end"), as_of, True), "_names": F.split("_c", "<<", 2)})
    word = lambda x: F.trim(F.translate(x, "<", " "))
    none = lambda x: F.when(x != "", x)
    dmy = lambda x: F.date_format(x, "dd/MM/yyyy")
    checks = F.struct(
        (F.substring("_head", 1, 1).isin("I", "A", "C") & s(F.col("_head"), 2, 3).rlike("^[A-Z]{3}$") & F.col("_nation").rlike("^[A-Z]{3}$") & F.col("_sex").isin("M", "F", "<")).alias("structure"),
        (F.col("_db").isNotNull() & F.col("_de").isNotNull()).alias("dates"),
        F.col("_c").rlike("^[A-Z]+(<[A-Z]+)*<<[A-Z]+(<[A-Z]+)*<*$").alias("name_shape"),
        (check_digit(F.col("_support"), 9) == F.col("_cs")).alias("support"),
        (check_digit(F.col("_birth"), 6) == F.col("_cb")).alias("birth"),
        (check_digit(F.col("_end"), 6) == F.col("_ce")).alias("expiry"),
        (F.col("_comp") == F.col("_cc")).alias("composite"),
        F.when(F.col("_es"), F.col("_support").rlike(r"^[A-Z]{3}\d{6}$")).alias("support_shape"),
        F.when(F.col("_es"), F.col("_lok")).alias("dni_letter"),
    )
    d = d.withColumns({"_checks": checks})
    valid = reduce(lambda x, y: x & y, [F.coalesce(F.col("_checks")[n], F.lit(n in ("support_shape", "dni_letter")) & ~F.col("_es")) for n in ("structure", "dates", "name_shape", "support", "birth", "expiry", "composite", "support_shape", "dni_letter")])
    zone = F.struct(
        F.regexp_replace(F.substring("_head", 1, 2), "<", "").alias("kind"), s(F.col("_head"), 2, 3).alias("country"), F.col("_support").alias("support"),
        F.when(F.col("_es"), F.col("_number")).alias("dni"), dmy(F.col("_db")).alias("birth_date"), F.when(F.col("_sex").isin("M", "F"), F.col("_sex")).alias("sex"),
        dmy(F.col("_de")).alias("expiry_date"), F.col("_nation").alias("nationality"), none(word(F.get("_names", F.lit(0)))).alias("surnames"), word(F.get("_names", F.lit(1))).alias("given_names"),
        F.array(F.concat("_head", "_support", "_cs", "_number", "_rest"), F.col("_l2"), F.col("_c")).alias("lines"), F.col("_checks").alias("checks"), valid.alias("valid"),
    )
    return d.select(*[q(c) for c in keep], zone.alias(out))


def versions(line: Column) -> Column:
    """A line that is too long, as it is (its end will be cut) and without each of its characters."""
    drop = F.transform(F.sequence(F.lit(1), F.length(line)), lambda i: F.concat(F.substring(line, F.lit(1), i - 1), F.substring(line, i + 1, F.length(line))))
    return F.when(F.length(line) > LENGTH, F.array_union(F.array(line), drop)).otherwise(F.array(line))


def read_zones(df: DataFrame, key: str, candidates: str, as_of: Column) -> DataFrame:
    """One row per key with candidate lines: ``zone`` (null without three lines) and ``ambiguous``.

    Lines that are too long are tried in every way to lose a character; the result
    counts only if exactly one distinct valid zone comes out. Only such rows fan out.
    """
    chosen = df.select(F.col(key).alias("_key"), choose_lines(F.col(candidates)).alias("_t"))
    base = parse_zone(chosen.select("_key", "_t", F.col("_t.l1").alias("_1"), F.col("_t.l2").alias("_2"), F.col("_t.l3").alias("_3")), "_1", "_2", "_3", as_of, "_base")
    head = anchor(F.col("_1"))
    # filters would be moved below all of these steps, and compute them once more for it: what is not long, or not valid, is null
    long_ = F.when((F.length(head) > LENGTH) | (F.length("_2") > LENGTH), versions(head))
    fan = base.select("_key", F.explode_outer(long_).alias("_1"), "_2", "_3").where("_1 is not null").select("_key", "_1", F.explode_outer(versions(F.col("_2"))).alias("_2"), "_3")
    valid = parse_zone(fan, "_1", "_2", "_3", as_of, "_z").select("_key", F.when(F.col("_z.valid"), F.col("_z")).alias("_z"))
    one = valid.groupBy("_key").agg(F.min("_z.lines").alias("_least"), F.max("_z.lines").alias("_most"), F.min("_z").alias("_only"))
    return (
        base.join(one, "_key", "left")
        .select(F.col("_key").alias(key), F.when(F.col("_t").isNull(), None).when(F.col("_least") == F.col("_most"), F.col("_only")).otherwise(F.col("_base")).alias("zone"), F.coalesce(F.col("_least") != F.col("_most"), F.lit(False)).alias("ambiguous"))
    )


def build_zone(support: Column, dni: Column, birth: Column, sex: Column, expiry: Column, surnames: Column, given: Column) -> Column:
    """The three lines of a Spanish card as a struct; dates as yyMMdd."""
    checked = F.array(fit(F.concat(F.lit("IDESP"), support, check_digit(support, 9), dni)), F.concat(birth, check_digit(birth, 6)), F.concat(expiry, check_digit(expiry, 6)))
    l3 = fit(F.concat(F.translate(surnames, " ", "<"), F.lit("<<"), F.translate(given, " ", "<")))

    def lines(x: Column) -> Column:
        l1, b, e = (F.get(x, F.lit(i)) for i in range(3))
        body = F.concat(F.substring(l1, 6, 25), b, e, F.lit("<" * 11))
        return F.struct(l1.alias("l1"), F.concat(b, sex, e, F.lit("ESP" + "<" * 11), check_digit(body, 50)).alias("l2"), l3.alias("l3"))

    return let(checked, lines)
