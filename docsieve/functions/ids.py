"""Spanish identifiers with their check letters and digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact, first, let, row_form

# Check letters and what readers confuse.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
CIF_LETTERS = "JABCDEFGHI"
CIF_DIGIT_ONLY, CIF_LETTER_ONLY = "ABEH", "KPQS"
#: A check letter read as a digit, in documents.
LETTER_READ_AS = {"0": "D", "8": "B", "5": "S", "2": "Z", "6": "G", "1": "T", "4": "A", "7": "T", "3": "B"}
#: The first letter of a company id read as a digit.
INITIAL_READ_AS = {"8": "B", "6": "G", "0": "D", "5": "S", "4": "A", "3": "B", "2": "Z"}
#: A check letter read as another sign, on cards.
CARD_LETTER_READ_AS = {"0": "DQ", "O": "DQ", "Q": "D", "D": "Q", "1": "TL", "I": "TL", "7": "T", "4": "A", "8": "B", "5": "S", "2": "Z", "6": "G"}
#: Digits read as letters and letters read as digits, on card fronts.
FRONT_TO_DIGIT = ("OQDIL|ZSGBT", "00011125687")
FRONT_TO_LETTER = ("012568", "OIZSGB")
PERSON_PATTERN = r"(?<![A-Z0-9.])((?:[XYZ][\s.\-]?\d{7}|\d{1,2}[\s.]?\d{3}[\s.]?\d{3})[\s\-]?[A-Z])(?![A-Z0-9])"
COMPANY_PATTERN = r"(?<![A-Z0-9])([ABCDEFGHJKLMNPQRSUVW][\s\-]?\d{2}[\s.]?\d{3}[\s.]?\d{2}[\s\-]?[0-9A-J])(?![A-Z0-9])"


def dni_letter(number: Column) -> Column:
    """Check letter of eight digits; null for anything else."""
    return F.when(number.rlike(r"^\d{8}$"), F.substring(F.lit(DNI_LETTERS), (F.try_to_number(number, F.lit("99999999")).cast("int") % 23) + 1, F.lit(1)))


def person_id_ok(value: Column) -> Column:
    """DNI or NIE with the right check letter."""
    def test(v: Column) -> Column:
        digits = F.concat(F.translate(F.substring(v, 1, 1), "XYZ", "012"), F.substring(v, 2, 7))
        return v.rlike(r"^(?:\d{8}|[XYZ]\d{7})[A-Z]$") & F.coalesce(let(digits, dni_letter) == F.substring(v, 9, 1), F.lit(False))

    return let(compact(value), test)


def company_id_ok(value: Column) -> Column:
    """CIF with its check digit or letter, whichever its initial asks for."""
    def test(v: Column) -> Column:
        # the digit sums of odd places are doubled: 0 2 4 6 8 1 3 5 7 9
        digit = lambda i: F.substring(v, i + 1, 1).try_cast("int")
        doubled = lambda i: F.substring(F.lit("0246813579"), digit(i) + 1, F.lit(1)).try_cast("int")
        total = digit(2) + digit(4) + digit(6) + doubled(1) + doubled(3) + doubled(5) + doubled(7)
        last, initial = F.substring(v, 9, 1), F.substring(v, 1, 1)

        def kind(control: Column) -> Column:
            by_digit, by_letter = last == control.cast("string"), last == F.substring(F.lit(CIF_LETTERS), control + 1, F.lit(1))
            return F.when(initial.isin(*CIF_DIGIT_ONLY), by_digit).when(initial.isin(*CIF_LETTER_ONLY), by_letter).otherwise(by_digit | by_letter)

        return v.rlike(r"^[ABCDEFGHJKLMNPQRSUVW]\d{7}[0-9A-J]$") & F.coalesce(let((10 - total % 10) % 10, kind), F.lit(False))

    return let(compact(value), test)


def lookup(table: dict[str, str], key: Column) -> Column:
    """The table's text for a key; empty for any other."""
    place = F.array_position(F.array(*map(F.lit, table)), key).cast("int")
    return F.coalesce(F.get(F.array(*map(F.lit, table.values())), place - 1), F.lit(""))


def any_id_ok(value: Column) -> Column:
    """Either kind; null for no value."""
    return F.when(F.coalesce(value, F.lit("")) != "", company_id_ok(value) | person_id_ok(value))


def _repaired(t: Column, pattern: str, options: dict[str, str], at_end: bool, ok) -> Column:
    """Matches of the pattern with one sign replaced, where the check then holds; the first option that does."""
    found = F.regexp_extract_all(compact(t), F.lit(pattern), F.lit(1))

    def mend(v: Column) -> Column:
        letters = lookup(options, F.substring(v, -1, 1) if at_end else F.substring(v, 1, 1))
        spelled = lambda c: F.concat(F.substring(v, 1, 8), c) if at_end else F.concat(c, F.substring(v, 2, 8))
        tried = F.transform(F.filter(F.split(letters, ""), lambda c: c != ""), spelled)
        return first(F.filter(tried, ok))

    return F.filter(F.transform(found, mend), lambda v: v.isNotNull())


def person_ids(t: Column, repair: bool = False) -> Column:
    """All valid DNI and NIE in order, each once; old seven-digit numbers get a zero in front.

    With ``repair``, and only if none is found, check letters read as digits are put
    right where the check then confirms them.
    """
    raw = F.transform(F.regexp_extract_all(F.upper(t), F.lit(PERSON_PATTERN), F.lit(1)), compact)
    out = F.array_distinct(F.filter(F.transform(raw, lambda v: F.when(v.rlike(r"^\d"), F.lpad(v, 9, "0")).otherwise(v)), person_id_ok))
    if not repair:
        return out
    return F.when(F.size(out) > 0, out).otherwise(_repaired(t, r"(?<![A-Z0-9])((?:[XYZ]\d{7}|\d{8})[0-9A-Z])(?![A-Z0-9])", LETTER_READ_AS, True, person_id_ok))


def company_ids(t: Column, repair: bool = False) -> Column:
    """All valid CIF in order, each once; ``repair`` as in person_ids, for the initial."""
    out = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(F.upper(t), F.lit(COMPANY_PATTERN), F.lit(1)), compact), company_id_ok))
    if not repair:
        return out
    return F.when(F.size(out) > 0, out).otherwise(_repaired(t, r"(?<![A-Z0-9])([0-9A-Z]\d{7}[0-9A-J])(?![A-Z0-9])", INITIAL_READ_AS, False, company_id_ok))


def id_of(t: Column) -> Column:
    """The company or person id in a value read beside its label."""
    return F.coalesce(first(company_ids(t)), first(person_ids(t)), first(company_ids(t, True)), first(person_ids(t, True)))


def card_number(t: Column) -> Column:
    """(dni, ok) from a card front: the first whose letter fits or is a known misreading of it, else the first of that shape."""
    n = F.regexp_replace(row_form(t), "DNI", " ")
    found = F.regexp_extract_all(n, F.lit(r"(?<![0-9])([0-9OQDILSZGBT|]{8}\s?-?\s?[A-Z0-9])(?![0-9A-Z])"), F.lit(1))

    def judge(v: Column) -> Column:
        raw, last = F.substring(v, 1, 8), F.substring(v, -1, 1)
        number = F.translate(raw, *FRONT_TO_DIGIT)
        expected = dni_letter(number)
        options = lookup(CARD_LETTER_READ_AS, last)
        ok = (last == expected) | F.contains(options, expected)
        usable = (F.length(F.regexp_replace(raw, r"\D", "")) >= 5) & expected.isNotNull()
        return F.when(usable, F.struct(F.concat(number, F.when(ok, expected).otherwise(last)).alias("dni"), ok.alias("ok")))

    judged = F.filter(F.transform(found, judge), lambda x: x.isNotNull())
    return F.coalesce(first(F.filter(judged, lambda x: x["ok"])), first(judged))


def support_number(t: Column) -> Column:
    """Three letters and six digits of a card front; glued to other text only with two real letters."""
    n = F.regexp_replace(row_form(t), "IDESP", " ")

    def pick(tail: str, letters: int) -> Column:
        found = F.regexp_extract_all(n, F.lit(r"(?<![0-9A-Z])([A-Z0-9]{3}\s?[0-9OQDILSZGB]{6})" + tail), F.lit(1))

        def judge(v: Column) -> Column:
            a, d = F.substring(v, 1, 3), F.substring(v, -6, 6)
            word = F.translate(a, *FRONT_TO_LETTER)
            good = word.rlike("^[A-Z]{3}$") & (F.length(F.regexp_replace(d, r"\D", "")) >= 4) & (F.length(F.regexp_replace(a, "[^A-Z]", "")) >= letters)
            return F.when(good, F.concat(word, F.translate(d, *FRONT_TO_DIGIT)))

        return first(F.filter(F.transform(found, judge), lambda x: x.isNotNull()))

    return F.coalesce(pick("(?![0-9A-Z])", 0), pick("", 2))
