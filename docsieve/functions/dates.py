"""Dates, amounts and periods in Spanish text. ``as_of`` stands for today, so that results do not change with the day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first, fold, found, row_form, spans

# Month names, and number words of validity periods.
MONTHS = ("ENERO", "FEBRERO", "MARZO", "ABRIL", "MAYO", "JUNIO", "JULIO", "AGOSTO", "SEPTIEMBRE", "SETIEMBRE", "OCTUBRE", "NOVIEMBRE", "DICIEMBRE")
MONTH_NUMBER = (1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 10, 11, 12)
PERIOD_WORDS = {"UNO": 1, "UN": 1, "TRES": 3, "SEIS": 6, "DOCE": 12, "DIECIOCHO": 18, "VEINTICUATRO": 24}
NUMERIC_DATE = r"(?<!\d)\d{1,2}\s*[/\-.]\s*\d{1,2}\s*[/\-.]\s*(?:\d{4}|\d{2})(?!\d)"
WRITTEN_DATE = rf"(?<!\d)\d{{1,2}}\s*(?:DE\s*)?(?:{'|'.join(MONTHS)})\s*(?:DEL|DE)?\s*\d{{4}}(?!\d)"
AMOUNT = r"(?:\d{1,3}(?:[.\s]\d{3})+|\d+)(?:,\d{1,2})?\s*(?:€|\bEUROS?\b|\bEUR\b)"


def full_year(y: Column, as_of: Column, ahead: int = 1) -> Column:
    """Two digits mean 2000s up to ``ahead`` years after as_of, else 1900s."""
    return F.when(y >= 100, y).when(y <= F.year(as_of) % 100 + ahead, y + 2000).otherwise(y + 1900)


def date_of(y: Column, m: Column, d: Column) -> Column:
    """Null for a day that does not exist."""
    return F.try_to_timestamp(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), F.lit("yyyy-MM-dd")).cast("date")


def _number(t: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(t, pattern, group).try_cast("int")


def dates_found(t: Column, as_of: Column) -> Column:
    """Dates as array<struct<pos, date>> in the order of their positions; days that do not exist are left out."""
    t = fold(t)
    numeric = r"(\d+)\s*[/\-.]\s*(\d+)\s*[/\-.]\s*(\d+)"
    a = F.transform(spans(t, NUMERIC_DATE), lambda s: F.struct(s["pos"].alias("pos"), date_of(full_year(_number(s["value"], numeric, 3), as_of), _number(s["value"], numeric, 2), _number(s["value"], numeric, 1)).alias("date")))
    written = rf"^(\d+)\s*(?:DE\s*)?({'|'.join(MONTHS)})\s*(?:DEL|DE)?\s*(\d+)$"

    def named(s: Column) -> Column:
        place = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(s["value"], written, 2)).cast("int")
        month = F.get(F.array(*map(F.lit, MONTH_NUMBER)), place - 1)
        return F.struct(s["pos"].alias("pos"), date_of(_number(s["value"], written, 3), month, _number(s["value"], written, 1)).alias("date"))

    b = F.transform(spans(t, WRITTEN_DATE), named)
    return F.array_sort(F.filter(F.concat(a, b), lambda s: s["date"].isNotNull()))


def first_date(t: Column, as_of: Column) -> Column:
    return first(dates_found(t, as_of))["date"]


def card_dates(t: Column) -> Column:
    """Dates of a card front, ddmmyyyy with up to two signs between, as dd/mm/yyyy."""
    p = r"(?<!\d)(\d{2}[ ./-]{0,2}\d{2}[ ./-]{0,2}\d{4})(?!\d)"
    digits = F.transform(F.regexp_extract_all(row_form(t), F.lit(p), F.lit(1)), lambda v: F.regexp_replace(v, r"\D", ""))
    real = F.filter(digits, lambda v: F.try_to_timestamp(v, F.lit("ddMMyyyy")).isNotNull())
    return F.transform(real, lambda v: F.concat_ws("/", F.substring(v, 1, 2), F.substring(v, 3, 2), F.substring(v, 5, 4)))


def amounts(t: Column) -> Column:
    """Amounts in euros with full stops between thousands and a comma before cents."""
    whole = F.regexp_extract_all(F.upper(t), F.lit(f"({AMOUNT})"), F.lit(1))
    return F.transform(whole, lambda v: F.regexp_replace(F.regexp_replace(F.regexp_extract(v, r"^([\d.\s]*\d(?:,\d{1,2})?)", 1), r"[.\s]", ""), ",", ".").cast("double"))


def stated_months(t: Column, default: int = 6) -> Column:
    """(months, stated) of a validity period."""
    word = found(t, rf"VALIDEZ\s+(?:DE|POR|DURANTE)\s+(?:UN\s+PERIODO\s+DE\s+)?(\d{{1,2}}|{'|'.join(PERIOD_WORDS)})\s+MES", 1)
    n = word.try_cast("int")
    for w, v in PERIOD_WORDS.items():
        n = F.when(word == w, v).otherwise(n)
    return F.struct(F.coalesce(n, F.lit(default)).alias("months"), n.isNotNull().alias("stated"))


def add_months(d: Column, months: Column) -> Column:
    """The same day, or the last one of a shorter month."""
    return F.add_months(d, months)


def in_force(since: Column, until: Column, as_of: Column) -> Column:
    """Null without an end; no start counts as begun."""
    return F.when(until.isNotNull(), (since.isNull() | (since <= as_of)) & (as_of <= until))
