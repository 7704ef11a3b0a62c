"""Tables of cases for the column functions."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docsieve.functions import dates, ids, text, zone

AS_OF = "2026-06-30"


def one(spark, make, *values):
    df = spark.createDataFrame([values], ", ".join(f"v{i} string" for i in range(len(values))))
    return df.select(make(*[F.col(f"v{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(("value", "ok"), [("12345678Z", True), ("12.345.678-z", True), ("12345678A", False), ("X1234567L", True), ("1234567Z", False), ("", False), (None, None)])
def test_person_id(spark, value, ok):
    assert one(spark, ids.person_id_ok, value) in (ok, False if ok is None else ok)


@pytest.mark.parametrize(("value", "ok"), [("B12345674", True), ("B12345675", False), ("Q1863001B", True), ("B-12345674", True), ("T12345674", False)])
def test_company_id(spark, value, ok):
    assert one(spark, ids.company_id_ok, value) is ok


def test_search_and_repair(spark):
    assert one(spark, ids.person_ids, "con NIF 12.345.678-Z y 12345678Z; 1.234.567-L") == ["12345678Z", "01234567L"]
    assert one(spark, lambda t: ids.person_ids(t, True), "971871300") == ["97187130D"]
    assert one(spark, lambda t: ids.company_ids(t, True), "812345674") == ["B12345674"]
    assert one(spark, ids.id_of, "CIF B12345674") == "B12345674"
    assert one(spark, ids.person_ids, "12345678A") == []


def test_card_front(spark):
    assert tuple(one(spark, ids.card_number, "DNI99999999R")) == ("99999999R", True)
    assert tuple(one(spark, ids.card_number, "9999999B R")) == ("99999998R", False)
    assert one(spark, ids.support_number, "BAA000589") == "BAA000589"
    assert one(spark, ids.support_number, "ABC12345602 10 2024") == "ABC123456"
    assert one(spark, ids.support_number, "APELLIDOS") is None


@pytest.mark.parametrize(
    ("t", "want"),
    [("el 14/03/2025", dt.date(2025, 3, 14)), ("a 14 de marzo de 2025", dt.date(2025, 3, 14)), ("3 DEMAYO DE1985", dt.date(1985, 5, 3)), ("31/02/2025", None), ("1-1-27", dt.date(2027, 1, 1)), ("1-1-28", dt.date(1928, 1, 1)), ("nada", None)],
)
def test_dates(spark, t, want):
    assert one(spark, lambda c: dates.first_date(c, F.lit(AS_OF).cast("date")), t) == want


def test_dates_have_places(spark):
    got = one(spark, lambda c: dates.dates_found(c, F.lit(AS_OF).cast("date")), "1/2/2020 y 3 de abril de 2021")
    assert [(r["pos"], r["date"]) for r in got] == [(0, dt.date(2020, 2, 1)), (11, dt.date(2021, 4, 3))]


@pytest.mark.parametrize(("t", "want"), [("600.000,00 €", [600000.0]), ("1.200.000 euros", [1200000.0]), ("50 EUR y 7,5 €", [50.0, 7.5]), ("12 horas", [])])
def test_amounts(spark, t, want):
    assert one(spark, dates.amounts, t) == want


def test_forms(spark):
    assert one(spark, text.fold, "Árbol Ñandú ü ç") == "ARBOL ÑANDU U C"
    assert one(spark, text.name_form, "Muñoz-Pérez, Çan") == "MUNOZ PEREZ CAN"
    assert one(spark, text.zone_form, "id esp« (x") == "IDESP<<X"
    assert one(spark, text.unglue, "conDNI1.234.567-L,de1985") == "con DNI 1.234.567-L, de 1985"
    assert one(spark, text.report_form, "S.A.U.") == "S.A.U"
    assert one(spark, text.report_form, "60.0") == "60"
    assert one(spark, text.truth_form, "2025-3-7", "fecha_nacimiento") == "07/03/2025"
    assert one(spark, text.truth_form, "Muñoz, Ana", "nombre") == "MUNOZ ANA"


@pytest.mark.parametrize(("t", "want"), [("520727", "3"), ("L898902C3", "6"), ("<<<", "0")])
def test_check_digit(spark, t, want):
    assert one(spark, lambda c: zone.check_digit(c, 9), t) == want


SAMPLE = ["IDESPBAA000589599999999R<<<<<<", "8001014F3101012ESP<<<<<<<<<<<5", "ESPANOLA<ESPANOLA<<CARMEN<<<<<"]


def read(spark, *lines):
    df = spark.createDataFrame([(1, list(lines))], "k int, c array<string>")
    return zone.read_zones(df, "k", "c", F.lit(AS_OF).cast("date")).first()


def test_zone(spark):
    z = read(spark, "ruido", *SAMPLE)["zone"]
    assert z["valid"] and (z["dni"], z["support"], z["birth_date"], z["expiry_date"], z["surnames"], z["given_names"]) == ("99999999R", "BAA000589", "01/01/1980", "01/01/2031", "ESPANOLA ESPANOLA", "CARMEN")


@pytest.mark.parametrize(
    ("lines", "valid"),
    [
        ([SAMPLE[0].replace("000", "OOO"), *SAMPLE[1:]], True), ([SAMPLE[0].replace("589", "588"), *SAMPLE[1:]], False), ([SAMPLE[0], SAMPLE[1].replace("800101", "800102"), SAMPLE[2]], False),
        (["II" + SAMPLE[0], *SAMPLE[1:]], True), ([SAMPLE[0].replace("<", "«"), *SAMPLE[1:]], True), ([SAMPLE[0].rstrip("<"), *SAMPLE[1:]], True), (SAMPLE[:2], None),
    ],
)
def test_zone_corruptions(spark, lines, valid):
    z = read(spark, *lines)["zone"]
    assert (z is None) if valid is None else z["valid"] is valid


def test_plan_has_no_python(spark, sf):
    from docsieve.plans import registry

    for name in ("mrz_parse_valid", "classify_top3", "verify_decision"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_zones_are_not_parsed_once_more_for_a_filter(spark):
    """What is too long, or not valid, is null in its column: a filter would compute the whole zone again below the exchange."""
    df = spark.createDataFrame([(1, ["A", "B", "C"])], "k long, c array<string>").repartition(3)
    plan = zone.read_zones(df, "k", "c", F.to_date(F.lit("2026-06-30")))._jdf.queryExecution().optimizedPlan().toString()
    assert not [ln for ln in plan.splitlines() if "Filter" in ln and ("rpad(" in ln or "translate(" in ln)]


def test_fold_replaces_signs_only_where_some_may_be(spark):
    import re
    import unicodedata

    may = re.compile(text.MAY_HOLD_MARKS)
    assert all(may.match(c) for c in text.ACCENTED) and not may.search("MUÑOZ Nº 1 ABC")
    given = ["abc 1", "muñoz nº", "muñoz", "fundación", "́", "ÀÖØỹɍ", ""]
    plain = lambda t: re.sub("[̀-ͯ]", "", t.upper().replace("Ñ", "Ñ").translate(str.maketrans(text.ACCENTED, text.PLAIN)))
    d = spark.createDataFrame([(t,) for t in [*given, None]], "t string").select(text.fold(F.col("t")).alias("f"), text.report_form(F.col("t")).alias("r"))
    assert [r["f"] for r in d.collect()] == [*map(plain, given), None]
    assert unicodedata.normalize("NFC", "ñ") == "ñ" and d._jdf.queryExecution().analyzed().toString().split("LogicalRDD")[0].count("translate(") <= 2
