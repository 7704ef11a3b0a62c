"""Extractors and lookups over hand-written lines."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docsieve.operators import classify, extract, layout
from docsieve.functions.text import row_form

AS_OF = "2026-06-30"
SCHEMA = "doc_id string, line_no int, page int, text string, x double, y double, w double, h double, origin string, conf double, alt string"


def document(spark, *lines):
    rows = [("d", i, 1, t, float(x), float(y), float(more[0]) if more else 0.4, 0.012, "capa_texto", 1.0, more[1] if len(more) > 1 else None) for i, (t, x, y, *more) in enumerate(lines)]
    return layout.documents(spark.createDataFrame(rows, SCHEMA))


def fields(spark, kind, *lines):
    return extract.extract(document(spark, *lines), kind, F.lit(AS_OF).cast("date")).first()


def test_diploma(spark):
    r = fields(spark, "flc_60h", ("FUNDACIÓN LABORAL DE LA CONSTRUCCIÓN", 0.1, 0.1), ("D. LUIS GÓMEZ RUIZ, con NIF 12345678Z, ha superado", 0.1, 0.2, 0.8), ("una duración de 60 horas", 0.1, 0.25), ("Madrid, a 14 de marzo de 2025", 0.1, 0.4))
    assert r["fields"] == {"titular": "LUIS GOMEZ RUIZ", "tratamiento": "DON", "nif": "12345678Z", "horas": "60", "fecha": "2025-03-14"} and r["missing"] == []


def test_wrong_letter_is_no_value(spark):
    r = fields(spark, "flc_60h", ("D. LUIS GÓMEZ RUIZ, con NIF 12345678A", 0.1, 0.2, 0.8))
    assert "nif" not in r["fields"] and "nif" in r["missing"]


def test_two_ids_without_label_are_none(spark):
    assert "nif" not in fields(spark, "reconocimiento_medico", ("12345678Z", 0.1, 0.1), ("00000000T", 0.1, 0.2))["fields"]


def test_certificate_in_boxes(spark):
    r = fields(spark, "certificado_tgss", ("CIF", 0.1, 0.1, 0.1), ("RAZÓN SOCIAL", 0.5, 0.1, 0.1), ("B12345674", 0.1, 0.12, 0.1), ("CONSTRUCCIONES PRUEBA SL", 0.5, 0.12, 0.3), ("Fecha de emisión: 10/01/2025", 0.1, 0.3), ("se encuentra AL CORRIENTE", 0.1, 0.35))
    assert r["fields"]["caduca"] == "2025-07-10" and r["fields"]["validez_meses"] == "6" and r["fields"]["identificador"] == "B12345674"
    v = extract.validations(extract.extract(document(spark, ("Fecha de emisión: 10/01/2025", 0.1, 0.3)), "certificado_tgss", F.lit(AS_OF).cast("date")), "certificado_tgss", F.lit(AS_OF).cast("date")).first()["validations"]
    assert v == {"identificador_valido": None, "vigente": False, "al_corriente": None}


def test_unreadable_issue_date_is_no_other_date(spark):
    assert "fecha" not in fields(spark, "plan_seguridad_salud", ("revisado 01/01/2020", 0.1, 0.05), ("Fecha de expedición: 45/99/2024", 0.1, 0.1))["fields"]


def test_medical_options_unmarked(spark):
    assert "apto" not in fields(spark, "reconocimiento_medico", ("APTO", 0.1, 0.1), ("NO APTO", 0.1, 0.2))["fields"]


def test_other_reading(spark):
    assert fields(spark, "reconocimiento_medico", ("NIF:", 0.1, 0.1, 0.1), ("1234S678Q", 0.25, 0.1, 0.2, "12345678Z"))["fields"]["nif"] == "12345678Z"


@pytest.mark.parametrize("kind", ["seguro_rc", "registro_empresa", "contrato_laboral", "entrega_epis", "titulo_tecnico"])
def test_every_type_runs_on_an_empty_looking_page(spark, kind):
    r = fields(spark, kind, ("x", 0.1, 0.1))
    assert set(r["missing"]) >= set(extract.TYPES[kind][1]) and not r["fields"]


def test_classifier(spark):
    t = "PLAN DE SEGURIDAD Y SALUD DE LA OBRA"
    df = spark.createDataFrame([(t,), ("HOLA",)], "t string").select(classify.classify(classify.ranked(classify.scores(row_form(F.col("t")))), F.lit("plan_seguridad_salud")).alias("c"))
    a, b = [r["c"] for r in df.collect()]
    assert a["kind"] == "plan_seguridad_salud" and a["agrees"] and b["kind"] is None and b["confidence"] == 0 and b["candidates"] == []


def test_rows_and_empty_table(spark):
    d = document(spark, ("b", 0.5, 0.1, 0.1), ("a", 0.1, 0.102, 0.1), ("c", 0.1, 0.2, 0.1)).first()
    assert d["rows"] == ["A B", "C"] and d["text"] == "A B\nC"
    assert layout.documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_text_meets_a_thousand_types_by_its_words(spark):
    import random
    import re

    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("ABCDEFGHIJKLMNOPRSTU") for _ in range(rnd.randint(3, 9)))
    words = [word() for _ in range(900)]
    make = lambda: rnd.choice([lambda a, b: a, lambda a, b: rf"\\b{a}\\b", lambda a, b: f"{a} {b}", lambda a, b: rf"{a}(?:\\s+{b})?", lambda a, b: f"{a}|{b}", lambda a, b: rf"\\d{{2}}[AB]?", lambda a, b: f"(?:{a}|{b})X?Y"])(rnd.choice(words), rnd.choice(words)).replace("\\\\", "\\")
    keys = {f"type{i}": {make(): rnd.choice([0.5, 1, 3]) for _ in range(4)} for i in range(1000)}
    texts = [" ".join(rnd.choice(words) + rnd.choice(["", "", "X", " 12"]) for _ in range(30)) for _ in range(40)] + ["", "X", "12\nAB"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    d = df.select("t", classify.scores(F.col("t"), keys).alias("s"), F.size(classify.Index.of(keys).hits(F.col("t"))).alias("n"))
    assert "from_json" not in df.select(classify.scores(F.col("t"), {"a": {"XYZW": 1}}).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    for r in d.collect():
        want = {k: round(sum(w for p, w in table.items() if re.search(p, r["t"])), 2) for k, table in keys.items()}
        assert [(x["kind"], x["points"]) for x in r["s"]] == [(k, p) for k, p in want.items() if p > 0]


def test_grams_of_a_text_are_found_in_one_pass(spark):
    """No text is cut into all its grams, and grams that begin or overlap others are found."""
    keys = {"a": {"PREV": 1}, "b": {"PRE": 2}, "c": {"REVI": 4}, "d": {r"ART\. 1": 8}, "e": {"SPAÑ": 16}}
    texts = ["PREVIO", "PRENDA", "EXPRES", "ART. 1", "ARTX 1", "ESPAÑA PREVISTA", "PR EV", ""]
    index = classify.Index.of(keys)
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", classify.scores(F.col("t"), keys).alias("s"))
    assert "substring" not in df._jdf.queryExecution().optimizedPlan().toString() and index.tree
    assert [sum(x["points"] for x in r["s"]) for r in df.collect()] == [7, 2, 2, 8, 0, 23, 0, 0]
    assert [r[0] for r in spark.createDataFrame([("AB",), ("B",)], "t string").select(F.size(classify.Index.of({"a": {"A": 1}}).hits(F.col("t")))).collect()] == [1, 0]


def test_lines_of_a_field_are_computed_once(spark):
    from docsieve.operators import provenance

    d = document(spark, ("COMUNICACIÓN DE APERTURA DEL CENTRO", 0.1, 0.05), ("Razón social: OBRAS PRUEBA SL", 0.1, 0.1, 0.6), ("CIF: B12345674", 0.1, 0.15, 0.3), ("Fecha de inicio: 01/02/2026", 0.1, 0.25, 0.6))
    as_of = F.lit(AS_OF).cast("date")
    e = extract.extract(d, "apertura_centro_trabajo", as_of, keep=("lines", "rows"))
    kept, joined = provenance.placed_fields(d, e, as_of), provenance.placed_fields(d, e.drop("lines", "rows"), as_of)
    assert {(r["field"], r["y"]) for r in kept.collect()} == {("razon_social", 0.1), ("identificador", 0.15), ("fecha", 0.25)}
    assert sorted(kept.collect()) == sorted(joined.collect())
    f = e.select(provenance.field_of(F.col("text"), provenance.holding_lines(F.col("lines"), F.col("rows"), F.col("text"), as_of)).alias("f"))
    assert str(f._jdf.queryExecution().analyzed()).split("Project")[1].count(r"[\s.\-]") == 2 and "Join" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_reading_order_needs_places_only(spark):
    lines = [("b", 0, 1, "Ñandú", 0.5, 0.1, 0.1, 0.012, "capa_texto", 1.0, None), ("b", 1, 1, "x", 0.1, 0.102, 0.1, 0.012, "capa_texto", 1.0, None), ("b", 2, 1, "y", 0.1, 0.05, 0.1, 0.012, "capa_texto", 1.0, None)]
    d = layout.reading_order(spark.createDataFrame(lines, SCHEMA))
    assert {r["line_no"]: r["place"] for r in d.collect()} == {2: 1, 1: 2, 0: 3}
    assert "upper(" not in d._jdf.queryExecution().optimizedPlan().toString()


def places(spark, kind, *lines):
    from docsieve.operators import traced

    return {r["field"]: r["y"] for r in traced.traced_fields(document(spark, *lines), kind, F.lit(AS_OF).cast("date")).collect()}


def test_places_come_from_the_rule(spark):
    got = places(
        spark, "flc_60h", ("LUIS GÓMEZ RUIZ 12345678Z 60 horas 14/03/2025", 0.1, 0.05), ("FUNDACIÓN LABORAL DE LA CONSTRUCCIÓN", 0.1, 0.1), ("D. LUIS GÓMEZ RUIZ, con NIF 12345678Z, ha superado", 0.1, 0.2, 0.8),
        ("el curso con una duración", 0.1, 0.25), ("de 60 horas", 0.1, 0.3), ("Entidad formadora:", 0.1, 0.35, 0.2), ("ESCUELA DE OBRAS", 0.4, 0.35), ("Fecha de expedición: 14/03/2025", 0.1, 0.4),
    )
    # a duration that is broken over two rows begins in the first of them
    assert got == {"titular": 0.2, "tratamiento": 0.2, "nif": 0.2, "horas": 0.25, "entidad": 0.35, "fecha": 0.4}


def test_places_of_rules_with_conditions(spark):
    got = places(
        spark, "seguro_rc", ("RC-2024-77 600.000 € 01/02/2025 01/02/2027 B12345674", 0.1, 0.05), ("Tomador del seguro: OBRAS PRUEBA SL", 0.1, 0.1), ("CIF: B12345674", 0.1, 0.15), ("Nº de póliza: RC-2024-77", 0.1, 0.2),
        ("desde el 01/02/2025 hasta el 01/02/2027", 0.1, 0.3), ("Límite por siniestro: 600.000 €", 0.1, 0.4),
    )
    assert {k: got[k] for k in ("tomador", "identificador", "poliza", "vigencia_desde", "vigencia_hasta", "limite_siniestro")} == {"tomador": 0.1, "identificador": 0.15, "poliza": 0.2, "vigencia_desde": 0.3, "vigencia_hasta": 0.3, "limite_siniestro": 0.4}
