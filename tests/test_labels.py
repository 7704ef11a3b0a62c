"""Likeness by matching blocks, and the index of pieces, against the standard library and brute force."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from docsieve.operators import front, labels, readings


def damaged(rnd: random.Random, t: str) -> str:
    for _ in range(rnd.randint(0, 3)):
        i = rnd.randrange(len(t) + 1)
        t = rnd.choice([t[:i] + rnd.choice("AEX0 ") + t[i:], t[:i] + t[i + 1 :], t[:i] + rnd.choice("OIX") + t[i + 1 :]]) or "A"
    return t


def test_ratio_is_that_of_matching_blocks(spark):
    rnd = random.Random(7)
    texts = ["NACIMIENTO", "ABABABAB", "FECHA DE NACIMIENTO", "AA", "BALIOZTASUNA", "AÑO 2020", "X"]
    pairs = [(a, damaged(rnd, a)) for a in texts for _ in range(40)] + [(rnd.choice(texts), rnd.choice(texts)) for _ in range(60)]
    pairs += [("".join(rnd.choice("AB") for _ in range(rnd.randint(1, 14))), "".join(rnd.choice("AB") for _ in range(rnd.randint(1, 14)))) for _ in range(150)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", labels.blocks_ratio(F.col("a"), F.col("b")).alias("r"), labels.alike(F.col("a"), F.col("b"), 0.8).alias("alike")).collect():
        want = SequenceMatcher(None, r["a"], r["b"], autojunk=False).ratio()
        assert abs(r["r"] - want) < 1e-12 and r["alike"] == (want >= 0.8), r


@pytest.mark.parametrize("least", [0.84, 0.7])
def test_the_index_loses_no_pair(spark, least):
    rnd = random.Random(3)
    names = [n for v in front.LABELS.values() for n in v if len(n) > 4]
    texts = sorted({" ".join(damaged(rnd, n).split()) for n in names for _ in range(25)} - {""})
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {tuple(r) for r in labels.alike_names(df, names, least).collect()}
    want = {(t, n) for t in texts for n in names if t.count(" ") == n.count(" ") and SequenceMatcher(None, t, n, autojunk=False).ratio() >= least}
    assert got == want and len(want) > 300


def test_no_python_runs(spark):
    lines = spark.createDataFrame([(1, 0, "APELLID0S Y NOMBRE"), (2, 0, ""), (3, 0, None), (4, 0, "C/ MAYOR 1")], "doc_id long, line_no int, text string")
    d = front.labelled_lines(lines)
    got = {r["doc_id"]: r["labels"] for r in d.collect()}
    assert got[1] == ["apellidos", "nombre"] and got[4] == [] and got[2] == []
    assert "Python" not in d._jdf.queryExecution().executedPlan().toString()
    v = front.without_labels(spark.createDataFrame([("NACIMIENT0 GARCIA DE LA TORRE",), ("SEXO",)], "norm string"))
    assert {r["norm"]: r["plain"] for r in v.collect()} == {"NACIMIENT0 GARCIA DE LA TORRE": "GARCIA DE LA TORRE", "SEXO": ""}
    r = spark.createDataFrame([("Uno, dos.", "UNO DOS"), ("", ""), (None, "a"), ("casa", "perro")], "a string, b string")
    assert [x[0] for x in r.select(readings.same_reading(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]


def test_words_are_cut_once_for_distinct_texts(spark):
    """The array of rows is not tested again below the distinct texts, for every line and each of its words."""
    lines = spark.createDataFrame([(1, 0, "NOMBRE")], "doc_id long, line_no int, text string")
    plan = front.labelled_lines(lines)._jdf.queryExecution().optimizedPlan().toString()
    tested = [ln for ln in plan.splitlines() if "Filter" in ln and "size(" in ln]
    assert "Generate" in plan and not tested, tested


def test_the_digits_of_a_number_are_no_date(spark):
    """30052605T is a number with its right letter, and not the 30th of May 2605; over two lines neither."""
    shape = "doc_id long, line_no int, text string, x double, y double, w double, h double"
    row = lambda doc, n, t: (doc, n, t, 10.0, 40.0 * n, 200.0, 20.0)
    lines = [row(1, 0, "DNI 30052605T"), row(1, 1, "03 04 2022"), row(2, 0, "30052605"), row(2, 1, "T"), row(3, 0, "30052605A"), row(3, 1, "03042032")]
    got = {r["doc_id"]: r for r in front.read_fronts(spark.createDataFrame(lines, shape), F.to_date(F.lit("2026-06-30"))).collect()}
    assert got[1]["dni"] == "30052605T" and got[1]["fecha_caducidad"] is None and got[1]["fecha_expedicion"] == "03/04/2022"
    assert got[2]["dni"] == "30052605T" and got[2]["fecha_caducidad"] is None
    # a number with a wrong letter may as well be a date
    assert not got[3]["dni_ok"] and got[3]["fecha_caducidad"] == "30/05/2605"


def test_rows_of_cards_are_dealt_over_the_cores(spark, sf):
    from docsieve.plans import fixtures

    cores = spark.sparkContext.defaultParallelism
    assert all(fixtures.view(spark, sf, f"SELECT * FROM {t}", t).rdd.getNumPartitions() == cores for t in ("customer", "supplier", "orders"))
