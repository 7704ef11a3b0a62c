"""Files, recognisers, card fronts and the stream."""

from __future__ import annotations

import csv

from pyspark.sql import functions as F

from docsieve.operators import front
from docsieve.sources import files, recognise
from docsieve.streaming.verification import verified_stream

CASE = "case_id int, zone_valid boolean, zone_dni string, zone_support string, expiry date, dnis array<string>, supports array<string>, front_text string, front_bad boolean, back_bad boolean, front_warnings array<string>, back_warnings array<string>, declared string, attempt int, as_of date"


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.JPG").write_bytes(b"1")
    (tmp_path / "y.txt").write_bytes(b"2")
    assert [r["length"] for r in files.list_files(spark, str(tmp_path)).collect()] == [1]
    b = spark.createDataFrame([(0, b"  \n%PDF-1.7 %%EOF"), (1, b""), (2, b"GIF"), (3, b"%PDF /Encrypt %%EOF"), (4, b"%PDF")], "i int, c binary")
    assert [r["r"] for r in b.select("i", files.unreadable(F.col("c")).alias("r")).orderBy("i").collect()] == [None, "vacio", "formato", "cifrado", "corrupto"]


def test_truth_dialect(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("﻿archivo;dni\na.jpg;1\n;2\n", encoding="utf-8")
    t = files.read_truth(spark, str(p))
    assert t.columns == ["archivo", "dni"] and t.count() == 1


def test_page_turns(spark):
    box = lambda turn: tuple(round(v, 6) for v in spark.range(1).select(files.to_page(*map(F.lit, (10.0, 20.0, 30.0, 40.0, 100.0, 200.0, turn))).alias("b")).first()["b"])
    assert box(0) == (0.1, 0.8, 0.2, 0.1) and box(180) == (0.7, 0.1, 0.2, 0.1) and box(90) == (0.1, 0.1, 0.1, 0.2)


def test_recogniser_gives_error_rows(spark):
    pages = spark.createDataFrame([("d", 1, b"uno\ndos"), ("e", 1, b"\xff\xfe")], "doc_id string, page int, content binary")
    got = sorted((r["doc_id"], r["text"], r["error"]) for r in recognise.recognise(pages, "plain").collect())
    assert [(d, t) for d, t, e in got if e is None] == [("d", "dos"), ("d", "uno")] and [e for d, _, e in got if d == "e"] == ["UnicodeDecodeError"]


def test_front(spark):
    rows = [("c", 0, "APELLID0S", 10, 10, 80, 10), ("c", 1, "GARCÍA LÓPEZ", 10, 24, 120, 10), ("c", 2, "SEXO", 200, 10, 30, 10), ("c", 3, "F", 240, 10, 8, 10), ("c", 4, "DOCUMENTO", 10, 100, 80, 10)]
    lines = spark.createDataFrame(rows, "doc_id string, line_no int, text string, x int, y int, w int, h int")
    got = front.read_fronts(lines, F.lit("2026-06-30").cast("date")).first()
    assert got["apellidos"] == "GARCIA LOPEZ" and got["sexo"] == "F" and got["found"] == 2
    short = front.labelled_lines(spark.createDataFrame([("NOM",), ("NOMS",)], "text string"))
    assert {r["text"]: r["labels"] for r in short.collect()} == {"NOM": ["nombre"], "NOMS": []}


def test_stream_equals_batch(spark, tmp_path):
    import datetime as dt

    day = dt.date(2030, 1, 1)
    rows = [(1, True, "12345678Z", "BAA000589", day, ["12345678Z"], ["BAA000589"], "", False, False, [], [], "12345678-Z", 1, day), (2, False, None, None, None, [], [], "", False, True, [], [], "12345678Z", 1, day), (3, False, None, None, None, [], [], "", True, True, ["reflejo"], [], "12345678Z", 2, day), (4, True, "12345678Z", "BAA000589", day, ["00000000T"], ["BAA000589"], "", False, False, [], [], "12345678Z", 1, day), (5, True, "12345678Z", "BAA000589", day, ["12345678Z"], ["BAA000589"], "", False, False, [], [], "", 1, day), (6, True, "12345678Z", "BAA000589", day, [], [], "X12345678ZBAA000589", False, False, [], [], "12345678Z", 1, day)]
    df = spark.createDataFrame(rows, CASE)
    df.write.parquet(f"{tmp_path}/in")
    q = verified_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).select("case_id", "status", "reason").writeStream.format("memory").queryName("verified").start()
    q.processAllAvailable()
    q.stop()
    got = {r["case_id"]: (r["status"], r["reason"]) for r in spark.table("verified").collect()}
    assert got == {1: ("VERIFICADO", "OK"), 2: ("REPETIR", "MALA_CALIDAD"), 3: ("REVISION_ADMIN", "INTENTOS_AGOTADOS"), 4: ("REVISION_ADMIN", "DATOS_NO_COINCIDEN"), 5: ("REVISION_ADMIN", "DATOS_NO_COINCIDEN"), 6: ("VERIFICADO", "OK")}


def test_rules_of_a_file(tmp_path):
    p = tmp_path / "rules.yaml"
    p.write_text("# limits\nglobal:\n  nitidez:   {sentido: min, dudoso: 60, mal: 25}  # sharp\n  reflejo: {sentido: max, dudoso: 0.004, mal: 0.015, solo_aviso: true}\nmrz:\n  quemados:\n    sentido: max\n    dudoso: 0.1\n    mal: 0.25\n", encoding="utf-8")
    assert files.read_rules(str(p)) == (("global", "nitidez", "min", 60.0, 25.0, False), ("global", "reflejo", "max", 0.004, 0.015, True), ("mrz", "quemados", "max", 0.1, 0.25, False))


def test_reports_and_long_truth(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "ñ")], "k int, x string"), spark.createDataFrame([(2, 3)], "k int, y int")
    files.export_report([a, b], f"{tmp_path}/r.csv")
    raw = (tmp_path / "r.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and sorted(raw.decode("utf-8-sig").splitlines()) == ["1;ñ;", "2;;3", "k;x;y"]
    odd = spark.createDataFrame([(i, f'a "b"; c\n{i}' if i % 2 else " x ") for i in range(40)], "k int, `x;y` string").repartition(5)
    files.export_report([odd], f"{tmp_path}/r.csv")
    with open(f"{tmp_path}/r.csv", encoding="utf-8-sig", newline="") as f:
        read = list(csv.reader(f, delimiter=";"))
    assert read[0] == ["k", "x;y"] and sorted((int(k), x) for k, x in read[1:]) == [(i, f'a "b"; c\n{i}' if i % 2 else " x ") for i in range(40)]
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("r.csv")] == ["r.csv"]
    (tmp_path / "t.csv").write_text("archivo;tipo;campo;valor\nf1;seguro_rc;poliza;RC1\nf1;otro;tomador;X\nf2;otro;fecha;2024-01-01\n", encoding="utf-8")
    got = {(r["file"], r["kind"], r["field"], r["truth"]) for r in files.read_truth_long(spark, f"{tmp_path}/t.csv").collect()}
    assert got == {("f1", "seguro_rc", "poliza", "RC1"), ("f1", "seguro_rc", "tomador", "X"), ("f2", "otro", "fecha", "2024-01-01")}


def test_words_of_small_and_large_pages_find_the_same_line():
    import random

    import numpy as np

    from docsieve.operators import words

    rnd = random.Random(3)
    for _ in range(300):
        boxes = [tuple(float(rnd.randint(1, 60)) for _ in range(4)) for _ in range(rnd.randint(1, 20))]
        x, y, h = float(rnd.randint(1, 90)), float(rnd.randint(1, 60)), float(rnd.randint(1, 60))
        assert words._first_fit(boxes, x, y, h) == words._first_fit_of_many(np.array(boxes), x, y, h)
        a = np.array(boxes)
        assert words._from_the_top(boxes) == np.lexsort((a[:, 0], np.rint((a[:, 1] + a[:, 3] / 2) / words.LEVEL))).tolist()
        confs = [rnd.random() for _ in range(rnd.randint(1, 12))]
        assert words._mean(confs) == float(np.mean(confs))
