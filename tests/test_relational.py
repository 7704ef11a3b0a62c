"""Every query against its oracle on the smallest tables, and cases that queries do not reach."""

from __future__ import annotations

import os
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docsieve.operators import authenticity, match, quality, readings, reports, template
from docsieve.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(names, table):
    order = sorted(range(len(names)), key=lambda i: names[i])
    tidy = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((repr([tidy(r[i]) for i in order]) for r in table))


#: Each document type takes seconds to plan: these cover all kinds of rules, ALL_TYPES in the environment adds the others.
KINDS = {f"extract_{k}" for k in ("flc_60h", "titulo_tecnico", "certificado_tgss", "seguro_rc", "registro_empresa", "contrato_laboral", "formacion_art19")}
NAMES = [n for n in sorted(registry.oracle_sql()) if not n.startswith("extract_") or n in KINDS or "ALL_TYPES" in os.environ]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, sf, duck, name):
    got = registry.queries()[name](spark, sf)
    want = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_no_accepted_wrong_zone(spark, sf):
    report = registry.queries()["mrz_corruption_report"](spark, sf).collect()
    assert len(report) == 8 and all(r["accepted_wrong"] == 0 for r in report)
    assert all(r["valid"] == r["zones"] for r in report if r["kind"] in (0, 1, 3))
    assert all(r["valid"] == 0 for r in report if r["kind"] == 4)


def test_match_states(spark):
    s = lambda a, b, f="nombre": spark.range(1).select(match.compare(F.lit(f), F.lit(a), F.lit(b), F.lit(False))).first()[0]
    assert [s("CARMEN", "CARNEN"), s("CARMEN", "CARLOS"), s("Peña", "PENA"), s(None, "X"), s("1 2", "12", "dni")] == ["parecido", "distinto", "coincide", "falta", "coincide"]


def test_retries(spark):
    b = [("x", "1", "a", "apta", True), ("x", "2", "a", "apta", True), ("y", "1", "a", "apta", False), ("y", "2", "a", "apta", True), ("z", "1", "a", "rechazar", True), ("z", "2", "a", "rechazar", False)]
    df = spark.createDataFrame(b, "group_id string, file string, engine string, verdict string, valid boolean")
    got = {(r["policy"], r["k"]): round(r["pct"], 1) for r in reports.retry_curve(df, 2).collect()}
    assert got == {("A", 1): 33.3, ("A", 2): 66.7, ("B", 1): 66.7, ("B", 2): 100.0}


def test_field_comparison(spark):
    df = spark.createDataFrame([("num_soporte", "BAA000580", "BAA000589", False), ("apellidos", "GARCIA LO", "García López", True), ("sexo", "F", "", False)], "field string, read string, truth string, cut boolean")
    assert {r["field"]: r["ok"] for r in reports.compare_fields(df).collect()} == {"num_soporte": False, "soporte_digitos": False, "soporte_letras": True, "apellidos": True}


def test_quality_caps_warnings(spark):
    m = spark.createDataFrame([("p", "global", "reflejo", 0.5), ("p", "global", "nitidez", 60.0), ("q", "mrz", "nitidez", 100.0), ("q", "mrz", "otro", 1.0), ("q", "mrz", "reflejo", None)], "photo_id string, zone string, metric string, value double")
    v = {r["photo_id"]: (r["verdict"], r["warnings"]) for r in quality.verdicts(quality.levels(m, quality.rules(spark))).collect()}
    assert v == {"p": ("riesgo", ["global.reflejo:dudoso"]), "q": ("rechazar", ["mrz.nitidez:mal"])}


def test_best_attempt_keeps_the_first(spark):
    a = spark.createDataFrame([("p", "a", 1, False, 3), ("p", "a", 2, False, 3), ("p", "b", 1, False, 9), ("p", "b", 2, True, 1)], "photo_id string, engine string, attempt int, valid boolean, checks int")
    assert {(r["engine"], r["attempt"]) for r in readings.best_attempt(a).collect()} == {("a", 1), ("b", 2)}


def test_codes_and_saves(spark):
    got = spark.createDataFrame([("Código seguro de verificación: ABCD-1234-EFGH; CSV: VERIFICAR EN LA SEDE",)], "t string").select(authenticity.codes(F.col("t")).alias("c")).first()["c"]
    assert [(c["kind"], c["code"]) for c in got] == [("CSV", "ABCD1234EFGH")]
    b = spark.createDataFrame([(b"%PDF-1 Linearized %%EOF %%EOF",), (b"%PDF",)], "c binary").select(authenticity.revisions(F.col("c")).alias("n")).collect()
    assert [r["n"] for r in b] == [1, 1]


def test_turned_card(spark):
    t = spark.createDataFrame([("dni", 0.1, 0.1, 0.2, 0.1), ("nombre", 0.5, 0.2, 0.2, 0.1)], "key string, x double, y double, w double, h double")
    m = t.select(F.lit("p").alias("photo_id"), "key", (1 - F.col("x") - F.col("w")).alias("x"), (1 - F.col("y") - F.col("h")).alias("y"), "w", "h")
    r = template.fit_error(m, t).first()
    assert r["turned"] and r["error_turned"] < 1e-9


def test_batch_report_is_one_scan(spark, sf):
    from docsieve.plans import relational_queries as Q

    plan = Q.batch_report(spark, sf)._jdf.queryExecution().executedPlan().toString()
    # rows are read once, exchanged once as sums of each task and once more as sums of the reports
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2
    rows = spark.createDataFrame([("f1", None, "a", "apta", True, 5, False, [])], "file string, group_id string, engine string, verdict string, valid boolean, ms long, has_truth boolean, failed array<string>")
    from docsieve.operators import reports

    got = {(r["report"], r["name"]): r["value"] for r in reports.batch_report(rows).collect()}
    assert got[("engine_summary", "photos")] == 1 and ("engine_summary", "pct_all_right") not in got and not any(r == "retry_curve" for r, _ in got)
    assert reports.batch_report(rows.limit(0)).count() == 0


def test_globs_meet_files_by_their_literal_parts(spark):
    import fnmatch

    from docsieve.operators import reports

    globs = [(i, f"*_{i:06d}.jpg" if i % 2 else f"batch{i:06d}*") for i in range(100_000)]
    globs += [(200_000, "*[0-4]x.png"), (200_001, "?"), (200_002, "*"), (150_000, "[!a]*zz"), (150_001, "un[closed*"), (5, "dir/exact.jpg"), (100_500, "*.tif"), (100_400, "[]]odd?")]
    paths = [f"dir/a_{i:06d}.jpg" for i in (1, 77_777, 99_999)] + ["batch000004/x.png", "dir/batch099998.png", "dir/exact.jpg", "q/3x.png", "bzz", "azz", "un[closed1", "a/b/c.tif", "]oddy", "none"]
    truth, files = spark.createDataFrame(globs, "ord long, key string"), spark.createDataFrame([(p,) for p in paths], "path string")
    found = reports.truth_lookup(files, truth)
    got = {r["path"]: r["ord"] for r in found.collect()}
    for p in paths:
        name = p.rsplit("/", 1)[-1]
        exact = [o for o, k in globs if k in (p, name)]
        odd = [o for o, k in globs[100_000:] if set(k) & set("*?[") and (fnmatch.fnmatchcase(p, k) or fnmatch.fnmatchcase(name, k))]
        # the others have one star, at one end
        fits = odd + [o for o, k in globs[:100_000] if (p.endswith(k[1:]) if o % 2 else p.startswith(k[:-1]) or name.startswith(k[:-1]))]
        assert got[p] == min(exact or fits), p
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["ord"] for r in reports.truth_lookup(files, truth.limit(0)).collect()} == {None}


def test_files_with_numbers_of_seven_digits_are_looked_up_whole(spark, tmp_path):
    from docsieve.plans import relational_queries

    spark.createDataFrame([(i,) for i in (10, 1000000, 1000001, 1000002, 1000007)], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in relational_queries.truth_lookup_glob(spark, str(tmp_path)).collect())
    cut = "lote/100000.jpg"
    assert got == [("lote/000010.jpg", "10", "000010.jpg"), (cut, "", ""), (cut, "-2", "lote/*[13].jpg"), (cut, "-3", "*7.jpg"), (cut, "1000000", "100000.jpg")]


def test_outcomes_join_fields_and_status_only(spark, sf):
    plan = registry.queries()["field_outcome"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2


def test_page_enough_adds_in_the_order_of_lines_however_they_are_split(spark, tmp_path):
    from docsieve.plans import card_queries

    # pages of five to seven lines whose mean is 0.6 but for the order of addition; a page without part or supplier here and there
    rnd, made = random.Random(3), []
    for k in range(3000):
        tenths = [rnd.randint(0, 10) for _ in range(rnd.randint(5, 7))]
        while sum(tenths) != 6 * len(tenths):
            tenths = [rnd.randint(0, 10) for _ in tenths]
        made += [(k, None if k % 50 == 0 and not i else 1, None if k % 70 == 0 and not i else t) for i, t in enumerate(tenths)]
    rnd.shuffle(made)
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    for i in range(7):
        part = pa.table(dict(zip(("l_orderkey", "l_partkey", "l_suppkey"), (pa.array(c, pa.int64()) for c in zip(*made[i * len(made) // 7 : (i + 1) * len(made) // 7])))))
        pq.write_table(part, folder / f"part-{i}.parquet", row_group_size=500)
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{folder}/*.parquet')")
    want = sorted(con.execute(card_queries.PAGE_ENOUGH).fetchall())
    got = sorted(tuple(r) for r in card_queries.page_enough(spark, str(tmp_path)).collect())
    assert got == want
    assert 100 < sum(e for _, e in want) < 2900
