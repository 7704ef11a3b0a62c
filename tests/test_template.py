"""Cards in perspective and zones between labels."""

from __future__ import annotations

from docsieve.operators import template


def test_perspective(spark):
    square = [100.0, 50.0, 300.0, 50.0, 300.0, 150.0, 100.0, 150.0]
    rows = [("p", "dni", 100.0, 50.0, 100.0, 50.0, square), ("q", "dni", 0.0, 0.0, 1.0, 1.0, [0.0] * 8)]
    got = {r["photo_id"]: r for r in template.straightened(spark.createDataFrame(rows, "photo_id string, key string, x double, y double, w double, h double, corners array<double>")).collect()}
    assert [round(got["p"][c], 9) for c in "xywh"] == [0, 0, 0.5, 0.5] and got["q"]["x"] is None


def test_name_zone_ends_above_the_next_label(spark):
    rows = [("apellidos", 0.3, 0.22, 0.2, 0.05), ("etiqueta.apellidos", 0.3, 0.2, 0.1, 0.02), ("etiqueta.nombre", 0.3, 0.35, 0.1, 0.02), ("nombre", 0.3, 0.37, 0.2, 0.05), ("etiqueta.sexo", 0.8, 0.25, 0.1, 0.02)]
    got = {r["key"]: r for r in template.name_zones(spark.createDataFrame(rows, "key string, x double, y double, w double, h double")).collect()}
    assert round(got["apellidos"]["y"] + got["apellidos"]["h"], 6) == 0.346 and round(got["nombre"]["y"] + got["nombre"]["h"], 6) == 0.432


def test_learned_boxes_reject_what_is_outside(spark):
    rows = [("a", 1, 0.1, 0.1, 0.2, 0.1), ("a", 2, 0.2, 0.1, 0.2, 0.1), ("a", 3, 1.2, 0.1, 0.2, 0.1), ("a", 4, 0.1, 0.1, 0.0, 0.1)]
    r = template.learn(spark.createDataFrame(rows, "key string, seq int, x double, y double, w double, h double")).first()
    assert (r["x"], r["n"]) == (0.15, 2)


def test_a_log_is_read_as_of_a_version(spark, tmp_path):
    box = lambda k, s, x: (k, s, False, x, 0.1, 0.2, 0.1)
    gone = lambda k, s: (k, s, True, None, None, None, None)
    schema = "key string, seq long, deleted boolean, x double, y double, w double, h double"
    for rows in ([box("a", 1, 0.1), box("b", 1, 0.5)], [gone("a", 2), box("a", 3, 0.3)], [box("a", 4, 0.5), gone(None, 5)], [box("b", 6, 0.7)]):
        template.append_log(f"{tmp_path}/log", spark.createDataFrame(rows, schema))
    log = spark.read.schema(schema).parquet(f"{tmp_path}/log")
    at = lambda v: {r["key"]: (r["x"], r["n"]) for r in template.as_stored(log, v).collect()}
    assert at(1) == {"a": (0.1, 1), "b": (0.5, 1)} and at(2) == {"b": (0.5, 1)} and at(4) == {"a": (0.4, 2), "b": (0.5, 1)} and at(5) == {} and at(None) == {"b": (0.7, 1)}
