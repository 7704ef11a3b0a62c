"""Snapshots of schemas, and each kind of change between two."""

from __future__ import annotations

import json

from docsieve.plans import registry
from docsieve.sources.contract import breaking, changes, snapshot


def test_each_kind_of_change_is_named(spark):
    def of(ddl):
        return spark.createDataFrame([], ddl)

    old = {"a": of("x int, y bigint, z string, d decimal(10,2), gone string, s struct<p:int,q:array<float>>, m map<string,int>, n string not null"), "left": of("x int")}
    new = {"a": of("z bigint, x bigint, y int, d decimal(12,2), s struct<p:int,q:array<double>,r:date>, m map<string,smallint>, n string, more int"), "come": of("x int")}
    before, after = json.loads(json.dumps(snapshot(old))), snapshot(new)
    found = changes(before, after)
    assert set(found) == {
        ("a", "x", "widened"), ("a", "y", "narrowed"), ("a", "z", "retyped"), ("a", "d", "widened"), ("a", "gone", "removed"), ("a", "s.q[]", "widened"),
        ("a", "s.r", "added"), ("a", "m{}", "narrowed"), ("a", "n", "nullable"), ("a", "more", "added"), ("left", "", "removed"), ("come", "", "added"),
    }
    assert {x[1:] for x in breaking(found)} == {("y", "narrowed"), ("z", "retyped"), ("gone", "removed"), ("m{}", "narrowed"), ("n", "nullable"), ("", "removed")}
    assert changes(before, before) == [] and changes({}, {}) == []
    assert changes(snapshot({"a": of("x int not null")}), snapshot({"a": of("x int")})) == [("a", "x", "nullable")]


def test_a_snapshot_of_registered_queries(spark, sf):
    known = registry.queries()
    some = {n: known[n] for n in ("engine_merge", "nif_validate", "worst_pages")}
    taken = snapshot({n: q(spark, sf) for n, q in some.items()})
    assert list(taken) == sorted(some) and changes(taken, taken) == []
    without = {n: {**s, "fields": s["fields"][1:]} for n, s in taken.items()}
    assert changes(taken, without) == [(n, s["fields"][0]["name"], "removed") for n, s in taken.items()]
