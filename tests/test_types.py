"""Types as rows: what is wrong is named row by row, and the built-in types can be written as rows, too."""

from __future__ import annotations

import dataclasses
import json

import pytest

from docsieve.operators import field_rules as R
from docsieve.operators import types as T

SCHEMA = "kind string, part string, name string, value string"


def spec(rule) -> dict:
    """A rule as its JSON."""
    out = {"rule": type(rule).__name__.lower()}
    for f in dataclasses.fields(rule):
        v = getattr(rule, f.name)
        name = "then" if isinstance(rule, R.If) and f.name == "rule" else f.name
        if isinstance(rule, R.First):
            out[name] = [spec(r) for r in v]
        elif v is not None:
            out[name] = spec(v) if dataclasses.is_dataclass(v) else v
    return out


def test_built_in_types_survive_a_table(spark):
    rows = []
    for kind, (rules, mandatory) in R.RULES.items():
        rows += [(kind, "field", k, json.dumps(spec(r))) for k, r in rules.items()] + [(kind, "mandatory", m, str(i)) for i, m in enumerate(mandatory)]
        rows += [(kind, "key", p, str(w)) for p, w in T.BUILT_IN.keys[kind].items()] + [(kind, "check", n, json.dumps(test)) for n, *test in R.CHECKS[kind]]
    got = T.compiled(spark.createDataFrame(rows, SCHEMA))
    assert got.rules == R.RULES and got.keys == T.BUILT_IN.keys
    assert {k: set(v) for k, v in got.checks.items()} == {k: set(v) for k, v in R.CHECKS.items()}


@pytest.mark.parametrize(
    ("row", "says"),
    [
        (("a", "field", "x", '{"rule": "said", "patterns": ["("]}'), "pattern"), (("a", "field", "x", '{"rule": "said", "patterns": ["abc"]}'), "lacks a group"), (("a", "field", "x", '{"rule": "guess"}'), "no rule"), (("a", "field", "x", "{"), "a/field/x"),
        (("a", "field", "x", '{"rule": "beside", "label": "A", "kind": "number"}'), "no kind"), (("a", "field", "x", '{"rule": "dated", "label": "A"}'), "lacks rows"), (("a", "field", "x", '{"rule": "whole", "name": "eval"}'), "no reading"), (("a", "key", "A", "many"), "a/key/A"),
        (("a", "mandatory", "y", None), "no such field"), (("a", "check", "c", '["past", "y"]'), "no field"), (("a", "check", "c", '["magic"]'), "no test"), (("a", "rule", "c", ""), "no part"), ((None, "key", "A", "1"), "needed"), (("b", "key", "A", "1"), "b: no fields"),
    ],
)
def test_faults_are_named(spark, row, says):
    good = ("a", "field", "ok", '{"rule": "whole", "name": "document_date"}')
    with pytest.raises(T.Faults) as e:
        T.compiled(spark.createDataFrame([good, row], SCHEMA))
    assert len(e.value.faults) == 1 and says in e.value.faults[0]


def test_an_empty_table_has_no_types(spark):
    assert T.compiled(spark.createDataFrame([], SCHEMA)) == T.Types({}, {}, {}, {})
