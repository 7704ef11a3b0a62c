"""Document types as rows of a table: checked as a whole, then compiled to the rules that extractors turn into columns.

A table has (kind, part, name, value), all text:

- ``key``: a pattern by which the type is recognised, and its points;
- ``field``: a field and its rule as JSON, an object with ``rule`` (the name of a kind of
  rule in ``field_rules``) and that rule's own values; rules may hold rules;
- ``mandatory``: a field that must be read;
- ``check``: a check, and as a JSON array its test with the arguments.
"""

from __future__ import annotations

import dataclasses
import json
import re
from typing import Any

from pyspark.sql import DataFrame

from . import classify, extract
from . import field_rules as R

#: Rows of a table at most: types are written by hand, and become part of a plan.
MOST_ROWS = 100_000
PARTS = ("key", "field", "mandatory", "check")
RULE_KINDS = {c.__name__.lower(): c for c in (R.Said, R.Beside, R.Behind, R.Dated, R.OneOf, R.Whole, R.Told, R.First, R.If, R.Of)}
#: Tests of checks, and how many arguments they take at least.
TESTS = {"addressed": 0, "past": 1, "before": 2, "in_force": 2, "at_least": 2, "says": 1, "id_letter": 0, "holds": 2, "one_of": 2, "starts": 2, "true": 1, "read": 1, "valid_id": 1}
COMPUTED = ("profession", "expiry", "months")


class Faults(ValueError):
    """All that is wrong with a table."""

    def __init__(self, faults: list[str]):
        super().__init__("; ".join(faults))
        self.faults = faults


@dataclasses.dataclass(frozen=True)
class Types:
    """Types in registry order: patterns with points, rules with mandatory fields, fields of which one is enough, and checks."""

    keys: dict[str, dict[str, float]]
    rules: dict[str, tuple[dict[str, object], tuple[str, ...]]]
    either: dict[str, tuple[str, str]]
    checks: dict[str, tuple[tuple, ...]]

    def plus(self, other: Types) -> Types:
        """These types and others; a type of the same name is replaced."""
        return Types(self.keys | other.keys, self.rules | other.rules, {k: v for k, v in self.either.items() if k not in other.rules} | other.either, self.checks | other.checks)


BUILT_IN = Types(classify.KEYS, R.RULES, R.EITHER, R.CHECKS)


def _pattern(text: Any) -> str:
    if not isinstance(text, str) or not text:
        raise ValueError(f"no pattern: {text!r}")
    try:
        re.compile(text)
    except re.error as e:
        raise ValueError(f"pattern {text!r}: {e}") from None
    return text


def _tuple(x: Any) -> Any:
    return tuple(map(_tuple, x)) if isinstance(x, list) else x


def rule_of(spec: Any) -> object:
    """A rule from its JSON; raises ValueError for what no rule is."""
    if not isinstance(spec, dict) or spec.get("rule") not in RULE_KINDS:
        raise ValueError(f"no rule: {spec!r}")
    kind = RULE_KINDS[spec["rule"]]
    values = {k: v for k, v in spec.items() if k != "rule"}
    # the inner rule of a condition is "then", as "rule" is the kind
    names = {"then" if kind is R.If and f.name == "rule" else f.name: f for f in dataclasses.fields(kind)}
    if extra := sorted(values.keys() - names.keys()):
        raise ValueError(f"{spec['rule']} has no {', '.join(extra)}")
    if lacking := [n for n, f in names.items() if n not in values and f.default is dataclasses.MISSING]:
        raise ValueError(f"{spec['rule']} lacks {', '.join(lacking)}")
    if kind is R.First:
        return R.First(tuple(map(rule_of, values["rules"])))
    if kind is R.If:
        return R.If(_test(values["test"]), rule_of(values["then"]), rule_of(values["other"]) if values.get("other") else None)
    made = kind(**{k: _tuple(v) for k, v in values.items()})
    match made:
        case R.Said(patterns, groups, shape):
            if not patterns or any(re.compile(_pattern(p)).groups < max(groups) for p in patterns):
                raise ValueError("said: a pattern lacks a group")
            _known(shape, extract.SHAPES, "shape")
        case R.Beside(label, value, kind_, part, shape):
            _pattern(label), value and _pattern(value), _known(kind_, extract.KINDS, "kind"), _known(shape, extract.SHAPES, "shape")
            if part is not None:
                _known(part, extract.PARTS, "part")
        case R.Behind(label, value, _):
            _pattern(label)
            if re.compile(_pattern(value)).groups < 1:
                raise ValueError("behind: the value has no group")
        case R.Dated(label, rows):
            _pattern(label), _known(rows, range(0, 6), "rows")
        case R.Whole(name, label):
            _known(name.partition(" in ")[0], vars(extract.Readings), "reading")
            if label is not None:
                _pattern(label)
        case R.Told(table):
            for tests, _ in table:
                for t in tests:
                    _test(t)
        case R.Of(name):
            _known(name, COMPUTED, "computed value")
    return made


def _test(t: Any) -> str:
    return t if t in extract.CONDITIONS else "!" + _pattern(t[1:]) if isinstance(t, str) and t.startswith("!") else _pattern(t)


def _known(name: Any, names: Any, what: str) -> None:
    if name not in names:
        raise ValueError(f"no {what} {name!r}")


def compiled(table: DataFrame) -> Types:
    """The types of a table (kind, part, name, value); raises Faults with every row that is wrong.

    Rows count in the order of kind and name, but for mandatory fields, which go by the
    order of their values where they have any. A type needs a field; its mandatory fields
    and the fields of its checks have to be among them. An empty table has no types.
    """
    rows = table.select("kind", "part", "name", "value").limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise Faults([f"more than {MOST_ROWS} rows"])
    keys: dict[str, dict[str, float]] = {}
    fields: dict[str, dict[str, object]] = {}
    mandatory: dict[str, list[tuple[str, str]]] = {}
    checks: dict[str, list[tuple]] = {}
    faults = []
    for kind, part, name, value in sorted(map(tuple, rows), key=lambda r: tuple(map(str, r))):
        try:
            if not kind or not name:
                raise ValueError("kind and name are needed")
            _known(part, PARTS, "part")
            fields.setdefault(kind, {})
            if part == "key":
                points = float(value)
                if not 0 < points < 1000:
                    raise ValueError(f"points {value}")
                keys.setdefault(kind, {})[_pattern(name)] = points
            elif part == "field":
                if name in fields[kind]:
                    raise ValueError("there twice")
                fields[kind][name] = rule_of(json.loads(value))
            elif part == "mandatory":
                mandatory.setdefault(kind, []).append((value or "", name))
            else:
                test = json.loads(value)
                if not isinstance(test, list) or not test or test[0] not in TESTS or len(test) - 1 < TESTS[test[0]]:
                    raise ValueError(f"no test: {value}")
                checks.setdefault(kind, []).append((name, *map(_tuple, test)))
        except (ValueError, TypeError, KeyError) as e:
            faults.append(f"{kind}/{part}/{name}: {e}")
    for kind in fields:
        if not fields[kind] and not any(f.startswith(f"{kind}/field/") for f in faults):
            faults.append(f"{kind}: no fields")
        faults += [f"{kind}/mandatory/{m}: no such field" for _, m in mandatory.get(kind, []) if m not in fields[kind]]
        faults += [f"{kind}/check/{n}: no field {a!r}" for n, t, *args in checks.get(kind, []) for a in _checked(t, args) if a not in fields[kind]]
    if faults:
        raise Faults(faults)
    rules = {k: (f, tuple(m for _, m in sorted(mandatory.get(k, [])))) for k, f in fields.items()}
    return Types({k: keys.get(k, {}) for k in fields}, rules, {}, {k: tuple(checks.get(k, ())) for k in fields})


def _checked(test: str, args: list) -> list:
    """The fields that a test looks at."""
    return {"says": [], "addressed": ["titular", "tratamiento"], "id_letter": ["nif"], "before": args[:2], "in_force": args[:2]}.get(test, args[:1])
