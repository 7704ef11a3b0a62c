"""A snapshot of the schemas of results, and what a later one adds, narrows or takes away."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed order: each number type holds all values of those before it.
WIDTH = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
REAL = [T.FloatType(), T.DoubleType()]


def snapshot(results: Mapping[str, DataFrame]) -> dict[str, dict]:
    """The schema of each result as plain JSON values; nothing is computed but plans."""
    return {name: df.schema.jsonValue() for name, df in sorted(results.items())}


def _kind(old: T.DataType, new: T.DataType) -> str | None:
    for line in (WIDTH, REAL):
        if old in line and new in line:
            a, b = line.index(old), line.index(new)
            return None if a == b else "widened" if a < b else "narrowed"
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType) and old != new:
        room = lambda d: (d.precision - d.scale, d.scale)
        grew = [b >= a for a, b in zip(room(old), room(new))]
        return "widened" if all(grew) else "narrowed" if not any(b > a for a, b in zip(room(old), room(new))) else "retyped"
    return None if old == new else "retyped"


def _walk(path: str, old: T.DataType, new: T.DataType) -> Iterator[tuple[str, str]]:
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        before, after = {f.name: f for f in old}, {f.name: f for f in new}
        for name in [*before, *(n for n in after if n not in before)]:
            inner = f"{path}.{name}" if path else name
            if name not in after:
                yield inner, "removed"
            elif name not in before:
                yield inner, "added"
            else:
                yield from _null(inner, before[name].nullable, after[name].nullable)
                yield from _walk(inner, before[name].dataType, after[name].dataType)
    elif isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        yield from _null(f"{path}[]", old.containsNull, new.containsNull)
        yield from _walk(f"{path}[]", old.elementType, new.elementType)
    elif isinstance(old, T.MapType) and isinstance(new, T.MapType):
        yield from _null(f"{path}{{}}", old.valueContainsNull, new.valueContainsNull)
        yield from _walk(f"{path}{{key}}", old.keyType, new.keyType)
        yield from _walk(f"{path}{{}}", old.valueType, new.valueType)
    elif kind := _kind(old, new):
        yield path, kind


def _null(path: str, old: bool, new: bool) -> Iterator[tuple[str, str]]:
    if old != new:
        yield path, "nullable" if new else "never null"


def changes(before: Mapping[str, dict], after: Mapping[str, dict]) -> list[tuple[str, str, str]]:
    """(result, field, kind) of each difference between two snapshots, in the order of results and fields.

    Kinds: added, removed, widened, narrowed, retyped, nullable, never null; a whole
    result that comes or goes has the field "". The order of fields is no difference.
    """
    out = []
    for name in sorted({*before, *after}):
        if name not in before or name not in after:
            out.append((name, "", "added" if name in after else "removed"))
        else:
            out += [(name, *x) for x in _walk("", T.StructType.fromJson(before[name]), T.StructType.fromJson(after[name]))]
    return out


#: The kinds of change that break a reader of the earlier results.
BREAKING = ("removed", "narrowed", "retyped", "nullable")


def breaking(found: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    return [x for x in found if x[2] in BREAKING]
