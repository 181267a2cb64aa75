"""JSON Schema as one Spark expression.

The schema is compiled to a Column that gives the errors of a record; the record is parsed once and walked as a variant, objects as
maps and arrays element by element, to any depth the schema has. A keyword that is not known here raises, so that nothing
passes because it was not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from huntlake.functions.common import let

#: Keywords that say nothing about validity.
NOTES = ("$schema", "$id", "$comment", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly")
TYPES = ("string", "boolean", "object", "array", "null", "number", "integer")


class SchemaError(ValueError):
    """The schema uses something that is not checked, or is not well formed."""


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _canonical(value) -> str:
    """A JSON value as text with sorted keys, whole numbers without fraction."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (int, float)):
        return repr(int(value)) if value == int(value) else repr(value)
    if isinstance(value, Mapping):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_canonical(value[k])}" for k in sorted(value)) + "}"
    return "[" + ",".join(map(_canonical, value)) + "]"


class _Value:
    """A variant and what is asked about it more than once."""

    def __init__(self, value: Column, kind: Column, path: Column):
        self.value, self.kind, self.path = value, kind, path

    def error(self, keyword: str, broken: Column) -> Column:
        return F.when(F.coalesce(broken, F.lit(False)), F.concat(F.lit(f"{keyword}:"), self.shown()))

    def shown(self) -> Column:
        return F.when(self.path == "", "$").otherwise(self.path)

    def below(self, key: Column) -> Column:
        return F.when(self.path == "", key).otherwise(F.concat(self.path, F.lit("."), key))

    @property
    def is_number(self) -> Column:
        return self.kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")

    @property
    def number(self) -> Column:
        return F.try_variant_get(self.value, "$", "double")

    def has_type(self, name: str) -> Column:
        if name == "integer":
            return (self.kind == "BIGINT") | (self.is_number & (self.number % 1 == 0))
        return {
            "string": self.kind == "STRING", "boolean": self.kind == "BOOLEAN", "object": self.kind.startswith("OBJECT"),
            "array": self.kind.startswith("ARRAY"), "null": self.kind == "VOID", "number": self.is_number,
        }[name]

    def equals(self, wanted) -> Column:
        """The same JSON value; 1 and 1.0 are the same."""
        if isinstance(wanted, bool):
            return (self.kind == "BOOLEAN") & (F.try_variant_get(self.value, "$", "boolean") == wanted)
        if wanted is None:
            return self.kind == "VOID"
        if isinstance(wanted, str):
            return (self.kind == "STRING") & (F.try_variant_get(self.value, "$", "string") == wanted)
        if isinstance(wanted, (int, float)):
            return self.is_number & (self.number == float(wanted))
        # objects and arrays: variants print with sorted keys
        return F.to_json(self.value) == _canonical(wanted)


def _number(schema: Mapping, keyword: str, whole: bool = False) -> float | int:
    value = schema[keyword]
    if isinstance(value, bool) or not isinstance(value, (int, float)) or whole and (value != int(value) or value < 0):
        raise SchemaError(f"{keyword} must be a {'whole number' if whole else 'number'}")
    return value


def _types(schema: Mapping) -> list[str]:
    names = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
    if unknown := [n for n in names if n not in TYPES]:
        raise SchemaError(f"unknown type {unknown[0]!r}")
    return names


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for test in tests:
        out = out | F.coalesce(test, F.lit(False))
    return out


def _errors(schema: Mapping | bool, value: Column, path: Column) -> Column:
    """Array of errors of a variant under a schema."""
    if schema is True:
        return _texts([])
    if schema is False:
        return F.array(F.concat(F.lit("false:"), F.when(path == "", "$").otherwise(path)))
    if not isinstance(schema, Mapping):
        raise SchemaError("a schema is an object or a boolean")
    known = {*_SCALAR, *_OBJECT, *_ARRAY, *_COMBINED, *NOTES, "type"}
    if unknown := sorted(set(schema) - known):
        raise SchemaError(f"keyword {unknown[0]!r} is not supported")

    def body(kind: Column) -> Column:
        v = _Value(value, kind, path)
        single = [make(v, schema) for keyword, make in _SCALAR.items() if keyword in schema]
        if "type" in schema:
            single.append(v.error("type", ~_any([v.has_type(n) for n in _types(schema)])))
        parts = [F.array_compact(F.array(*single))] if single else []
        parts += [make(v, schema) for keyword, make in _COMBINED.items() if keyword in schema]
        if any(k in schema for k in _OBJECT):
            parts.append(F.when(v.has_type("object"), let(F.try_variant_get(value, "$", "map<string,variant>"), lambda m: _object(v, schema, m))))
        if any(k in schema for k in _ARRAY):
            parts.append(F.when(v.has_type("array"), let(F.try_variant_get(value, "$", "array<variant>"), lambda a: _array(v, schema, a))))
        none = _texts([])
        return F.concat(none, *[F.coalesce(p, none) for p in parts])

    return let(F.schema_of_variant(value), body)


def _limit(keyword: str, broken: Callable[[Column, float], Column]):
    return lambda v, s: v.error(keyword, v.is_number & broken(v.number, float(_number(s, keyword))))


def _length(keyword: str, broken: Callable[[Column, int], Column]):
    return lambda v, s: v.error(keyword, v.has_type("string") & broken(F.length(F.try_variant_get(v.value, "$", "string")), int(_number(s, keyword, True))))


def _multiple(v: _Value, s: Mapping) -> Column:
    step = _number(s, "multipleOf")
    if step <= 0:
        raise SchemaError("multipleOf must be above zero")
    exact = F.try_variant_get(v.value, "$", "decimal(38,10)") % F.lit(str(step)).cast("decimal(38,10)")
    return v.error("multipleOf", v.is_number & (exact != 0))


def _enum(v: _Value, s: Mapping) -> Column:
    if not isinstance(s["enum"], (list, tuple)):
        raise SchemaError("enum must be an array")
    return v.error("enum", ~_any([v.equals(x) for x in s["enum"]]))


_SCALAR = {
    "enum": _enum,
    "const": lambda v, s: v.error("const", ~F.coalesce(v.equals(s["const"]), F.lit(False))),
    "minimum": _limit("minimum", lambda x, n: x < n),
    "maximum": _limit("maximum", lambda x, n: x > n),
    "exclusiveMinimum": _limit("exclusiveMinimum", lambda x, n: x <= n),
    "exclusiveMaximum": _limit("exclusiveMaximum", lambda x, n: x >= n),
    "multipleOf": _multiple,
    "minLength": _length("minLength", lambda x, n: x < n),
    "maxLength": _length("maxLength", lambda x, n: x > n),
    "pattern": lambda v, s: v.error("pattern", v.has_type("string") & ~F.try_variant_get(v.value, "$", "string").rlike(s["pattern"])),
}


def _combined(keyword: str, broken: Callable[[Column, int], Column]):
    def make(v: _Value, s: Mapping) -> Column:
        if not s[keyword]:
            raise SchemaError(f"{keyword} must not be empty")
        fits = [F.when(F.size(_errors(x, v.value, v.path)) == 0, 1).otherwise(0) for x in s[keyword]]
        return F.array_compact(F.array(v.error(keyword, broken(sum(fits[1:], fits[0]), len(fits)))))
    return make


_COMBINED = {
    "allOf": lambda v, s: F.concat(*[_errors(x, v.value, v.path) for x in s["allOf"]]),
    "anyOf": _combined("anyOf", lambda n, _: n == 0),
    "oneOf": _combined("oneOf", lambda n, _: n != 1),
    "not": lambda v, s: F.array_compact(F.array(v.error("not", F.size(_errors(s["not"], v.value, v.path)) == 0))),
}
_OBJECT = ("properties", "required", "additionalProperties", "minProperties", "maxProperties", "propertyNames")
_ARRAY = ("items", "minItems", "maxItems", "uniqueItems", "contains")


def _object(v: _Value, schema: Mapping, m: Column) -> Column:
    keys, props, parts = F.map_keys(m), schema.get("properties", {}), []
    tagged = lambda keyword, found: F.transform(found, lambda k: F.concat(F.lit(f"{keyword}:"), v.below(k)))
    if "required" in schema:
        parts.append(tagged("required", F.array_except(_texts(schema["required"]), keys)))
    for k, sub in props.items():
        # the value of a key that is there is never a missing one: JSON null is a variant of its own
        parts.append(F.when(F.map_contains_key(m, k), let(F.element_at(m, F.lit(k)), lambda x, s=sub, k=k: _errors(s, x, v.below(F.lit(k))))))
    rest = schema.get("additionalProperties", True)
    if rest is False:
        parts.append(tagged("additional", F.array_except(keys, _texts(list(props)))))
    elif rest is not True:
        others = F.array_except(keys, _texts(list(props)))
        parts.append(F.flatten(F.transform(others, lambda k: _errors(rest, F.element_at(m, k), v.below(k)))))
    counts = [v.error("minProperties", F.size(m) < int(_number(schema, "minProperties", True)))] if "minProperties" in schema else []
    counts += [v.error("maxProperties", F.size(m) > int(_number(schema, "maxProperties", True)))] if "maxProperties" in schema else []
    if counts:
        parts.append(F.array_compact(F.array(*counts)))
    if "propertyNames" in schema:
        parts.append(F.flatten(F.transform(keys, lambda k: F.transform(
            _errors(schema["propertyNames"], F.to_variant_object(F.array(k)).cast("array<variant>")[0], F.lit("")),
            lambda e: F.concat(F.lit("propertyNames:"), v.below(k))))))
    none = _texts([])
    return F.concat(none, *[F.coalesce(p, none) for p in parts])


def _array(v: _Value, schema: Mapping, a: Column) -> Column:
    none, parts, single = _texts([]), [], []
    if "items" in schema:
        if isinstance(schema["items"], (list, tuple)):
            raise SchemaError("items must be one schema")
        parts.append(F.flatten(F.transform(a, lambda x, i: _errors(schema["items"], x, F.concat(v.path, F.lit("["), i.cast("string"), F.lit("]"))))))
    if "minItems" in schema:
        single.append(v.error("minItems", F.size(a) < int(_number(schema, "minItems", True))))
    if "maxItems" in schema:
        single.append(v.error("maxItems", F.size(a) > int(_number(schema, "maxItems", True))))
    if schema.get("uniqueItems"):
        single.append(v.error("uniqueItems", F.size(F.array_distinct(F.transform(a, lambda x: F.to_json(x)))) < F.size(a)))
    if "contains" in schema:
        single.append(v.error("contains", ~F.exists(a, lambda x: F.size(_errors(schema["contains"], x, F.lit(""))) == 0)))
    if single:
        parts.append(F.array_compact(F.array(*single)))
    return F.concat(none, *[F.coalesce(p, none) for p in parts])


def record_errors(text: Column, schema: Mapping) -> Column:
    """Sorted distinct errors of a JSON object given as text: ``keyword:path``, such as ``type:port``, ``required:source.ip`` or
    ``maximum:scores[2]``; ``additional:k`` for a key that is not allowed. Text that is no JSON object, NULL included,
    gives ``type:$`` alone. Empty means valid."""
    _errors(schema, F.lit(None).cast("variant"), F.lit(""))  # a bad schema raises here, also for an empty table

    def checked(doc: Column) -> Column:
        found = F.array_distinct(F.sort_array(_errors(schema, doc, F.lit(""))))
        return F.when(F.schema_of_variant(doc).startswith("OBJECT"), found).otherwise(_texts(["type:$"]))

    return let(F.try_parse_json(text), checked)
