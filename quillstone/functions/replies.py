"""Replies of a model as JSON under a schema: parsing, and what is wrong with them."""

from __future__ import annotations

import json
import math

from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, MapType, StringType, StructType

_NAMES = {StringType: "string", BooleanType: "boolean", LongType: "integer", IntegerType: "integer", DoubleType: "number", FloatType: "number", ArrayType: "array", StructType: "object", MapType: "object"}


def kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(value)]


def _fits(value, schema: DataType) -> bool:
    want, have = _NAMES[type(schema)], kind(value)
    if want == "number":
        return have in ("integer", "number") and math.isfinite(value)
    if want == "integer":
        bits = 31 if isinstance(schema, IntegerType) else 63
        return (have == "integer" or have == "number" and math.isfinite(value) and value == int(value)) and -(1 << bits) <= value < 1 << bits
    return have == want


def violations(value, schema: DataType, path: str = "") -> list[str]:
    """'path: what is wrong' of each part that does not fit. A field that may be null may be absent; fields that the schema does not name are passed over."""
    where = path or "(reply)"
    if not _fits(value, schema):
        return [f"{where}: expected {_NAMES[type(schema)]}, received {kind(value)}"]
    at = lambda name: f"{path}.{name}" if path else str(name)
    if isinstance(schema, StructType):
        out = []
        for f in schema.fields:
            if value.get(f.name) is None:
                out += [] if f.nullable else [f"{at(f.name)}: required"]
            else:
                out += violations(value[f.name], f.dataType, at(f.name))
        return out
    if isinstance(schema, ArrayType):
        return [v for i, x in enumerate(value) for v in (violations(x, schema.elementType, at(i)) if x is not None or not schema.containsNull else [])]
    if isinstance(schema, MapType):
        return [v for k, x in value.items() for v in violations(x, schema.valueType, at(k))]
    return []


def bare(reply: str) -> str:
    """The JSON of a reply: without a code fence around it and words before it."""
    text = reply.strip()
    if text.startswith("```"):
        text = text[3:].removeprefix("json").removesuffix("```").strip()
    starts = [i for i in (text.find("{"), text.find("[")) if i >= 0]
    return text[min(starts) :] if starts else text


def checked(reply: str | None, schema: DataType) -> tuple[str | None, str | None]:
    """The reply's JSON (keys sorted), or what is wrong with it, a line for each violation."""
    text = bare(reply or "")
    try:
        value = json.loads(text)
    except ValueError as e:
        return None, f"no JSON: {e}; it begins {text[:500]!r}"
    wrong = violations(value, schema)
    return (None, "\n".join(wrong)) if wrong else (json.dumps(value, sort_keys=True, ensure_ascii=False), None)
