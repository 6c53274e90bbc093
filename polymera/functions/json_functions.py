"""Functions of JSON text: dot paths, top-level edits, containment."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _path(path: str) -> str:
    parts = [p for p in path.removeprefix("$").replace("[", ".").replace("]", "").split(".") if p]
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in parts)


def json_extract(j: Column, path: str) -> Column:
    """JSON text at a dot path of keys and indexes (a scalar string without its quotes); null if absent. json_get means the same."""
    return F.get_json_object(j, _path(path))


def json_value(j: Column, path: str) -> Column:
    """Text of the scalar at a path; null for objects and arrays."""
    found = F.get_json_object(j, _path(path))
    return F.when(~found.rlike(r"^\s*[\[{]"), found)


def json_query(j: Column, path: str) -> Column:
    """JSON text of the object or array at a path."""
    found = F.get_json_object(j, _path(path))
    return F.when(found.rlike(r"^\s*[\[{]"), found)


def json_exists(j: Column, path: str) -> Column:
    return F.get_json_object(j, _path(path)).isNotNull()


def _members(j: Column) -> Column:
    """Top-level members of an object as JSON texts by key."""
    return F.map_from_entries(F.transform(F.coalesce(F.json_object_keys(j), F.array().cast("array<string>")), lambda k: F.struct(k, F.get_json_object(j, F.concat(F.lit("$['"), k, F.lit("']"))))))


@F.pandas_udf(T.StringType())
def _set(j: pd.Series, k: pd.Series, v: pd.Series) -> pd.Series:
    def one(a, key, value):
        d = _load(a)
        return json.dumps(d | {key: _load(value, value)}, separators=(",", ":"), ensure_ascii=False) if isinstance(d, dict) else a

    return pd.Series([one(*x) for x in zip(j, k, v)])


def _load(text, default=None):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return default


def json_set(j: Column, key: str, value: Column) -> Column:
    """The object with a top-level key set to a value, read as JSON if it is JSON and else a string."""
    return _set(j, F.lit(key), value.cast("string"))


@F.pandas_udf(T.StringType())
def _remove(j: pd.Series, k: pd.Series) -> pd.Series:
    found = [(_load(a), a, key) for a, key in zip(j, k)]
    return pd.Series([json.dumps({n: v for n, v in d.items() if n != key}, separators=(",", ":"), ensure_ascii=False) if isinstance(d, dict) else a for d, a, key in found])


def json_remove(j: Column, key: str) -> Column:
    """The object without a top-level key."""
    return _remove(j, F.lit(key))


@F.pandas_udf(T.StringType())
def _merge(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = [(_load(x), _load(y), x) for x, y in zip(a, b)]
    return pd.Series([json.dumps(x | y, separators=(",", ":"), ensure_ascii=False) if isinstance(x, dict) and isinstance(y, dict) else t for x, y, t in pairs])


def json_merge(a: Column, b: Column) -> Column:
    """Shallow merge of two objects, the second winning; json_patch means the same."""
    return _merge(a, b)


def json_keys(j: Column) -> Column:
    return F.json_object_keys(j)


def json_values(j: Column) -> Column:
    """Texts of an object's top-level values."""
    return F.map_values(_members(j))


def json_length(j: Column) -> Column:
    """Members of an object or array; bytes of a string."""
    return F.coalesce(F.json_array_length(j), F.size(F.json_object_keys(j)), F.octet_length(F.get_json_object(F.concat(F.lit('{"v":'), j, F.lit("}")), "$.v")))


def json_type(j: Column) -> Column:
    """null, boolean, number, string, array or object; null for what is not JSON."""
    kind = F.schema_of_variant(F.try_parse_json(j))
    return F.when(kind == "VOID", "null").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind.isNotNull(), "number")


@F.pandas_udf(T.BooleanType())
def _contains(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_holds(_load(x), _load(y)) if x is not None and y is not None else None for x, y in zip(a, b)])


def _holds(a, b) -> bool:
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and _holds(a[k], v) for k, v in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(_holds(x, y) for x in a) for y in b)
    return a == b and isinstance(a, bool) == isinstance(b, bool) if not isinstance(a, list) else any(_holds(x, b) for x in a)


def contains(a: Column, b: Column) -> Column:
    """The @> test: every member of b is in a, at all depths. <@ is the same with its sides changed."""
    return _contains(a, b)


def has_key(j: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(j), key), F.lit(False))


def has_all_keys(j: Column, keys: list[str]) -> Column:
    return F.lit(True) if not keys else has_key(j, keys[0]) & has_all_keys(j, keys[1:])


def has_any_key(j: Column, keys: list[str]) -> Column:
    return F.lit(False) if not keys else has_key(j, keys[0]) | has_any_key(j, keys[1:])


def json_contains(j: Column, value: str) -> Column:
    """An array holds a value, or an object has a key."""
    items = F.coalesce(F.from_json(j, "array<string>"), F.array().cast("array<string>"))
    return F.when(F.json_array_length(j).isNotNull(), F.array_contains(items, value)).otherwise(has_key(j, value))


def json_array(*values: Column) -> Column:
    return F.to_json(F.array(*values))


def json_object(*pairs: Column) -> Column:
    """Object of keys and values in turn."""
    return F.to_json(F.create_map(*pairs))


def doc_get(doc: Column, path: str, default: Column | None = None) -> Column:
    found = json_extract(doc, path)
    return found if default is None else F.coalesce(found, default)


def doc_exists(doc: Column, path: str) -> Column:
    return json_exists(doc, path)


def doc_array_contains(doc: Column, path: str, value: str) -> Column:
    return F.coalesce(F.array_contains(F.from_json(json_extract(doc, path), "array<string>"), value), F.lit(False))
