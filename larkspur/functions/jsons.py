"""JSON functions. Reading is built from Spark's parser; changing a document, which Spark
has no function for, goes through Arrow batches."""

from __future__ import annotations

import json
import re
from functools import partial
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = re.compile(r"\.(?:\"([^\"]+)\"|([A-Za-z0-9_]+))|\[(\d+)\]")


def path_steps(path: str) -> list[str | int]:
    """Steps of ``$``, ``.key`` and ``[i]``."""
    if not path.startswith("$"):
        raise ValueError(f"not a path: {path}")
    out: list[str | int] = []
    at = 1
    while at < len(path):
        m = STEP.match(path, at)
        if not m:
            raise ValueError(f"not a path: {path}")
        out.append(int(m[3]) if m[3] is not None else m[1] or m[2])
        at = m.end()
    return out


class Number(float):
    """A number with a point or exponent, which keeps its spelling."""

    text: str

    @classmethod
    def of(cls, text: str) -> Number:
        out = cls(text)
        out.text = text
        return out


def _refuse(name: str) -> Any:
    raise ValueError(f"{name} isn't JSON")


def dump(value: Any) -> str:
    """Text with ", " and ": " between, keys in their order, numbers as they were spelt."""
    if isinstance(value, Number):
        return value.text
    if isinstance(value, list):
        return "[" + ", ".join(map(dump, value)) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {dump(v)}" for k, v in value.items()) + "}"
    return json.dumps(value, ensure_ascii=False)


def parse(text: str) -> Any:
    return json.loads(text, parse_float=Number.of, parse_constant=_refuse)


def _load(text: str | None) -> tuple[bool, Any]:
    if text is None:
        return False, None
    try:
        return True, parse(text)
    except (ValueError, RecursionError):
        return False, None


def _find(doc: Any, steps: list[str | int]) -> tuple[bool, Any]:
    for s in steps:
        if isinstance(s, int) and isinstance(doc, list) and s < len(doc):
            doc = doc[s]
        elif isinstance(s, str) and isinstance(doc, dict) and s in doc:
            doc = doc[s]
        else:
            return False, None
    return True, doc


def value(doc: Column, path: str) -> Column:
    """``->>``: the value without quotes."""
    return F.get_json_object(doc, path)


def _edit(act):
    @F.pandas_udf("string")
    def run(docs: pd.Series) -> pd.Series:
        out = []
        for text in docs:
            ok, doc = _load(text)
            out.append(dump(act(doc)) if ok else None)
        return pd.Series(out, dtype=object)

    return run


def extract(doc: Column, path: str) -> Column:
    """``->``: the value as JSON text, keys in their order; NULL if there is none."""
    steps = path_steps(path)

    @F.pandas_udf("string")
    def run(docs: pd.Series) -> pd.Series:
        out = []
        for text in docs:
            ok, parsed = _load(text)
            found, v = _find(parsed, steps) if ok else (False, None)
            out.append(dump(v) if found else None)
        return pd.Series(out, dtype=object)

    return run(doc)


def _put(doc: Any, steps: list[str | int], new: Any, add: bool, replace: bool) -> Any:
    if not steps:
        return new if replace else doc
    ok, parent = _find(doc, steps[:-1])
    last = steps[-1]
    if not ok:
        return doc
    if isinstance(last, str) and isinstance(parent, dict):
        if (last in parent and replace) or (last not in parent and add):
            parent[last] = new
    elif isinstance(last, int) and isinstance(parent, list):
        if last < len(parent):
            if replace:
                parent[last] = new
        elif add:
            parent.append(new)
    return doc


def set_value(doc: Column, path: str, new: Any) -> Column:
    """JSON_SET: add or replace."""
    steps = path_steps(path)
    return _edit(lambda d: _put(d, steps, new, True, True))(doc)


def insert_value(doc: Column, path: str, new: Any) -> Column:
    """JSON_INSERT: add only."""
    steps = path_steps(path)
    return _edit(lambda d: _put(d, steps, new, True, False))(doc)


def replace_value(doc: Column, path: str, new: Any) -> Column:
    """JSON_REPLACE: replace only."""
    steps = path_steps(path)
    return _edit(lambda d: _put(d, steps, new, False, True))(doc)


def remove(doc: Column, path: str) -> Column:
    """JSON_REMOVE; the document itself if the path isn't there."""
    steps = path_steps(path)

    def act(d: Any) -> Any:
        ok, parent = _find(d, steps[:-1])
        if ok and steps:
            last = steps[-1]
            if isinstance(last, str) and isinstance(parent, dict):
                parent.pop(last, None)
            elif isinstance(last, int) and isinstance(parent, list) and last < len(parent):
                parent.pop(last)
        return d

    return _edit(act)(doc)


def _within(target: Any, part: Any) -> bool:
    if isinstance(target, list):
        if isinstance(part, list):
            return all(any(_within(t, p) for t in target) for p in part)
        return any(_within(t, part) for t in target)
    if isinstance(target, dict):
        return isinstance(part, dict) and all(k in target and _within(target[k], v) for k, v in part.items())
    return type(target) is type(part) and target == part or (
        isinstance(target, (int, float))
        and isinstance(part, (int, float))
        and not isinstance(target, bool)
        and not isinstance(part, bool)
        and target == part
    )


def contains(doc: Column, candidate: Any, path: str = "$") -> Column:
    """JSON_CONTAINS: 1, 0, or NULL if the path isn't there."""
    steps = path_steps(path)

    @F.pandas_udf("long")
    def run(docs: pd.Series) -> pd.Series:
        out = []
        for text in docs:
            ok, parsed = _load(text)
            found, v = _find(parsed, steps) if ok else (False, None)
            out.append(int(_within(v, candidate)) if found else None)
        return pd.Series(out, dtype="Int64")

    return run(doc)


def length(doc: Column) -> Column:
    """Elements of an array, keys of an object, 1 for a scalar; NULL if it isn't JSON."""
    arrays = F.json_array_length(doc).cast("bigint")
    keys = F.size(F.json_object_keys(doc)).cast("bigint")
    return F.when(valid(doc) == 1, F.coalesce(arrays, F.when(F.json_object_keys(doc).isNotNull(), keys), F.lit(1)))


def keys(doc: Column) -> Column:
    """Keys of an object as a JSON array, NULL for anything else."""
    names = F.json_object_keys(doc)
    quoted = F.transform(names, quote)
    return F.when(names.isNotNull(), F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")))


def valid(doc: Column) -> Column:
    return F.try_parse_json(doc).isNotNull().cast("int")


#: Names of the types.
TYPES = {"BOOLEAN": "BOOLEAN", "STRING": "STRING", "VOID": "NULL", "DOUBLE": "DOUBLE", "FLOAT": "DOUBLE"}


def type_of(doc: Column) -> Column:
    """OBJECT, ARRAY, STRING, INTEGER, DOUBLE, BOOLEAN or NULL."""
    kind = F.schema_of_variant(F.try_parse_json(doc))
    out = F.when(kind.startswith("OBJECT"), "OBJECT").when(kind.startswith("ARRAY"), "ARRAY")
    for have, name in TYPES.items():
        out = out.when(kind == have, name)
    return out.when(kind.startswith("DECIMAL"), "DOUBLE").when(kind.isNotNull(), "INTEGER")


def quote(s: Column) -> Column:
    """The text as a JSON string; NULL stays NULL."""
    return F.when(s.isNotNull(), F.regexp_extract(F.to_json(F.array(s.cast("string"))), r"(?s)^\[(.*)\]$", 1))


def array(*parts: Column) -> Column:
    """JSON array of texts and numbers, with ", " between."""
    return F.concat(F.lit("["), F.array_join(F.array(*[_item(p) for p in parts]), ", "), F.lit("]"))


def object_of(**parts: Column) -> Column:
    """JSON object with ", " and ": " between, in the order given."""
    pairs = [F.concat(F.lit(json.dumps(k) + ": "), _item(p)) for k, p in parts.items()]
    return F.concat(F.lit("{"), F.array_join(F.array(*pairs), ", "), F.lit("}"))


def _item(p: Column) -> Column:
    return F.coalesce(quote(p), F.lit("null"))


# --- functions of SQL text, whose paths and values may be columns -----------------------


def _changed(how: str, doc: str | None, path: str | None, value: str | None) -> str | None:
    ok, d = _load(doc)
    if not ok or path is None:
        return None
    steps = path_steps(path)
    if how == "remove":
        found, parent = _find(d, steps[:-1])
        if found and steps:
            last = steps[-1]
            if isinstance(last, str) and isinstance(parent, dict):
                parent.pop(last, None)
            elif isinstance(last, int) and isinstance(parent, list) and last < len(parent):
                parent.pop(last)
        return dump(d)
    return dump(_put(d, steps, parse(value) if value is not None else None, how != "replace", how != "insert"))


def _at(doc: str | None, path: str | None) -> tuple[bool, Any]:
    ok, d = _load(doc)
    return _find(d, path_steps(path)) if ok and path is not None else (False, None)


def _got(doc: str | None, path: str | None) -> str | None:
    found, v = _at(doc, path)
    return dump(v) if found else None


def _length(doc: str | None, path: str | None) -> int | None:
    found, v = _at(doc, path)
    return (len(v) if isinstance(v, (list, dict)) else 1) if found else None


def _keys(doc: str | None, path: str | None) -> str | None:
    found, v = _at(doc, path)
    return dump(list(v)) if found and isinstance(v, dict) else None


def _contained(doc: str | None, candidate: str | None, path: str | None) -> int | None:
    found, v = _at(doc, path)
    ok, c = _load(candidate)
    return int(_within(v, c)) if found and ok else None


def _kind(doc: str | None) -> str | None:
    ok, v = _load(doc)
    if not ok:
        return None
    names = ((type(None), "NULL"), (bool, "BOOLEAN"), (int, "INTEGER"), (float, "DOUBLE"), (str, "STRING"), (list, "ARRAY"), (dict, "OBJECT"))
    return next(name for kind, name in names if isinstance(v, kind))


def register(spark) -> None:
    """Make the functions that SQL text calls known to a session, once."""
    if getattr(spark, "_larkspur_jsons", False):
        return

    def add(name: str, act, kind: str, arity: int) -> None:
        def over(*columns: pd.Series) -> pd.Series:
            return pd.Series([act(*row) for row in zip(*columns)], dtype=object if kind == "string" else "Int64")

        forms = {
            1: lambda a: over(a),
            2: lambda a, b: over(a, b),
            3: lambda a, b, c: over(a, b, c),
        }
        spark.udf.register(name, F.pandas_udf(forms[arity], kind, F.PandasUDFType.SCALAR))

    add("larkspur_json_get", _got, "string", 2)
    add("larkspur_json_length", _length, "long", 2)
    add("larkspur_json_keys", _keys, "string", 2)
    add("larkspur_json_contains", _contained, "long", 3)
    add("larkspur_json_type", _kind, "string", 1)
    for how in ("set", "insert", "replace", "remove"):
        add(f"larkspur_json_{how}", partial(_changed, how), "string", 3)
    spark._larkspur_jsons = True
