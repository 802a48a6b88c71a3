"""Nested values: leaves by path, allow-lists, deep merges and differences, generated from the schema.

Expressions follow the struct type at planning time; arrays are walked by
higher-order functions, so no row leaves its place.
"""

from __future__ import annotations

import difflib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

# Keys that the server sets.
SERVER_KEYS = ("id", "createdAt", "updatedAt")
LEAF = "array<struct<path:string,value:string>>"


def leaves(c: Column, kind: DataType, prefix: Column | None = None, skip: tuple[str, ...] = SERVER_KEYS) -> Column:
    """All leaves of a value as (path, text), server-managed ones left out; array items are numbered by position."""
    if isinstance(kind, StructType):
        parts = [leaves(c[f.name], f.dataType, F.lit(f.name) if prefix is None else F.concat(prefix, F.lit(f".{f.name}")), skip) for f in kind if f.name not in skip]
        return F.concat(*parts) if parts else F.array().cast(LEAF)
    path = F.lit("") if prefix is None else prefix
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType | ArrayType):
        each = F.transform(c, lambda x, k: leaves(x, kind.elementType, F.concat(path, F.lit("["), k.cast("string"), F.lit("]")), skip))
        return F.coalesce(F.flatten(each), F.array().cast(LEAF))
    text = F.to_json(c) if isinstance(kind, ArrayType) else c.cast("string")
    return F.when(c.isNotNull(), F.array(F.struct(path.alias("path"), text.alias("value")))).otherwise(F.array().cast(LEAF))


def differences(before: Column, after: Column, kind: DataType) -> Column:
    """(field, before, after) of every leaf that differs, in order of path."""
    a, b = F.map_from_entries(leaves(before, kind)), F.map_from_entries(leaves(after, kind))
    paths = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    each = F.transform(paths, lambda p: F.struct(p.alias("field"), F.try_element_at(a, p).alias("before"), F.try_element_at(b, p).alias("after")))
    return F.filter(each, lambda d: ~d["before"].eqNullSafe(d["after"]))


def without_keys(c: Column, kind: DataType, keys: tuple[str, ...] = SERVER_KEYS) -> Column:
    """The value without the named keys, at every depth."""
    if isinstance(kind, StructType):
        rest = [without_keys(c[f.name], f.dataType, keys).alias(f.name) for f in kind if f.name not in keys]
        return F.when(c.isNotNull(), F.struct(*rest))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType | ArrayType):
        return F.transform(c, lambda x: without_keys(x, kind.elementType, keys))
    return c


def allowed(c: Column, kind: StructType, keys: list[str]) -> Column:
    """The struct's allowed fields, in its order."""
    return F.when(c.isNotNull(), F.struct(*[c[f.name].alias(f.name) for f in kind if f.name in keys]))


def deep_merge(current: Column, submitted: Column, kind: DataType, fallbacks: tuple[str, ...] = (), clears: tuple[str, ...] = (), path: str = "") -> Column:
    """Leaf by leaf: what is submitted wins over what is live, a fallback path yields to it, a cleared path is null. Arrays are leaves."""
    if path in clears:
        return F.lit(None).cast(kind)
    if isinstance(kind, StructType):
        fields = [deep_merge(current[f.name], submitted[f.name], f.dataType, fallbacks, clears, f"{path}.{f.name}" if path else f.name).alias(f.name) for f in kind]
        return F.when(current.isNotNull() | submitted.isNotNull(), F.struct(*fields))
    return F.coalesce(current, submitted) if path in fallbacks else F.coalesce(submitted, current)


def keyed(items: Column, key: Column, index: str = "index") -> Column:
    """The item of an array whose index field has the value, wherever it stands; null if none has."""
    return F.get(F.filter(items, lambda x: x[index] == key), F.lit(0))


def with_keyed(items: Column, key: Column, field: str, value: Column, index: str = "index") -> Column:
    """items with a field of the item of that index replaced."""
    return F.transform(items, lambda x: F.when(x[index] == key, x.withField(field, value)).otherwise(x))


def cell_text(c: Column, kind: DataType) -> Column:
    """A value as a sheet shows it: nothing for null, Yes and No, lists joined, structures as JSON."""
    if isinstance(kind, StructType) or isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType | ArrayType):
        return F.coalesce(F.to_json(c), F.lit(""))
    if isinstance(kind, ArrayType):
        return F.coalesce(F.array_join(c.cast("array<string>"), "; "), F.lit(""))
    if kind.typeName() == "boolean":
        return F.when(c, "Yes").when(~c, "No").otherwise("")
    return F.coalesce(c.cast("string"), F.lit(""))


def business_key(value: Column, index: Column) -> Column:
    """The key by which items of two sides meet; without a type it is a place that no other item has."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.concat(F.lit("untyped-"), index.cast("string")))


@F.pandas_udf(StringType())
def word_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """Words of two texts as runs of kind same, removed or added, in JSON."""

    def runs(x: str | None, y: str | None) -> list[dict[str, str]]:
        u, v = (x or "").split(), (y or "").split()
        out = []
        for op, i, j, k, m in difflib.SequenceMatcher(None, u, v, autojunk=False).get_opcodes():
            if op == "equal":
                out.append({"kind": "same", "text": " ".join(u[i:j])})
                continue
            out += [{"kind": n, "text": " ".join(w)} for n, w in (("removed", u[i:j]), ("added", v[k:m])) if w]
        return out

    return pd.Series([json.dumps(runs(x, y), ensure_ascii=False) for x, y in zip(a, b, strict=True)])
