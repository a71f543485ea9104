"""Row, segment and key hashes as column expressions.

The row hash keeps apart what plain concatenation confuses: null and the empty string, and values that run
into each other. Each value is written as V, its length, a colon and its text; null as N.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from hashlib import md5

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import column

def holds_map(kind: T.DataType | None) -> bool:
    """Whether values of a type cannot be compared as they are: maps and variants, at any depth."""
    if isinstance(kind, T.ArrayType):
        return holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(holds_map(f.dataType) for f in kind)
    return isinstance(kind, (T.MapType, T.VariantType))


def normal_form(c: Column, kind: T.DataType | None) -> Column:
    """A value without maps and variants: entries of a map in order, a variant as JSON, at any depth."""
    if not holds_map(kind):
        return c
    if isinstance(kind, T.VariantType):
        return F.to_json(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: normal_form(x, kind.elementType))
    if isinstance(kind, T.StructType):
        parts = F.struct(*[normal_form(c.getField(f.name), f.dataType).alias(f.name) for f in kind])
        return F.when(c.isNotNull(), parts)
    entries = F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("key"), normal_form(e["value"], kind.valueType).alias("value")))
    return F.array_sort(entries)


def text_of(c: Column, kind: T.DataType | None = None) -> Column:
    """A value as text: nested values as JSON with map entries in order, -0.0 as 0.0."""
    if isinstance(kind, T.VariantType):
        return F.to_json(c)
    if isinstance(kind, (T.MapType, T.ArrayType, T.StructType)):
        return F.to_json(normal_form(c, kind))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c = F.when(c == 0, F.lit(0.0)).otherwise(c)
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    return c.cast("string")


def encoded(c: Column, kind: T.DataType | None = None) -> Column:
    text = text_of(c, kind)
    return F.coalesce(F.concat(F.lit("V"), F.length(text).cast("string"), F.lit(":"), text), F.lit("N"))


def row_text(columns: Iterable[str], schema: T.StructType | None = None) -> Column:
    """A text that differs for rows that differ."""
    kinds = {f.name: f.dataType for f in schema} if schema is not None else {}
    parts = [encoded(column(c), kinds.get(c)) for c in columns]
    return F.concat(*parts) if parts else F.lit("")


def row_hash(columns: Iterable[str], schema: T.StructType | None = None, width: int = 256) -> Column:
    """Null-safe hash that differs for rows that differ, but for collisions of the digest."""
    text = row_text(columns, schema).cast("binary")
    return F.md5(text) if width == 128 else F.sha2(text, width)


def concat_hash(columns: Iterable[str]) -> Column:
    """MD5 of the bare texts in a row: null if any value is null."""
    return F.md5(F.concat(*[column(c).cast("string") for c in columns]).cast("binary"))


def piped_hash(columns: Iterable[str]) -> Column:
    """MD5 of the texts joined by |, null as the empty text."""
    return F.md5(F.concat_ws("|", *[F.coalesce(column(c).cast("string"), F.lit("")) for c in columns]).cast("binary"))


def short_hash(text: Column) -> Column:
    """The first 15 hexadecimal digits of the MD5 as a long; 16 would not fit."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def key_json(values: Mapping) -> str:
    return json.dumps(dict(values), sort_keys=True, default=str)


def key_hash(values: Mapping) -> str:
    return md5(key_json(values).encode()).hexdigest()


def key_hash_column(keys: Iterable[str]) -> Column:
    """MD5 of the keys as JSON, names in order, nulls kept."""
    parts = F.struct(*[column(k).alias(k) for k in sorted(keys)])
    return F.md5(F.to_json(parts, {"ignoreNullFields": "false"}).cast("binary"))
