"""Stored values by dotted path, always as one flat array; dates, booleans and numbers of query text."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def values(schema: T.StructType, path: str) -> Column | None:
    """array of the non-null values at ``path``, over lists of documents too; None if the schema has no such path."""

    def walk(column: Column, kind: T.DataType, names: list[str]) -> Column | None:
        if isinstance(kind, T.ArrayType):
            probe = walk(F.lit(None), kind.elementType, names)
            if probe is None:
                return None
            return F.flatten(F.transform(F.filter(column, lambda x: x.isNotNull()), lambda x: walk(x, kind.elementType, names)))
        if not names:
            return F.when(column.isNotNull(), F.array(column)).otherwise(F.array().cast(T.ArrayType(kind)))
        if not isinstance(kind, T.StructType) or names[0] not in kind.names:
            return None
        return walk(column.getField(names[0]), kind[names[0]].dataType, names[1:])

    names = path.split(".")
    if names[0] not in schema.names:
        return None
    found = walk(F.col(f"`{names[0]}`"), schema[names[0]].dataType, names[1:])
    return None if found is None else F.filter(F.coalesce(found, F.array()), lambda x: x.isNotNull())


def element_type(schema: T.StructType, path: str) -> T.DataType:
    kind: T.DataType = schema
    for name in path.split("."):
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        kind = kind[name].dataType
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return kind


def extract(schema: T.StructType, path: str) -> Column:
    """The value at a dotted path; over a list the array of its non-null members, null if there are none."""
    names, kind, listed = path.split("."), schema, False
    for name in names:
        while isinstance(kind, T.ArrayType):
            kind, listed = kind.elementType, True
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return F.lit(None).cast("string")
        kind = kind[name].dataType
    found = values(schema, path)
    if listed or isinstance(kind, T.ArrayType):
        return F.when(F.size(found) > 0, found)
    return F.get(found, 0)


def present(schema: T.StructType, path: str) -> Column:
    """Whether the stored value at ``path`` is not null (an empty list is there)."""
    head = path.split(".")[0]
    if values(schema, path) is None:
        return F.lit(False)
    return F.col(f"`{head}`").isNotNull() if "." not in path else F.size(values(schema, path)) > 0


def parse_date(text: str) -> datetime:
    """ISO instant if it has a colon, else a day at 00:00 UTC. Raises ValueError."""
    if ":" in text:
        return datetime.fromisoformat(text.replace("Z", "+00:00")).replace(tzinfo=None)
    d = date.fromisoformat(text)
    return datetime(d.year, d.month, d.day)


def parse_bool(text: str) -> bool:
    return text[:1] in ("t", "T", "1")


def typed(column: Column, kind: str, source: T.DataType) -> Column:
    """An element as its field type's SQL type; text that isn't of the type is an error, as for stored values."""
    if kind == "BOOL" and isinstance(source, T.StringType):
        ok = column.rlike("^[tTfF01]")
        return F.when(ok, column.rlike("^[tT1]")).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), column)).cast("boolean"))
    if kind == "DATE":
        if not isinstance(source, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            raise ValueError("a DATE field needs a timestamp or date column")
        return column.cast("timestamp_ntz")
    target = {"NUMERIC_INT": "int", "NUMERIC_LONG": "bigint", "NUMERIC_FLOAT": "float", "NUMERIC_DOUBLE": "double", "BOOL": "boolean"}.get(kind, "string")
    return column.cast(target)
