"""Dataclasses as documents: settings from field metadata, objects to rows and back.

    @dataclass
    class Article:
        id: str = saved(unique_id=True)
        title: str = saved(index="standard", default_search=True, sort="LOWERCASE")
        authors: list[str] = saved(index={"authors": "standard", "authorsExact": "lcKeyword"}, facet=True)
        scratch: str = saved(keep=False, default="")
"""

from __future__ import annotations

import dataclasses
import typing
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..plans.config import ConfigError, FieldConfig, IndexConfig, infer_type

PLAIN = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), datetime: T.TimestampType(), bytes: T.BinaryType()}


def saved(*, unique_id: bool = False, index: Any = None, facet: Any = None, sort: Any = None, default_search: bool = False, keep: bool = True, name: str | None = None, default: Any = dataclasses.MISSING) -> Any:
    """A dataclass field with its settings; without a default it is None."""
    meta = {"unique_id": unique_id, "index": index, "facet": facet, "sort": sort, "default_search": default_search, "keep": keep, "name": name}
    return dataclasses.field(default=None if default is dataclasses.MISSING else default, metadata=meta)


class Mapper:
    def __init__(self, cls: type):
        if not dataclasses.is_dataclass(cls):
            raise ConfigError(f"{cls.__name__} is no dataclass")
        self.cls = cls
        self.hints = typing.get_type_hints(cls)
        self.fields = [f for f in dataclasses.fields(cls) if f.metadata.get("keep", True)]
        ids = [f for f in self.fields if f.metadata.get("unique_id")]
        if len(ids) > 1:
            raise ConfigError(f"{cls.__name__}: more than one unique id")
        self.id = ids[0] if ids else None
        if self.id and self.hints[self.id.name] is not str:
            raise ConfigError(f"{cls.__name__}: the unique id must be a string")
        if sum(bool(f.metadata.get("default_search")) for f in self.fields) > 1:
            raise ConfigError(f"{cls.__name__}: more than one default search field")

    @staticmethod
    def _name(f: dataclasses.Field) -> str:
        return f.metadata.get("name") or f.name

    def _kind(self, hint: Any) -> T.DataType:
        if typing.get_origin(hint) in (list, set, tuple):
            return T.ArrayType(self._kind(typing.get_args(hint)[0]))
        if dataclasses.is_dataclass(hint):
            return Mapper(hint).schema()
        args = [a for a in typing.get_args(hint) if a is not type(None)]
        if args:
            return self._kind(args[0])
        if hint not in PLAIN:
            raise ConfigError(f"{hint} can't be stored")
        return PLAIN[hint]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(self._name(f), self._kind(self.hints[f.name])) for f in self.fields])

    def _configs(self, prefix: str = "") -> list[FieldConfig]:
        out = []
        for f in self.fields:
            kind, path, m = self._kind(self.hints[f.name]), prefix + self._name(f), f.metadata
            inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
            if isinstance(inner, T.StructType):
                hint = self.hints[f.name]
                out += Mapper(hint if dataclasses.is_dataclass(hint) else next(a for a in typing.get_args(hint) if dataclasses.is_dataclass(a)))._configs(path + ".")
                continue
            if m.get("index") is None and m.get("facet") is None and m.get("sort") is None:
                continue
            config = FieldConfig(path, infer_type(inner))
            index = m.get("index")
            for name, analyzer in (index.items() if isinstance(index, dict) else [(path, "keyword" if index is True else index)] if index else []):
                config.index(analyzer, name)
            if m.get("facet"):
                config.facet(path if m["facet"] is True else m["facet"])
            if m.get("sort"):
                config.sort("STANDARD" if m["sort"] is True else m["sort"], path)
            out.append(config)
        return out

    def config(self, name: str, **options: Any) -> IndexConfig:
        if not self.id:
            raise ConfigError(f"{self.cls.__name__}: no unique id")
        default = next((self._name(f) for f in self.fields if f.metadata.get("default_search")), "")
        return IndexConfig(name, self._configs(), unique_id=self._name(self.id), default_search_field=default, **options)

    def to_dict(self, obj: Any) -> dict[str, Any]:
        plain = lambda v: Mapper(type(v)).to_dict(v) if dataclasses.is_dataclass(v) else [plain(x) for x in v] if isinstance(v, (list, set, tuple)) else v
        return {self._name(f): plain(getattr(obj, f.name)) for f in self.fields}

    def from_dict(self, row: dict[str, Any]) -> Any:
        """A scalar becomes a list of one where a list is expected; several values for a scalar are an error."""
        out = {}
        for f in self.fields:
            value, hint = row.get(self._name(f)), self.hints[f.name]
            listed = typing.get_origin(hint) in (list, set, tuple)
            inner = typing.get_args(hint)[0] if listed else hint
            make = (lambda v, t=inner: Mapper(t).from_dict(v.asDict() if hasattr(v, "asDict") else v)) if dataclasses.is_dataclass(inner) else (lambda v: v)
            if value is None:
                out[f.name] = None
            elif listed:
                out[f.name] = typing.get_origin(hint)(make(v) for v in (value if isinstance(value, (list, set, tuple)) else [value]))
            elif isinstance(value, (list, set, tuple)):
                if len(value) > 1:
                    raise ConfigError(f"{f.name}: several values for one")
                out[f.name] = make(next(iter(value))) if value else None
            else:
                out[f.name] = make(value)
        obj = self.cls.__new__(self.cls)
        for f in dataclasses.fields(self.cls):
            setattr(obj, f.name, out.get(f.name, None if f.default is dataclasses.MISSING else f.default))
        return obj

    def frame(self, spark: SparkSession, objects: list[Any]) -> DataFrame:
        return spark.createDataFrame([self.to_dict(o) for o in objects], self.schema())
