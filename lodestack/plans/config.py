"""Index settings: which stored fields are indexed, faceted, sorted and projected. JSON round trip without loss."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from ..functions.analysis import Analyzer, built_in

TYPES = ("STRING", "NUMERIC_INT", "NUMERIC_LONG", "NUMERIC_FLOAT", "NUMERIC_DOUBLE", "DATE", "BOOL", "VECTOR")
SQL_TYPES = {"STRING": "string", "NUMERIC_INT": "int", "NUMERIC_LONG": "bigint", "NUMERIC_FLOAT": "float", "NUMERIC_DOUBLE": "double", "DATE": "timestamp", "BOOL": "boolean"}
SORT_HANDLING = ("STANDARD", "LOWERCASE", "FOLDING", "LOWERCASE_FOLDING")
DATE_HANDLING = {"DATE_YYYY_MM_DD": "yyyy-MM-dd", "DATE_YYYYMMDD": "yyyyMMdd"}


class ConfigError(ValueError):
    """Settings or a request that contradict each other."""


@dataclass
class Projection:
    """Sign bits of random directions, for cosine queries."""

    name: str
    input_dim: int = 64
    batches: int = 1
    seed: int = 1357


@dataclass
class FieldConfig:
    stored: str
    type: str = "STRING"
    index_as: dict[str, str] = field(default_factory=dict)  # index name -> analyzer
    facet_as: dict[str, str] = field(default_factory=dict)  # facet name -> date handling
    sort_as: dict[str, str] = field(default_factory=dict)  # sort name -> string handling
    project_as: list[Projection] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.type not in TYPES:
            raise ConfigError(f"{self.stored}: unknown type {self.type}")
        if any(h not in SORT_HANDLING for h in self.sort_as.values()) or any(h not in DATE_HANDLING for h in self.facet_as.values()):
            raise ConfigError(f"{self.stored}: unknown sort or facet handling")
        self.project_as = [Projection(**p) if isinstance(p, dict) else p for p in self.project_as]

    # A small builder, so that a field reads as one line.
    def index(self, analyzer: str = "keyword", name: str | None = None) -> FieldConfig:
        self.index_as[name or self.stored] = analyzer
        return self

    def facet(self, name: str | None = None, handling: str = "DATE_YYYY_MM_DD") -> FieldConfig:
        self.facet_as[name or self.stored] = handling
        self.__post_init__()
        return self

    def sort(self, handling: str = "STANDARD", name: str | None = None) -> FieldConfig:
        self.sort_as[name or self.stored] = handling
        self.__post_init__()
        return self

    def project(self, name: str | None = None, **options: Any) -> FieldConfig:
        self.project_as.append(Projection(name or self.stored, **options))
        return self


@dataclass
class IndexConfig:
    """Names of indexes, facets, sorts and projections are separate name spaces; a name belongs to one field."""

    name: str
    fields: list[FieldConfig] = field(default_factory=list)
    unique_id: str = "unique_id"
    default_search_field: str = ""
    segments: int = 1
    analyzers: dict[str, Analyzer] = field(default_factory=dict)
    store_document_in_index: bool = True
    store_document_externally: bool = False
    apply_uncommitted_deletes: bool = True
    request_factor: float = 2.0
    min_segment_request: int = 2
    idle_time_without_commit: int = 30
    segment_commit_interval: int = 3200
    segment_tolerance: float = 0.05
    query_cache_size: int = 512
    query_cache_max_amount: int = 256
    store_index_on_disk: bool = False

    def __post_init__(self) -> None:
        if self.segments < 1:
            raise ConfigError("an index has at least one segment")
        self.fields = [FieldConfig(**f) if isinstance(f, dict) else f for f in self.fields]
        self.analyzers = {k: Analyzer(**a) if isinstance(a, dict) else a for k, a in self.analyzers.items()}
        for kind in ("index_as", "facet_as", "sort_as"):
            names = [n for f in self.fields for n in getattr(f, kind)]
            if len(names) != len(set(names)):
                raise ConfigError(f"{self.name}: a name in {kind} is used twice")
        for f in self.fields:
            for analyzer in f.index_as.values():
                self.analyzer(analyzer)

    def analyzer(self, name: str) -> Analyzer:
        chains = built_in() | self.analyzers
        if name not in chains:
            raise ConfigError(f"analyzer {name} is not defined")
        return chains[name]

    def indexed(self, name: str) -> tuple[FieldConfig, str] | None:
        return next(((f, f.index_as[name]) for f in self.fields if name in f.index_as), None)

    def facet(self, name: str) -> FieldConfig:
        for f in self.fields:
            if name in f.facet_as:
                return f
        raise ConfigError(f"{name} is not defined as a facetable field")

    def sort(self, name: str) -> FieldConfig:
        for f in self.fields:
            if name in f.sort_as:
                return f
        raise ConfigError(f"Field <{name}> must have sortAs defined to be sortable")

    def projection(self, name: str) -> tuple[FieldConfig, Projection]:
        for f in self.fields:
            for p in f.project_as:
                if p.name == name:
                    return f, p
        raise ConfigError(f"{name} is not defined as a projected field")

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> IndexConfig:
        return cls(**json.loads(text))


def infer_type(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return infer_type(kind.elementType)
    for cls, name in ((T.StringType, "STRING"), (T.LongType, "NUMERIC_LONG"), (T.IntegerType, "NUMERIC_INT"), (T.ShortType, "NUMERIC_INT"), (T.ByteType, "NUMERIC_INT"), (T.FloatType, "NUMERIC_FLOAT"), (T.DoubleType, "NUMERIC_DOUBLE"), (T.BooleanType, "BOOL"), (T.TimestampType, "DATE"), (T.TimestampNTZType, "DATE"), (T.DateType, "DATE")):
        if isinstance(kind, cls):
            return name
    raise ConfigError(f"{kind.simpleString()} is no field type")


def from_schema(name: str, schema: T.StructType, unique_id: str, analyzer: str = "standard", **options: Any) -> IndexConfig:
    """Settings from a DataFrame's schema; metadata ``index``, ``facet``, ``sort`` of a column override the defaults."""
    fields = []
    for f in _leaves(schema):
        path, kind, meta = f
        config = FieldConfig(path, infer_type(kind))
        config.index(meta.get("index", analyzer if config.type == "STRING" else "keyword"))
        if "facet" in meta:
            config.facet(handling=meta["facet"] if isinstance(meta["facet"], str) else "DATE_YYYY_MM_DD")
        if "sort" in meta or config.type != "STRING":
            config.sort(meta.get("sort", "STANDARD"))
        fields.append(config)
    return IndexConfig(name, fields, unique_id=unique_id, **options)


def _leaves(schema: T.StructType, prefix: str = "") -> Iterable[tuple[str, T.DataType, dict]]:
    for f in schema:
        kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        if isinstance(kind, T.StructType):
            yield from _leaves(kind, f"{prefix}{f.name}.")
        else:
            yield prefix + f.name, f.dataType, f.metadata
