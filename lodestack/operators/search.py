"""Searches: hits, facets, counts, paging, projections of the stored document, several indexes at once."""

from __future__ import annotations

import base64
import json
from collections import OrderedDict
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import partial, reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vector
from ..functions.analysis import fold
from ..functions.values import element_type, extract, typed, values
from ..plans.compiler import Compiler, safe
from ..plans.config import DATE_HANDLING, ConfigError, FieldConfig, IndexConfig
from ..plans.postings import Postings, PostingsCompiler
from .store import DocumentStore, shared_folder


@dataclass
class Index:
    """Stored documents with their settings. ``version`` changes with the settings; the result cache also tells documents apart.

    With ``inverted`` tables, searches of their fields read postings instead of texts. With a ``store``, searches read what the
    store holds when they begin (``current``).
    """

    config: IndexConfig
    docs: DataFrame
    version: int = 0
    inverted: Postings | None = None
    store: DocumentStore | None = None
    seen: str = ""  # state of the store that ``docs`` show

    @classmethod
    def of_store(cls, config: IndexConfig, store: DocumentStore) -> Index:
        return cls(config, store.documents().withColumnRenamed("unique_id", config.unique_id), store=store, seen=store.state())

    def current(self) -> Index:
        """This index, or one over the store's present documents if it has changed; inverted tables then are built anew by hand."""
        if self.store is None or self.store.state() == self.seen:
            return self
        return replace(Index.of_store(self.config, self.store), version=self.version)

    def __post_init__(self) -> None:
        if self.config.unique_id not in self.docs.columns:
            raise ConfigError(f"{self.config.name}: there is no column {self.config.unique_id}")

    @property
    def uid(self) -> Column:
        return F.col(f"`{self.config.unique_id}`").cast("string")

    def shard(self) -> Column:
        return F.pmod(F.hash(self.uid), F.lit(self.config.segments))

    # Facet, sort and text columns ------------------------------------------------------------------------------------

    def facet_values(self, name: str) -> Column:
        """Distinct labels of a document, without empty ones; dates as days in UTC."""
        f = self.config.facet(name)
        found = values(self.docs.schema, f.stored)
        if found is None:
            return F.array().cast("array<string>")
        if f.type == "DATE":
            source = element_type(self.docs.schema, f.stored)
            labels = F.transform(found, lambda v: F.date_format(typed(v, "DATE", source), DATE_HANDLING[f.facet_as[name]]))
        else:
            labels = found.cast("array<string>")
        return F.array_distinct(F.filter(labels, lambda v: v.isNotNull() & (v != "")))

    def sort_value(self, name: str, descending: bool) -> Column:
        """Least value of a document when ascending, greatest when descending; missing numbers and dates count as 0."""
        f = self.config.sort(name)
        source = element_type(self.docs.schema, f.stored)
        found = F.transform(values(self.docs.schema, f.stored), lambda v: typed(v, f.type, source))
        if f.type == "STRING":
            handling = f.sort_as[name]
            if "LOWERCASE" in handling:
                found = F.transform(found, F.lower)
            if "FOLDING" in handling:
                found = F.transform(found, fold)
        best = F.array_max(found) if descending else F.array_min(found)
        if f.type == "DATE":
            return F.coalesce(best, F.lit("1970-01-01").cast("timestamp_ntz"))
        if f.type.startswith("NUMERIC"):
            return F.coalesce(best, F.lit(0).cast(dict(NUMERIC_INT="int", NUMERIC_LONG="bigint", NUMERIC_FLOAT="float", NUMERIC_DOUBLE="double")[f.type]))
        return best

    def field_names(self) -> DataFrame:
        """Index fields that some document has, in order."""
        names = [n for f in self.config.fields for n in f.index_as if values(self.docs.schema, f.stored) is not None]
        if not names:
            return self.docs.sparkSession.createDataFrame([], "field string")
        fields = {n: f for f in self.config.fields for n in f.index_as}
        there = self.docs.agg(*(F.max(F.size(values(self.docs.schema, fields[n].stored)) > 0).alias(f"c{i}") for i, n in enumerate(names)))
        return there.select(F.explode(F.array(*(F.when(F.col(f"c{i}"), F.lit(n)) for i, n in enumerate(names)))).alias("field")).where("field is not null").orderBy("field")

    def doc_counts(self) -> DataFrame:
        """(shard, count); the row with shard null is the total."""
        return self.docs.select(self.shard().alias("shard")).rollup("shard").agg(F.count("*").alias("count"))

    def postings(self, name: str) -> DataFrame:
        """(unique_id, term, tf, positions) of an index field."""
        rows = (self.inverted or Postings.of(self.config, self.docs, [name])).rows.where(F.col("field") == name)
        return rows.select(F.col("__id").cast("string").alias("unique_id"), "term", "tf", "positions")

    def invert(self, path: str, *names: str) -> Index:
        """This index over inverted tables of the fields, all texts if none is named, written below ``path``."""
        every = names or [n for f in self.config.fields if f.type == "STRING" for n in f.index_as]
        return replace(self, inverted=Postings.of(self.config, self.docs, list(every)).write(path))


@dataclass
class CountRequest:
    """Facet counts: ``max_facets`` 0 is all; ``segment_facets`` below it is an error."""

    facet: str
    max_facets: int = 10
    segment_facets: int | None = None

    def __post_init__(self) -> None:
        if self.segment_facets is not None and self.segment_facets < self.max_facets:
            raise ConfigError(f"{self.facet}: segment facets must not be fewer than the facets asked for")


@dataclass
class Query:
    """A search request; every method returns the request, so that it reads as one expression."""

    q: str = ""
    query_fields: dict[str, float] = field(default_factory=dict)
    default_and: bool = False
    mm: int = 0
    dismax: bool = False
    tie: float = 0.0
    amount: int = 10
    start: int = 0
    filters: list[str] = field(default_factory=list)
    scored: list[str] = field(default_factory=list)
    drill_downs: list[tuple[str, str]] = field(default_factory=list)
    counts: list[CountRequest] = field(default_factory=list)
    sorts: list[tuple[str, bool]] = field(default_factory=list)  # name, descending
    cosines: list[tuple[str, list[float], float]] = field(default_factory=list)
    similarity: dict[str, str] = field(default_factory=dict)
    fetch: str = "NONE"  # NONE, META or FULL
    include: list[str] = field(default_factory=list)
    mask: list[str] = field(default_factory=list)
    after: str | None = None  # cursor of the last hit seen
    cache: bool = True

    def fields(self, *names: str) -> Query:
        """Query fields, as ``title`` or ``title^3``."""
        for n in names:
            name, _, boost = n.partition("^")
            try:
                self.query_fields[name] = float(boost or 1)
            except ValueError as e:
                raise ConfigError(f"Invalid queryText field boost: {n}") from e
        return self

    def filter(self, *queries: str) -> Query:
        self.filters += queries
        return self

    def score_also(self, *queries: str) -> Query:
        self.scored += queries
        return self

    def drill(self, facet: str, *labels: str) -> Query:
        self.drill_downs += [(facet, v) for v in labels]
        return self

    def count(self, facet: str, max_facets: int = 10, segment_facets: int | None = None) -> Query:
        self.counts.append(CountRequest(facet, max_facets, segment_facets))
        return self

    def sort(self, name: str, descending: bool = False) -> Query:
        self.sorts.append((name, descending))
        return self

    def cosine(self, projection: str, vector_: Sequence[float], similarity: float) -> Query:
        self.cosines.append((projection, list(vector_), similarity))
        return self

    def similar(self, field_name: str, kind: str) -> Query:
        self.similarity[field_name] = kind
        return self

    def show(self, *names: str) -> Query:
        """Columns of the stored document; ``-name`` leaves one out."""
        self.fetch = "FULL"
        for n in names:
            (self.mask if n.startswith("-") else self.include).append(n.removeprefix("-"))
        return self


class Search:
    """A request compiled over one index."""

    def __init__(self, index: Index, query: Query):
        index = index.current()
        self.index, self.query = index, query
        config, docs = index.config, index.docs
        shared: dict[str, Column] = {}
        kind = Compiler if index.inverted is None else partial(PostingsCompiler, index.inverted)
        build = lambda **o: kind(config, docs, tokens=shared, similarity=query.similarity, **o)
        main = build(query_fields=dict(query.query_fields) or None, default_and=query.default_and, mm=query.mm, dismax=query.dismax, tie=query.tie)
        main._explicit = bool(query.query_fields)
        self.main = main.compile(query.q)
        self.compilers, self.parts, match = [main], [self.main], self.main.match
        for text in query.scored:
            c = build()
            self.parts.append(c.compile(text))
            self.compilers.append(c)
            match = match & self.parts[-1].match
        for text in query.filters:
            c = build()
            match = match & c.compile(text).match
            self.compilers.append(c)
        labels: dict[str, list[str]] = {}
        for facet, label in query.drill_downs:
            labels.setdefault(facet, []).append(label)
        for facet, some in labels.items():
            match = match & F.arrays_overlap(index.facet_values(facet), F.array(*map(F.lit, dict.fromkeys(some))))
        self.extra: list[Column] = []
        for name, asked, similarity in query.cosines:
            f, p = config.projection(name)
            agreeing = vector.agreement(vector.signature_column(F.col(f"`{f.stored}`"), p), vector.signature(asked, p))
            match = match & safe(agreeing >= vector.least_agreement(similarity, p))
            self.extra.append(agreeing.cast("double"))
        self.match = match

    def matches(self) -> DataFrame:
        """All matching documents, whole."""
        return self._frame().select(*(F.col(f"`{c}`") for c in self.index.docs.columns))

    def _frame(self, whole: bool = True) -> DataFrame:
        return self.compilers[0].with_tokens(self.index.docs, whole).where(self.match)

    def _needs_docs(self) -> bool:
        """Whether the matches' ids and scores need more than postings."""
        if self.index.inverted is None or self.query.drill_downs or self.query.cosines or any(c.needs_docs for c in self.compilers):
            return True
        return self.compilers[0].holds_without_terms(self.match)

    def total(self) -> DataFrame:
        return self._frame(self._needs_docs()).agg(F.count("*").alias("total_hits"))

    def score(self) -> Column:
        out = F.lit(0.0)
        for c, part in zip(self.compilers, self.parts, strict=False):
            out = out + part.score(c.statistics(self.index.docs))
        return reduce(lambda a, b: a + b, self.extra, out)

    def order(self) -> list[tuple[str, Column, bool]]:
        """(name, column, descending) of the sort keys."""
        if self.query.sorts:
            return [(f"s{i}", self.index.sort_value(n, d), d) for i, (n, d) in enumerate(self.query.sorts)]
        return [("score", self.score(), True)]

    def ranked(self) -> DataFrame:
        """Matching documents with unique_id, score, sort keys and the fetched document; unordered."""
        keys, q = self.order(), self.query
        score = next((c for n, c, _ in keys if n == "score"), F.lit(None).cast("double"))
        columns = [self.index.uid.alias("unique_id"), F.lit(self.index.config.name).alias("index_name"), score.alias("score")]
        columns += [c.alias(n) for n, c, _ in keys if n != "score"]
        if q.fetch == "FULL":
            columns.append(self._document().alias("document"))
        return self._frame(bool(q.sorts) or q.fetch == "FULL" or self._needs_docs()).select(*columns)

    def _document(self) -> Column:
        names = [c for c in self.index.docs.columns if (not self.query.include or c in self.query.include) and c not in self.query.mask]
        return F.struct(*(F.col(f"`{n}`") for n in names))

    def facets(self) -> DataFrame:
        """(facet, value, count, max_error, possible_missing, max_value_possible_missing), best first within a facet.

        One pass over the matches counts all facets: labels are exploded with their facet's name and combined before the shuffle.
        Counts are exact, so no error is possible and nothing can be missing.
        """
        requests = self.query.counts
        if not requests:
            raise ConfigError("the request counts no facet")
        for r in requests:
            self.index.config.facet(r.facet)
        named = lambda name: F.transform(self.index.facet_values(name), lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value")))
        labels = F.concat(*map(named, dict.fromkeys(r.facet for r in requests)))
        found = self.matches().select(F.explode(labels).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("count"))
        return cut_facets(found.withColumn("max_error", F.lit(0).cast("long")), requests)


def cut_facets(counted: DataFrame, requests: list[CountRequest]) -> DataFrame:
    """The best values of each facet, as many as asked for (0: all)."""
    from pyspark.sql import Window

    limits = {r.facet: r.max_facets for r in requests}
    if len(limits) == 1:  # a top-k of each partition
        limit = next(iter(limits.values()))
        counted = counted.orderBy(F.desc("count"), "value")
        counted = counted.limit(limit) if limit else counted
    else:
        counted = counted.withColumn("__place", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("count"), "value")))
        if all(limits.values()):  # cut before the shuffle already
            counted = counted.where(F.col("__place") <= max(limits.values()))
        asked = F.create_map(*(F.lit(x) for name, limit in limits.items() for x in (name, limit or 2**31 - 1)))
        counted = counted.where(F.col("__place") <= F.element_at(asked, F.col("facet"))).drop("__place")
    return counted.select("facet", "value", "count", "max_error", F.lit(False).alias("possible_missing"), F.lit(0).cast("long").alias("max_value_possible_missing"))


def near_documents(index: Index, name: str, asked: Column, least: float = 0.8) -> DataFrame:
    """(query_id, unique_id, likeness): of each document that ``asked`` holds for, all documents that share at least ``least`` of its tokens.

    For fields of tokens without repeats (MinHash). The same as a query of the document's tokens with mm, for many documents at once,
    from the postings. Documents with the same tokens are one class, so copies share no tokens twice and only classes are joined;
    a class's likeness holds for all its members.
    """
    spark, uid, inverted = index.docs.sparkSession, index.uid.alias("unique_id"), index.inverted and name in index.inverted.names
    array = F.array_sort(F.array_compact(Compiler(index.config, index.docs).expression(name)))

    def tokens(ids: DataFrame) -> DataFrame:
        """The tokens of the documents named in ``ids`` (unique_id, class); texts are analyzed after the others have gone."""
        if inverted:
            return index.postings(name).join(ids, "unique_id").select("class", "term")
        return index.docs.join(ids, index.uid == F.col("unique_id")).select("class", F.explode(array).alias("term"))

    if inverted:  # a document's tokens as one hash, whatever their order; combined before the shuffle
        classes = index.postings(name).groupBy("unique_id").agg(F.count("*").alias("size"), F.sum(F.xxhash64("term").cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "term")).alias("b"))
    else:
        classes = index.docs.select(uid, array.alias("t")).select("unique_id", F.size("t").cast("long").alias("size"), F.xxhash64("t").alias("a"), F.xxhash64(F.lit(1), "t").alias("b")).where("size > 0")
    shared_folder(spark)
    classes = classes.select("unique_id", "size", F.xxhash64("size", "a", "b").alias("class")).checkpoint()  # a short row a document
    first = classes.groupBy("class").agg(F.min("unique_id").alias("unique_id"), F.first("size").alias("size"))
    wanted = index.docs.where(asked).select(uid).join(classes, "unique_id").select(F.col("unique_id").alias("query_id"), "class", "size")
    posed = tokens(first.join(wanted.select("class"), "class", "left_semi")).join(first.select("class", "size"), "class").select(F.col("class").alias("posed"), "size", "term")
    shared = tokens(first).join(posed, "term").groupBy("posed", "class").agg((F.count("*") / F.first("size")).alias("likeness")).where(F.col("likeness") >= least)
    found = wanted.select("query_id", F.col("class").alias("posed")).join(shared, "posed")
    return found.join(classes.select("class", "unique_id"), "class").select("query_id", "unique_id", "likeness")


def _after(query: Query, keys: list[tuple[str, bool]], schema: T.StructType) -> Column:
    """Rows behind the cursor, in the order of the keys and then of unique_id."""
    seen = json.loads(base64.b64decode(query.after))
    if len(seen) != len(keys) + 1:
        raise ConfigError("the cursor does not fit the sort")
    lits = [F.lit(v).cast(schema[n].dataType) for v, (n, _) in zip(seen, keys, strict=False)]
    out = F.col("unique_id") > seen[-1]
    for (name, descending), lit, v in reversed(list(zip(keys, lits, seen, strict=False))):
        col = F.col(name)
        if v is None:  # nulls come first ascending, last descending
            beyond = F.lit(False) if descending else col.isNotNull()
            out = beyond | (col.isNull() & out)
        else:
            beyond = (col < lit) | col.isNull() if descending else safe(col > lit)
            out = beyond | (safe(col == lit) & out)
    return out


def hits(indexes: Index | Sequence[Index], query: Query) -> DataFrame:
    """rank, unique_id, index_name, score, sort keys, document of the asked page, best first.

    The order is total (ties end at the id), so a page is a top-k of each partition, merged; a cursor is a range of keys.
    """
    indexes = [i.current() for i in ([indexes] if isinstance(indexes, Index) else indexes)]
    kinds = {tuple(i.config.sort(n).type for n, _ in query.sorts) for i in indexes}
    if len(kinds) > 1:
        raise ConfigError("a sort field has different types in the indexes")
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [Search(i, query).ranked() for i in indexes])
    keys = [(f"s{i}", d) for i, (_, d) in enumerate(query.sorts)] or [("score", True)]
    if query.after and query.after != "0":
        found = found.where(_after(query, keys, found.schema))
    if not query.amount:  # facets and totals only: no score, no sort, no scan
        return found.limit(0).withColumn("rank", F.lit(0))
    order = [F.col(n).desc_nulls_last() if d else F.col(n).asc_nulls_first() for n, d in keys] + [F.col("unique_id").asc(), F.col("index_name").asc()]
    page = found.orderBy(*order).limit(query.start + query.amount)
    page = page.offset(query.start) if query.start else page
    ranks = F.row_number().over(_window(order))
    return page.withColumn("rank", (ranks + query.start).cast("int"))


def hits_with_next(indexes: Index | Sequence[Index], query: Query) -> DataFrame:
    """``hits`` with has_more: whether another hit follows the page. One hit more is taken to know, none is scored twice."""
    page = hits(indexes, replace(query, amount=query.amount + 1))
    last = query.start + query.amount
    from pyspark.sql import Window

    more = F.max("rank").over(Window.partitionBy(F.lit(0))) > last  # over one page only
    return page.withColumn("has_more", more).where(F.col("rank") <= last)


def _window(order: list[Column]):
    from pyspark.sql import Window

    return Window.orderBy(*order)  # over one page only


def cursor(row: Any, query: Query) -> str:
    """Cursor behind a hit of ``hits``; it holds no score if the request sorts by fields, so it outlives changes of the index."""
    keys = [f"s{i}" for i in range(len(query.sorts))] or ["score"]
    plain = [v if isinstance(v := row[k], (int, float, bool, type(None))) else str(v) for k in keys]
    return base64.b64encode(json.dumps([*plain, row["unique_id"]]).encode()).decode()


def search_facets(indexes: Index | Sequence[Index], query: Query) -> DataFrame:
    """Facet counts summed over indexes, cut to each request's number."""
    indexes = [i.current() for i in ([indexes] if isinstance(indexes, Index) else indexes)]
    if len(indexes) == 1:
        return Search(indexes[0], query).facets()
    every = replace(query, counts=[CountRequest(r.facet, 0) for r in query.counts])
    summed = reduce(DataFrame.unionByName, [Search(i, every).facets() for i in indexes]).groupBy("facet", "value").agg(F.sum("count").alias("count"), F.sum("max_error").alias("max_error"))
    return cut_facets(summed, query.counts)


class ResultCache:
    """Results of small requests, by request, settings and documents; the oldest go first.

    Documents are told apart by their plan, and those of a store by the store's state, so a change is never answered from before.
    """

    def __init__(self, size: int = 512, most: int = 256):
        self.size, self.most, self.kept = size, most, OrderedDict()

    def get(self, index: Index, query: Query) -> list:
        index = index.current()
        key = (index.config.to_json(), index.version, index.seen, index.docs.semanticHash(), json.dumps(query.__dict__, default=lambda o: o.__dict__, sort_keys=True))
        if not query.cache or query.amount > self.most:
            return hits(index, query).collect()
        if key not in self.kept:
            self.kept[key] = hits(index, query).collect()  # a page of at most ``most`` rows
            while len(self.kept) > self.size:
                self.kept.popitem(last=False)
        self.kept.move_to_end(key)
        return self.kept[key]


class Catalog:
    """Named indexes of a session: create, update, list, delete; each is a temporary view too, for plain SQL."""

    def __init__(self, spark: SparkSession):
        self.spark, self.indexes = spark, {}

    def create(self, config: IndexConfig, docs: DataFrame, invert: str | None = None) -> Index:
        """``invert``: a shared folder in which inverted tables of the text fields are written, which all searches then use."""
        if config.name in self.indexes:
            raise ConfigError(f"index {config.name} exists already")
        index = Index(config, docs)
        self.indexes[config.name] = index.invert(f"{invert.rstrip('/')}/{config.name}") if invert else index
        docs.createOrReplaceTempView(config.name)
        return self.indexes[config.name]

    def update(self, config: IndexConfig) -> Index:
        index = self.get(config.name)
        if config.segments != index.config.segments:
            raise ConfigError("the number of segments can't change")
        index.config, index.version = config, index.version + 1
        return index

    def create_or_update(self, config: IndexConfig, docs: DataFrame) -> Index:
        return self.update(config) if config.name in self.indexes else self.create(config, docs)

    def get(self, name: str) -> Index:
        if name not in self.indexes:
            raise ConfigError(f"index {name} does not exist")
        return self.indexes[name]

    def delete(self, name: str) -> None:
        self.get(name)
        del self.indexes[name]
        self.spark.catalog.dropTempView(name)

    def listing(self) -> DataFrame:
        return self.spark.createDataFrame([(n, i.config.to_json()) for n, i in sorted(self.indexes.items())], "index_name string, settings string")

    def members(self) -> DataFrame:
        """Executors of the session; for information only."""
        status = self.spark.sparkContext._jsc.sc().getExecutorMemoryStatus().keySet().mkString(",")
        return self.spark.createDataFrame([(x,) for x in status.split(",") if x], "member string")


def or_query(field_name: str, terms: Sequence[str]) -> str:
    """``field:(a OR b)`` with the terms quoted."""
    return f"{field_name}:(" + " OR ".join('"' + t.replace("\\", "\\\\").replace('"', '\\"') + '"' for t in terms) + ")"


def dotted(docs: DataFrame, path: str) -> Column:
    return extract(docs.schema, path)


__all__ = ["Catalog", "CountRequest", "FieldConfig", "Index", "IndexConfig", "Query", "ResultCache", "Search", "cursor", "dotted", "hits", "hits_with_next", "near_documents", "or_query", "search_facets"]
