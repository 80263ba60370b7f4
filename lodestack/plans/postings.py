"""Searches answered from inverted tables instead of the documents' texts.

Three tables, written once by ``Postings.write``: rows (field, term, id, length, tf, positions), sorted by field and term, so
that a search reads only the row groups of its terms; terms (field, term, doc_freq, term_freq); fields (field, docs, tokens). The
rows are range-partitioned by field, term and id: a term that a third of all documents have spreads over many files.

A query becomes conditions on (field, term) that reach the scan, one aggregate by document, and the match and score over its
columns. The documents are joined only where a query needs their other columns, and then without the text. Ids must be unique.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import parser as P
from .compiler import Compiler, Scored, Statistics
from .config import IndexConfig

ID = "__id"


@dataclass
class Postings:
    """Inverted tables of some index fields."""

    rows: DataFrame
    terms: DataFrame
    fields: DataFrame
    names: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, config: IndexConfig, docs: DataFrame, names: list[str]) -> Postings:
        """Not yet computed; ``write`` them before searching often."""
        plain, uid = Compiler(config, docs), F.col(f"`{config.unique_id}`").alias(ID)
        size = lambda t: F.size(F.filter(t, lambda x: x.isNotNull()))
        tokens = [docs.select(F.lit(n).alias("field"), uid, plain.expression(n).alias("tokens")) for n in names]
        every = reduce(DataFrame.unionByName, tokens).withColumn("length", size("tokens"))
        exploded = every.select("field", ID, "length", F.posexplode("tokens").alias("pos", "term")).where("term is not null")
        # The range partitioning also serves the aggregate, so that tokens are shuffled once.
        placed = exploded.repartitionByRange("field", "term", ID)
        rows = placed.groupBy("field", "term", ID, "length").agg(F.count("*").cast("int").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
        fields = every.groupBy("field").agg(F.count_if(F.col("length") > 0).alias("docs"), F.sum("length").alias("tokens"))
        return cls(rows, cls._terms(rows), fields, list(names))

    @staticmethod
    def _terms(rows: DataFrame) -> DataFrame:
        return rows.groupBy("field", "term").agg(F.count("*").alias("doc_freq"), F.sum("tf").alias("term_freq"))

    def write(self, path: str) -> Postings:
        """Writes the tables below ``path`` and returns them as read from there."""
        spark = self.rows.sparkSession
        self.rows.sortWithinPartitions("field", "term", ID).write.mode("overwrite").parquet(f"{path}/rows")
        self._terms(spark.read.parquet(f"{path}/rows")).repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{path}/terms")
        self.fields.write.mode("overwrite").parquet(f"{path}/fields")
        return self.read(spark, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Postings:
        rows, terms, fields = (spark.read.parquet(f"{path}/{t}") for t in ("rows", "terms", "fields"))
        return cls(rows, terms, fields, sorted(r["field"] for r in fields.select("field").collect()))  # a row per field


class PostingsCompiler(Compiler):
    """Compiles to columns of one aggregate over the postings of the query's terms; other fields are read from the documents."""

    def __init__(self, postings: Postings, *args, **options):
        super().__init__(*args, **options)
        self.postings, self.needs_docs = postings, False

    def _asked(self, key: tuple, value: str, where: Column, select: bool = True) -> Column:
        """The posting's ``value`` under the condition, per document; null where it has none. ``_tokens`` holds what was asked."""
        if key not in self._tokens:
            self._tokens[key] = (f"__asked {len(self._tokens)}", where if select else None, F.max(F.when(where, F.col(value))), value)
        return F.col(f"`{self._tokens[key][0]}`")

    def _covers(self, name: str) -> bool:
        return name in self.postings.names

    def _one(self, kind: str, name: str, term: str) -> Column:
        return self._asked((kind, name, term), kind, (F.col("field") == name) & (F.col("term") == term))

    # What the compiler reads ------------------------------------------------------------------------------------------

    def tokens(self, name: str) -> Column:
        self.needs_docs = True
        return self.expression(name)

    def length(self, name: str) -> Column:
        return self._asked(("length", name), "length", F.col("field") == name, select=False) if self._covers(name) else super().length(name)

    def _freq(self, name: str, term: str) -> Column:
        return F.coalesce(self._one("tf", name, term), F.lit(0)) if self._covers(name) else super()._freq(name, term)

    def _has(self, name: str, terms: list[str]) -> Column:
        if not self._covers(name):
            return super()._has(name, terms)
        return reduce(lambda a, b: a | b, (self._one("tf", name, t).isNotNull() for t in terms))

    def _matching(self, name: str, terms: list[str]) -> Column:
        if not self._covers(name):
            return super()._matching(name, terms)
        key, where = ("matching", name, tuple(terms)), (F.col("field") == name) & F.col("term").isin(*terms)
        if key not in self._tokens:  # a posting for each term that a document has
            self._tokens[key] = (f"__asked {len(self._tokens)}", where, F.count_if(where).cast("int"), "tf")
        return F.coalesce(F.col(f"`{self._tokens[key][0]}`"), F.lit(0))

    def _positions(self, name: str, term: str) -> Column:
        if not self._covers(name):
            return super()._positions(name, term)
        return F.coalesce(self._one("positions", name, term), F.array().cast("array<int>"))

    def _at(self, name: str, position: Column, term: str) -> Column:
        return F.array_contains(self._positions(name, term), position) if self._covers(name) else super()._at(name, position, term)

    def _over_terms(self, name: str, pattern, boost: float) -> Scored:
        if not self._covers(name):
            return super()._over_terms(name, pattern, boost)
        found = self._asked(("pattern", len(self._tokens)), "tf", (F.col("field") == name) & pattern(F.col("term")))
        return self._constant(found.isNotNull(), boost, never_null=True)

    def _exists(self, name: str) -> Column:
        self.needs_docs = True
        return super()._exists(name)

    def _range(self, node: P.Range, name: str, boost: float) -> Scored:
        found = self.config.indexed(name)
        self.needs_docs |= bool(found) and found[0].type != "STRING"
        return super()._range(node, name, boost)

    def term_list(self, name: str) -> DataFrame:
        return self.postings.terms.where(F.col("field") == name).select("term") if self._covers(name) else super().term_list(name)

    def statistics(self, docs: DataFrame, leaves: list | None = None) -> Statistics:
        leaves = self.leaves if leaves is None else leaves
        out = super().statistics(docs, [x for x in leaves if not self._covers(x.name)])
        mine = [x for x in leaves if self._covers(x.name)]
        if not mine:
            return out
        names, wanted = {x.name for x in mine}, {(x.name, t) for x in mine for t in x.terms}
        out.docs |= dict.fromkeys(names, 0)
        out.tokens |= dict.fromkeys(names, 0)
        out.df |= dict.fromkeys(wanted, 0)
        for r in self.postings.fields.where(F.col("field").isin(*names)).collect():  # a row per field
            out.docs[r["field"]], out.tokens[r["field"]] = r["docs"], r["tokens"] or 0
        condition = reduce(lambda a, b: a | b, ((F.col("field") == n) & F.col("term").isin(*(t for m, t in wanted if m == n)) for n in sorted(names)))
        for r in self.postings.terms.where(condition).collect():  # a row per term of the query
            out.df[r["field"], r["term"]] = r["doc_freq"]
        return out

    # Rows -------------------------------------------------------------------------------------------------------------

    def candidates(self) -> DataFrame:
        """A row per document with any of the terms asked for."""
        conditions = [where for _, where, _, _ in self._tokens.values() if where is not None]
        found = self.postings.rows.where(reduce(lambda a, b: a | b, conditions, F.lit(False)))
        return found.groupBy(ID).agg(*(value.alias(name) for name, _, value, _ in self._tokens.values()))

    def with_tokens(self, docs: DataFrame, whole: bool = True) -> DataFrame:
        if not whole:
            return self.candidates().withColumnRenamed(ID, self.config.unique_id)
        if not self._tokens:
            return docs
        # A filter that no document without a term passes makes this an inner join.
        return docs.join(self.candidates(), F.col(f"`{self.config.unique_id}`") == F.col(ID), "left").drop(ID)

    def holds_without_terms(self, match: Column) -> bool:
        """Whether documents match that have no term asked for (all but some, say). One literal row, no job over data."""
        if not self._tokens:
            return True
        kinds = {"positions": "array<int>"}
        none = [F.lit(None).cast(kinds.get(value, "int")).alias(name) for name, _, _, value in self._tokens.values()]
        return bool(self.docs.sparkSession.range(1).select(F.lit(0).alias("__zero"), *none).select(match.alias("m")).first()["m"])
