"""A parsed query over an index to two columns: whether a document matches, and its score.

Matching and scoring are expressions over the fields' token arrays, so a search is one scan that filters, scores and keeps the
top; nothing is shuffled but the hits. What scoring needs of the collection (documents with the field, mean length, document
frequency of the query's terms) comes from one aggregate over the same scan, a single row whatever the collection's size.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.minhash import bound
from ..functions.values import element_type, parse_bool, parse_date, present, typed, values
from . import parser as P
from .config import ConfigError, FieldConfig, IndexConfig

K1, B = 1.2, 0.75
FUZZY_EXPANSIONS = 50
#: Terms of one field that weigh alike beyond which they are counted at once.
MANY = 8
NUMERIC = ("NUMERIC_INT", "NUMERIC_LONG", "NUMERIC_FLOAT", "NUMERIC_DOUBLE")


@dataclass
class Leaf:
    """One scored term or phrase of a field."""

    name: str
    freq: Column
    match: Column
    terms: list[str]
    boost: float


@dataclass
class Scored:
    match: Column
    parts: list = field(default_factory=list)  # score columns, made when statistics are known

    def score(self, stats: Statistics) -> Column:
        return balanced(operator.add, [F.lit(0.0), *(make(stats) for make in self.parts)])


@dataclass
class Statistics:
    """Per index field: documents that have it and tokens in all; per (field, term): document frequency."""

    docs: dict[str, int]
    tokens: dict[str, int]
    df: dict[tuple[str, str], int]


def balanced(op: Callable[[Column, Column], Column], parts: list[Column]) -> Column:
    """The parts joined pair by pair, so that hundreds of terms make a tree of few levels."""
    while len(parts) > 1:
        parts = [op(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def safe(match: Column) -> Column:
    """A predicate on a missing value is false, also under NOT."""
    return F.coalesce(match, F.lit(False))


def similarity_score(kind: str, freq: Column, length: Column, found: list[int], docs: int, tokens: int) -> Column:
    """Score of a term or phrase, whose terms are in ``found`` documents each; 0 for documents without it."""
    if kind == "TF":
        one = freq.cast("double")
    elif kind == "CONSTANT":
        one = F.lit(1.0)
    elif kind == "TFIDF":  # the idf counts once
        one = F.sqrt(freq.cast("double")) * float(sum(1.0 + math.log((docs + 1) / (df + 1)) for df in found)) / F.sqrt(length.cast("double"))
    else:
        idf = sum(math.log(1 + (docs - df + 0.5) / (df + 0.5)) for df in found)
        one = F.lit(float(idf)) * (freq * (K1 + 1)) / (freq + K1 * (1 - B + B * length / F.lit(tokens / docs if tokens else 1.0)))
    return F.when(freq > 0, one).otherwise(F.lit(0.0))


class Compiler:
    """Compiles for one index over ``docs``, whose columns are the stored fields."""

    def __init__(self, config: IndexConfig, docs: DataFrame, query_fields: dict[str, float] | None = None, default_and: bool = False, mm: int = 0, dismax: bool = False, tie: float = 0.0, similarity: dict[str, str] | None = None, tokens: dict[str, Column] | None = None):
        self.config, self.docs, self.schema = config, docs, docs.schema
        default = [config.default_search_field] if config.default_search_field else []
        self.fields = query_fields or dict.fromkeys(default, 1.0)
        self.default_and, self.mm, self.dismax, self.tie = default_and, mm, dismax, tie
        self.similarity = similarity or {}
        self.leaves: list[Leaf] = []
        self._tokens = {} if tokens is None else tokens
        self.shown: dict[str, list[P.Node]] = {}  # query terms by index field, for highlighting

    # Fields -----------------------------------------------------------------------------------------------------------

    def expression(self, name: str) -> Column:
        """Token array of an index field (nulls are gaps); empty if the field is not indexed."""
        found = self.config.indexed(name)
        elements = values(self.schema, found[0].stored) if found else None
        if elements is None:
            return F.array().cast("array<string>")
        f, analyzer = found
        if f.type == "BOOL":
            source = element_type(self.schema, f.stored)
            return F.transform(elements, lambda v: F.when(typed(v, "BOOL", source), "T").otherwise("F"))
        return self.config.analyzer(analyzer).column(elements.cast("array<string>"))

    def tokens(self, name: str) -> Column:
        """The field's token array as a column of ``with_tokens``, so that a text is analyzed once however often it is used."""
        if name not in self._tokens:
            self._tokens[name] = self.expression(name)
        return F.col(f"`__tokens {name}`")

    def with_tokens(self, docs: DataFrame, whole: bool = True) -> DataFrame:
        return docs.withColumns({f"__tokens {name}": tokens for name, tokens in self._tokens.items()}) if self._tokens else docs

    def length(self, name: str) -> Column:
        return F.size(F.filter(self.tokens(name), lambda t: t.isNotNull()))

    def _typed(self, f: FieldConfig) -> Column:
        source = element_type(self.schema, f.stored)
        return F.transform(values(self.schema, f.stored), lambda v: typed(v, f.type, source))

    def similarity_of(self, name: str) -> str:
        if name in self.similarity:
            return self.similarity[name]
        if "*" in self.similarity:
            return self.similarity["*"]
        found = self.config.indexed(name)
        return self.config.analyzer(found[1]).similarity if found else "BM25"

    # Nodes ------------------------------------------------------------------------------------------------------------

    def compile(self, query: str, scored: bool = True) -> Scored:
        if not query.strip():
            return self._any_field() if self.fields and query == "" and self._explicit else Scored(F.lit(True), [lambda _: F.lit(1.0)])
        node = P.parse(query, self.default_and, self.mm)
        out = self._bool(node, node.boost, top=True) if isinstance(node, P.Bool) else self.node(node, 1.0)
        if out is None:
            return Scored(F.lit(False))  # every clause is without terms
        return out if scored else Scored(out.match)

    _explicit = False

    def _any_field(self) -> Scored:
        match = F.lit(False)
        for name in self.fields:
            match = match | self._exists(name)
        return Scored(match, [lambda _: F.lit(1.0)])

    def node(self, node: P.Node, boost: float) -> Scored | None:
        """None: the analyzer leaves no term of the clause (stop words, say), so the query is as if it were not there."""
        boost *= node.boost
        if isinstance(node, P.MatchAll):
            return Scored(F.lit(True), [lambda _: F.lit(boost)])
        if isinstance(node, P.Bool):
            return self._bool(node, boost)
        names = {node.field: 1.0} if node.field is not None else self.fields
        if not names:
            raise ConfigError("the query names no field and the index has no default search field")
        for name in names:
            self.shown.setdefault(name, []).append(node)
        if isinstance(node, P.Text):
            return self._text(node, names, boost)
        make = {P.Phrase: self._phrase, P.Prefix: self._prefix, P.Wildcard: self._wildcard, P.Regex: self._regex, P.Fuzzy: self._fuzzy, P.Range: self._range, P.Exists: lambda n, name, b: self._constant(self._exists(name), b)}[type(node)]
        return self._fields([make(node, name, boost * b) for name, b in names.items()])

    def _constant(self, match: Column, boost: float, never_null: bool = False) -> Scored:
        match = match if never_null else safe(match)
        return Scored(match, [lambda _: F.when(match, F.lit(float(boost))).otherwise(F.lit(0.0))])

    def _fields(self, parts: list[Scored | None]) -> Scored | None:
        """Any of the fields; scores add up, or the best counts under dismax."""
        parts = [p for p in parts if p is not None]
        if len(parts) < 2:
            return parts[0] if parts else None
        match = parts[0].match
        for p in parts[1:]:
            match = match | p.match
        if not self.dismax:
            return Scored(match, [m for p in parts for m in p.parts])

        def best(stats: Statistics) -> Column:
            scores = [p.score(stats) for p in parts]
            top, total = F.greatest(*scores), sum(scores[1:], scores[0])
            return top + F.lit(float(self.tie)) * (total - top)

        return Scored(match, [best])

    def _bool(self, node: P.Bool, boost: float, top: bool = False) -> Scored | None:
        """``top``: the whole query, which takes from all documents if only prohibitions are left."""
        clauses = [(occur, c) for occur, n in node.clauses if (c := self.node(n, boost)) is not None]
        if not clauses:
            return None
        if top and all(occur == P.MUST_NOT for occur, _ in clauses):
            clauses.insert(0, (P.MUST, self.node(P.MatchAll(), boost)))
        must, should, never = ([c for o, c in clauses if o == kind] for kind in (P.MUST, P.SHOULD, P.MUST_NOT))
        match = balanced(operator.and_, [F.lit(True), *(c.match for c in must), *(~c.match for c in never)])
        several = len(node.clauses) > 1  # as written, also where a clause went
        needed = max(node.mm, 0 if must else 1) if several or never else 0
        if should or node.mm and several:
            if needed == 1 and should:
                match = match & balanced(operator.or_, [c.match for c in should])
            elif needed:
                match = match & (balanced(operator.add, [F.lit(0), *(c.match.cast("int") for c in should)]) >= needed)
        elif not must:
            match = F.lit(False)
        parts = [lambda stats, c=c: F.when(c.match, c.score(stats)).otherwise(F.lit(0.0)) for c in must + should if c.parts]
        return Scored(match, parts)

    def _text(self, node: P.Text, names: dict[str, float], boost: float) -> Scored | None:
        """Each field's own tokens; the i-th of every field is one group, groups combine by the default operator."""
        per_field: list[tuple[str, float, list[str] | None]] = []
        for name, b in names.items():
            f = self.config.indexed(name)
            if f and f[0].type in (*NUMERIC, "DATE", "BOOL"):
                per_field.append((name, b, None))
            else:
                analyzer = self.config.analyzer(f[1] if f else "keyword")
                per_field.append((name, b, [t for t in analyzer.tokens(node.text) if t is not None]))
        if len(per_field) == 1 and per_field[0][2] and len(set(per_field[0][2])) == len(per_field[0][2]) > MANY and self.similarity_of(per_field[0][0]) == "CONSTANT":
            # Many terms that weigh alike (MinHash tokens, say): how many a document has is all that counts.
            name, b, tokens = per_field[0]
            found = self._matching(name, tokens)
            match = found >= (len(tokens) if self.default_and else max(1, self.mm))
            return Scored(match, [lambda _: F.when(match, found * F.lit(float(boost * b))).otherwise(F.lit(0.0))])
        groups: list[Scored] = []
        for i in range(max([len(t) if t is not None else 1 for _, _, t in per_field], default=0)):
            parts = []
            for name, b, tokens in per_field:
                if tokens is None:
                    if i == 0:
                        parts.append(self._exact(name, node.text, boost * b))
                elif i < len(tokens):
                    parts.append(self._term(name, tokens[i], boost * b))
            groups.append(self._fields(parts))
        if not groups:
            return None
        if len(groups) == 1:
            return groups[0]
        multi = len(names) > 1
        if self.default_and:
            match = balanced(operator.and_, [g.match for g in groups])
        else:
            needed = max(1, 0 if multi else self.mm)
            match = balanced(operator.add, [g.match.cast("int") for g in groups]) >= needed
        return Scored(match, [m for g in groups for m in g.parts])

    def _term(self, name: str, term: str, boost: float) -> Scored:
        return self._leaf(Leaf(name, self._freq(name, term), self._has(name, [term]), [term], boost))

    def _freq(self, name: str, term: str) -> Column:
        return F.size(F.filter(self.tokens(name), lambda t: t == term))

    def _has(self, name: str, terms: list[str]) -> Column:
        """Whether the field has any of the terms."""
        if len(terms) == 1:
            return safe(F.array_contains(self.tokens(name), terms[0]))
        return safe(F.arrays_overlap(self.tokens(name), F.array(*map(F.lit, terms))))

    def _matching(self, name: str, terms: list[str]) -> Column:
        """How many of the terms, all different, the field has."""
        return F.coalesce(F.size(F.array_intersect(self.tokens(name), F.array(*map(F.lit, terms)))), F.lit(0))

    def _positions(self, name: str, term: str) -> Column:
        return F.filter(F.transform(self.tokens(name), lambda x, i: F.when(x == term, i)), lambda i: i.isNotNull())

    def _at(self, name: str, position: Column, term: str) -> Column:
        return F.get(self.tokens(name), position) == term

    def _leaf(self, leaf: Leaf) -> Scored:
        self.leaves.append(leaf)

        def score(stats: Statistics) -> Column:
            found = [stats.df[leaf.name, t] for t in leaf.terms]
            one = similarity_score(self.similarity_of(leaf.name), leaf.freq, self.length(leaf.name), found, stats.docs[leaf.name], stats.tokens[leaf.name])
            return one * F.lit(float(leaf.boost))

        return Scored(leaf.match, [score])

    def _phrase(self, node: P.Phrase, name: str, boost: float) -> Scored | None:
        f = self.config.indexed(name)
        if f and f[0].type in (*NUMERIC, "DATE", "BOOL"):
            return self._exact(name, node.text, boost)
        tokens = self.config.analyzer(f[1] if f else "keyword").tokens(node.text)
        wanted = [(i, t) for i, t in enumerate(tokens) if t is not None]
        if not wanted:
            return None
        if len(wanted) == 1:
            return self._term(name, wanted[0][1], boost)
        first, at = wanted[0][0], lambda t: self._positions(name, t)
        if node.slop == 0:
            hits = F.filter(at(wanted[0][1]), lambda p: _all(self._at(name, p + (i - first), t) for i, t in wanted[1:]))
        else:
            # Sloppy: the positions, less their places in the phrase, lie within the slop of each other.
            places = F.array(*(_less(at(t), i) for i, t in wanted))
            near = lambda ps, lo: _all(F.exists(F.get(ps, k), lambda p: (p >= lo) & (p <= lo + node.slop)) for k in range(len(wanted)))
            hits = bound(places, lambda ps: F.filter(F.array_distinct(F.flatten(ps)), lambda lo: near(ps, lo)))
        return self._leaf(Leaf(name, F.size(hits), safe(F.size(hits) > 0), [t for _, t in wanted], boost))

    def _over_terms(self, name: str, pattern, boost: float) -> Scored:
        return self._constant(F.exists(self.tokens(name), lambda t: F.coalesce(pattern(t), F.lit(False))), boost)

    def _normal(self, name: str, text: str) -> str:
        f = self.config.indexed(name)
        return self.config.analyzer(f[1]).normalize(text) if f else text

    def _prefix(self, node: P.Prefix, name: str, boost: float) -> Scored:
        text = self._normal(name, node.text)
        return self._over_terms(name, lambda t: t.startswith(text), boost)

    def _wildcard(self, node: P.Wildcard, name: str, boost: float) -> Scored:
        pattern = wildcard_regex(self._normal(name, node.text))
        return self._over_terms(name, lambda t: t.rlike(pattern), boost)

    def _regex(self, node: P.Regex, name: str, boost: float) -> Scored:
        pattern = f"^(?:{node.text})$"
        return self._over_terms(name, lambda t: t.rlike(pattern), boost)

    def _fuzzy(self, node: P.Fuzzy, name: str, boost: float) -> Scored:
        text = self._normal(name, node.text)
        found = fuzzy_terms(self.term_list(name), text, node.edits).orderBy("distance", "term").limit(FUZZY_EXPANSIONS).collect()
        if not found:
            return Scored(F.lit(False))
        match = self._has(name, [r["term"] for r in found])
        weights = [(r["term"], max(0.0, 1 - r["distance"] / min(len(r["term"]), len(text)))) for r in found]
        score = sum((F.when(self._has(name, [t]), F.lit(w * boost)).otherwise(F.lit(0.0)) for t, w in weights), F.lit(0.0))
        return Scored(match, [lambda _: score])

    def _exists(self, name: str) -> Column:
        f = self.config.indexed(name)
        return present(self.schema, f[0].stored if f else name)

    def _exact(self, name: str, text: str, boost: float) -> Scored:
        return self._range(P.Range(name, text, text, True, True), name, boost)

    def _range(self, node: P.Range, name: str, boost: float) -> Scored:
        f = self.config.indexed(name)
        if not f:
            return Scored(F.lit(False))
        kind = f[0].type
        if kind == "STRING":
            low, high = (None if x is None else self._normal(name, x) for x in (node.low, node.high))
            return self._over_terms(name, lambda t: _between(t, low, high, node), boost)
        try:
            read = {"DATE": parse_date, "BOOL": parse_bool, "NUMERIC_FLOAT": float, "NUMERIC_DOUBLE": float}.get(kind, int)
            low, high = (None if x is None else read(x) for x in (node.low, node.high))
        except ValueError:
            return Scored(F.lit(False))  # not a value of the type: nothing matches
        as_lit = lambda x: F.lit(x).cast("timestamp_ntz") if kind == "DATE" else F.lit(x)
        low, high = (None if x is None else as_lit(x) for x in (low, high))
        top = self.schema[f[0].stored] if f[0].stored in self.schema.names else None
        if top is not None and not str(top.dataType).startswith("Array") and not str(top.dataType).startswith("String"):
            value = F.col(f"`{f[0].stored}`")  # a plain column, so that the comparison reaches the scan
            return self._constant(_between(value, low, high, node), boost, never_null=True)
        return self._constant(F.exists(self._typed(f[0]), lambda v: _between(v, low, high, node)), boost)

    # Statistics -------------------------------------------------------------------------------------------------------

    def term_list(self, name: str) -> DataFrame:
        return self.docs.select(F.explode(self.expression(name)).alias("term")).where("term is not null").distinct()

    def statistics(self, docs: DataFrame, leaves: list[Leaf] | None = None) -> Statistics:
        """One aggregate over all documents: a row as wide as the query has terms."""
        leaves = self.leaves if leaves is None else leaves
        names = sorted({leaf.name for leaf in leaves if self.similarity_of(leaf.name) in ("BM25", "TFIDF")})
        wanted = sorted({(leaf.name, t) for leaf in leaves for t in leaf.terms if leaf.name in names})
        out = Statistics({leaf.name: 0 for leaf in leaves}, {leaf.name: 0 for leaf in leaves}, {(leaf.name, t): 0 for leaf in leaves for t in leaf.terms})
        if not names:
            return out
        # The field's tokens are made once per row, below the aggregate.
        rows = docs.select(*(self.expression(n).alias(f"t{i}") for i, n in enumerate(names)))
        at = {n: f"t{i}" for i, n in enumerate(names)}
        size = lambda n: F.size(F.filter(at[n], lambda t: t.isNotNull()))
        aggregates = [F.count_if(size(n) > 0).alias(f"n{i}") for i, n in enumerate(names)]
        aggregates += [F.sum(size(n)).alias(f"l{i}") for i, n in enumerate(names)]
        aggregates += [F.count_if(F.array_contains(at[n], t)).alias(f"d{i}") for i, (n, t) in enumerate(wanted)]
        row = rows.agg(*aggregates).first()
        out.docs.update({n: row[f"n{i}"] for i, n in enumerate(names)})
        out.tokens.update({n: row[f"l{i}"] or 0 for i, n in enumerate(names)})
        out.df.update({key: row[f"d{i}"] for i, key in enumerate(wanted)})
        return out


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def _less(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def _between(value: Column, low, high, node: P.Range) -> Column:
    out = value.isNotNull()
    if low is not None:
        out = out & ((value >= low) if node.include_low else (value > low))
    if high is not None:
        out = out & ((value <= high) if node.include_high else (value < high))
    return out


def wildcard_regex(text: str) -> str:
    """Anchored regular expression of a pattern with * and ?; a backslash takes the next character as it is."""
    out, i = "", 0
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text):
            i += 1
            out += re.escape(text[i])
        else:
            out += {"*": ".*", "?": "."}.get(text[i], re.escape(text[i]))
        i += 1
    return f"^{out}$"


def edit_distance(a: str, b: str) -> int:
    """Edits with adjacent transpositions as one."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, rows[-2][j - 2] + 1)
            row.append(cost)
        rows.append(row)
    return rows[-1][-1]


def fuzzy_terms(terms: DataFrame, text: str, edits: int, prefix: int = 0, transpositions: bool = True) -> DataFrame:
    """(term, distance) of the terms within ``edits``. A transposition costs two plain edits, which bounds the candidates."""
    near = terms.where(F.abs(F.length("term") - len(text)) <= edits)
    if prefix:
        near = near.where(F.substring("term", 1, prefix) == text[:prefix])
    plain = F.levenshtein(F.col("term"), F.lit(text), 2 * edits if transpositions else edits)
    near = near.withColumn("distance", plain).where("distance >= 0")
    if transpositions:

        @F.pandas_udf("int")
        def exact(found: pd.Series) -> pd.Series:
            return found.map(lambda t: edit_distance(t, text)).astype("int32")

        near = near.withColumn("distance", exact("term")).where(F.col("distance") <= edits)
    return near
