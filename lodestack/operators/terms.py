"""Term dictionary scans, term analysis of hits, highlighting."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.analysis import WORD, Analyzer
from ..functions.values import values
from ..plans import parser as P
from ..plans.compiler import Compiler, edit_distance, fuzzy_terms, wildcard_regex
from ..plans.config import ConfigError
from .search import Index, Search


def token_rows(index: Index, name: str, docs: DataFrame | None = None, analyzer: str | None = None) -> DataFrame:
    """(unique_id, term, tf) of an index field, optionally of some of its documents or with another analyzer."""
    found = index.config.indexed(name)
    if not found:
        raise ConfigError(f"{name} is not an indexed field")
    if docs is None and analyzer is None and index.inverted and name in index.inverted.names:
        return index.postings(name).drop("positions")
    docs = index.docs if docs is None else docs
    tokens = Compiler(index.config, docs).expression(name) if analyzer is None else index.config.analyzer(analyzer).column(values(docs.schema, found[0].stored).cast("array<string>"))
    rows = docs.select(index.uid.alias("unique_id"), F.explode(tokens).alias("term")).where("term is not null")
    return rows.groupBy("unique_id", "term").agg(F.count("*").alias("tf"))


@dataclass
class TermsRequest:
    """A scan of a field's terms. ``include`` looks terms up and ignores the range and the patterns; ``fuzzy`` ignores the range."""

    field: str
    amount: int = 0
    start: str | None = None
    end: str | None = None
    min_doc_freq: int = 1
    min_term_freq: int = 1
    term_filter: str | None = None
    term_match: str | None = None
    include: list[str] = field(default_factory=list)
    fuzzy: str | None = None
    edits: int = 2
    prefix: int = 0
    transpositions: bool = True


def terms(index: Index, r: TermsRequest) -> DataFrame:
    """term, doc_freq, term_freq (and score for fuzzy scans), terms ascending. Conditions on the term precede the counting."""
    wanted = F.lit(True)
    t = F.col("term")
    if r.include:
        wanted = t.isin(*r.include)
    else:
        if r.fuzzy is None:
            if r.start is not None:
                wanted = wanted & (t >= r.start)
            if r.end is not None:
                wanted = wanted & (t < r.end)
        if r.term_filter:
            wanted = wanted & ~t.rlike(f"^(?:{r.term_filter})$")
        if r.term_match:
            wanted = wanted & t.rlike(f"^(?:{r.term_match})$")
    if index.inverted and r.field in index.inverted.names:
        out = index.inverted.terms.where(F.col("field") == r.field).where(wanted).select("term", "doc_freq", "term_freq")
    else:
        tokens = Compiler(index.config, index.docs).expression(r.field)
        rows = index.docs.select(index.uid.alias("unique_id"), F.explode(tokens).alias("term")).where("term is not null").where(wanted)
        per_doc = rows.groupBy("unique_id", "term").agg(F.count("*").alias("tf"))
        out = per_doc.groupBy("term").agg(F.count("*").alias("doc_freq"), F.sum("tf").alias("term_freq"))
    out = out.where((F.col("doc_freq") >= r.min_doc_freq) & (F.col("term_freq") >= r.min_term_freq))
    if r.fuzzy is not None and not r.include:
        near = fuzzy_terms(out, r.fuzzy, r.edits, r.prefix, r.transpositions)
        out = near.select("term", "doc_freq", "term_freq", (1 - F.col("distance") / F.least(F.length("term"), F.lit(len(r.fuzzy)))).alias("score"))
    return out.orderBy("term").limit(r.amount) if r.amount else out.orderBy("term")


def terms_with_last(index: Index, r: TermsRequest) -> DataFrame:
    """``terms`` with last_term, where the scan stopped: the last term given out if the amount was reached, else the last in range."""
    out = terms(index, r)
    every = terms(index, replace(r, amount=0, min_doc_freq=1, min_term_freq=1, term_filter=None, term_match=None)).agg(F.max("term").alias("__end"))
    given = out.agg(F.count("*").alias("__n"), F.max("term").alias("__last"))
    last = F.when((F.lit(r.amount) > 0) & (F.col("__n") >= r.amount), F.col("__last")).otherwise(F.col("__end"))
    at = given.join(every, F.lit(True)).select(last.alias("last_term"))  # one row each
    return out.join(F.broadcast(at), F.lit(True)).orderBy("term")


@dataclass
class AnalysisRequest:
    """Terms of hits: ``sort`` TFIDF, TF or ABC; word lengths; document frequency as a count or a share of all documents."""

    field: str
    analyzer: str | None = None
    top: int = 10
    sort: str = "TFIDF"
    min_length: int = 0
    max_length: int = 0
    min_doc_freq: int = 0
    max_doc_freq: int = 0
    min_share: float = 0.0
    max_share: float = 0.0

    def __post_init__(self) -> None:
        if self.sort not in ("TFIDF", "TF", "ABC"):
            raise ConfigError(f"unknown term order {self.sort}")


def doc_freqs(index: Index, r: AnalysisRequest, wanted: DataFrame) -> DataFrame:
    """term, df of the terms in ``wanted``: from the inverted tables, or counted over the texts for these terms only."""
    if r.analyzer is None and index.inverted and r.field in index.inverted.names:
        return index.inverted.terms.where(F.col("field") == r.field).join(wanted, "term", "left_semi").select("term", F.col("doc_freq").alias("df"))
    found = index.config.indexed(r.field)
    tokens = Compiler(index.config, index.docs).expression(r.field) if r.analyzer is None else index.config.analyzer(r.analyzer).column(values(index.docs.schema, found[0].stored).cast("array<string>"))
    every = index.docs.select(F.explode(F.array_distinct(tokens)).alias("term")).where("term is not null")  # once a document
    return every.join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))


def doc_terms(index: Index, hits: DataFrame, r: AnalysisRequest) -> DataFrame:
    """unique_id, term, tf, df, score, place of every term of the hits (rows of the index's documents) that passes the filters."""
    mine = token_rows(index, r.field, hits, r.analyzer)
    if r.min_length:
        mine = mine.where(F.length("term") >= r.min_length)
    if r.max_length:
        mine = mine.where(F.length("term") <= r.max_length)
    total = index.docs.count()
    df = doc_freqs(index, r, mine.select("term").distinct())
    out = mine.join(df, "term").withColumn("score", F.sqrt(F.col("tf").cast("double")) * (1 + F.log((F.lit(total) + 1) / (F.col("df") + 1))))
    low, high = r.min_doc_freq or round(total * r.min_share), r.max_doc_freq or round(total * r.max_share)
    if low:
        out = out.where(F.col("df") >= low)
    if high:
        out = out.where(F.col("df") <= high)
    order = {"TFIDF": [F.desc("score"), F.asc("term")], "TF": [F.desc("tf"), F.asc("term")], "ABC": [F.asc("term")]}[r.sort]
    return out.withColumn("place", F.row_number().over(W.partitionBy("unique_id").orderBy(*order))).select("unique_id", "term", "tf", "df", "score", "place")


def top_terms(index: Index, hits: DataFrame, r: AnalysisRequest) -> DataFrame:
    return doc_terms(index, hits, r).where(F.col("place") <= r.top)


def summary_terms(index: Index, hits: DataFrame, r: AnalysisRequest, of_top: bool = False) -> DataFrame:
    """term, tf, df, score over all tokens of the hits, or over each hit's top terms, cut to the top."""
    pooled = top_terms(index, hits, r) if of_top else doc_terms(index, hits, r)
    total = index.docs.count()
    summed = pooled.groupBy("term").agg(F.sum("tf").alias("tf"), F.first("df").alias("df"))
    summed = summed.withColumn("score", F.sqrt(F.col("tf").cast("double")) * (1 + F.log((F.lit(total) + 1) / (F.col("df") + 1))))
    order = {"TFIDF": [F.desc("score"), F.asc("term")], "TF": [F.desc("tf"), F.asc("term")], "ABC": [F.asc("term")]}[r.sort]
    return summed.orderBy(*order).limit(r.top)


def doc_tokens(index: Index, hits: DataFrame, name: str) -> DataFrame:
    """unique_id, tokens in order."""
    return hits.select(index.uid.alias("unique_id"), F.array_compact(Compiler(index.config, hits).expression(name)).alias("tokens"))


def _matcher(nodes: list[P.Node], analyzer: Analyzer):
    """Whether a token belongs to the query's terms of the field."""
    exact: set[str] = set()
    patterns: list[regex.Pattern] = []
    fuzzy: list[tuple[str, int]] = []
    for n in nodes:
        if isinstance(n, (P.Text, P.Phrase)):
            exact |= {t for x in analyzer.tokens(n.text) if x is not None for t in x.split(" ")}
        elif isinstance(n, P.Prefix):
            patterns.append(regex.compile(regex.escape(analyzer.normalize(n.text)) + ".*"))
        elif isinstance(n, P.Wildcard):
            patterns.append(regex.compile(wildcard_regex(analyzer.normalize(n.text))))
        elif isinstance(n, P.Regex):
            patterns.append(regex.compile(n.text))
        elif isinstance(n, P.Fuzzy):
            fuzzy.append((analyzer.normalize(n.text), n.edits))
    return lambda t: t is not None and (t in exact or any(p.fullmatch(t) for p in patterns) or any(edit_distance(t, w) <= k for w, k in fuzzy))


def highlight(search: Search, hits: DataFrame, name: str, pre: str = "<em>", post: str = "</em>", fragments: int = 1, length: int = 100) -> DataFrame:
    """unique_id, field (stored name), fragments: the best parts of the hits' values with query terms marked.

    ``hits`` are rows of the index's documents, a page of them; terms of filters and scored queries on the field count too.
    """
    found = search.index.config.indexed(name)
    if not found:
        return hits.limit(0).select(search.index.uid.alias("unique_id"), F.lit(name).alias("field"), F.array().cast("array<string>").alias("fragments"))
    stored, analyzer = found[0].stored, search.index.config.analyzer(found[1])
    nodes = [n for c in search.compilers for n in c.shown.get(name, [])]

    @F.pandas_udf("array<string>")
    def mark(rows: pd.Series) -> pd.Series:
        wanted = _matcher(nodes, analyzer)

        def best(texts) -> list[str]:
            out = []
            for text in texts if texts is not None else ():
                if analyzer.tokenizer == "KEYWORD":
                    if any(wanted(t) for t in analyzer.tokens(text)):
                        out.append((-1, 0, pre + text + post))
                    continue
                spans = [m.span() for m in regex.finditer(WORD, text) if any(wanted(t) for t in analyzer.tokens(m[0]))]
                for begin, end in _fragments(text, length):
                    inside = [(a, b) for a, b in spans if begin <= a < end]
                    if inside:
                        part, at = "", begin
                        for a, b in inside:
                            part += text[at:a] + pre + text[a:b] + post
                            at = b
                        out.append((-len(inside), begin, part + text[at : max(at, end)]))
            return [x[2].strip() for x in sorted(out, key=lambda x: x[:2])[:fragments]]

        return rows.map(best)

    marked = mark(values(hits.schema, stored).cast("array<string>"))
    return hits.select(search.index.uid.alias("unique_id"), F.lit(stored).alias("field"), marked.alias("fragments"))


def _fragments(text: str, length: int) -> list[tuple[int, int]]:
    """Cuts at white space so that a fragment has about ``length`` characters."""
    out, begin = [], 0
    while begin < len(text):
        end = begin + length
        if end < len(text):
            m = regex.compile(r"\s").search(text, end)
            end = m.start() if m else len(text)
        out.append((begin, min(end, len(text))))
        begin = end
    return out


def term_score(tf: Column, df: Column, docs: int) -> Column:
    return F.sqrt(tf.cast("double")) * (1 + F.log((F.lit(docs) + 1) / (df + 1)))
