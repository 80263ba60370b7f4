"""The registered queries of the search engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import vector
from .functions.analysis import Analyzer
from .functions.values import extract
from .operators import store, terms
from .operators.store import DocumentStore, shared_folder
from .operators.search import Catalog, FieldConfig, Index, IndexConfig, Query, Search, hits, hits_with_next, near_documents, or_query, search_facets
from .plans.config import Projection
from .sources import formats
from .streaming.upsert import counts_by_window

Run = Callable[[SparkSession, str], DataFrame]
CATALOGUE: dict[str, tuple[Run, str | None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> Index:
    fields = [FieldConfig("text").index("standard"), FieldConfig("lang").index("lcKeyword").facet().sort(), FieldConfig("source").index("lcKeyword").facet().sort(), FieldConfig("n_chars", "NUMERIC_LONG").index().sort()]
    return Index(IndexConfig("documents", fields, unique_id="doc_id", default_search_field="text", segments=16), table(spark, sf_dir, "documents"))


def orders(spark: SparkSession, sf_dir: str) -> Index:
    fields = [
        FieldConfig("o_custkey", "NUMERIC_LONG").index(), FieldConfig("o_orderstatus").index("lcKeyword").facet(), FieldConfig("o_totalprice", "NUMERIC_DOUBLE").index().sort(),
        FieldConfig("o_orderdate", "DATE").index().facet("day").facet("compact", "DATE_YYYYMMDD").sort(), FieldConfig("o_orderpriority").index("lcKeyword").facet(),
    ]
    return Index(IndexConfig("orders", fields, unique_id="o_orderkey"), table(spark, sf_dir, "orders"))


def parts(spark: SparkSession, sf_dir: str) -> Index:
    fields = [
        FieldConfig("p_name").index("standard").sort("LOWERCASE"), FieldConfig("p_brand").index("lcKeyword").facet(), FieldConfig("p_type").index("standard").facet(),
        FieldConfig("p_size", "NUMERIC_INT").index().sort(), FieldConfig("p_retailprice", "NUMERIC_DOUBLE").index().sort(), FieldConfig("words").facet().sort(),
    ]
    docs = table(spark, sf_dir, "part").withColumn("words", F.split("p_name", " "))
    return Index(IndexConfig("parts", fields, unique_id="p_partkey", default_search_field="p_name"), docs)


def events(spark: SparkSession, sf_dir: str) -> Index:
    """Clicks have no value."""
    docs = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_type") != "click", F.col("value")))
    fields = [FieldConfig("event_type").index("lcKeyword").facet(), FieldConfig("value", "NUMERIC_DOUBLE").index().sort(), FieldConfig("ts", "DATE").index().facet("day").sort(), FieldConfig("user_id", "NUMERIC_LONG").index().sort()]
    return Index(IndexConfig("events", fields, unique_id="event_id"), docs)


def people(spark: SparkSession, sf_dir: str, name: str, prefix: str) -> Index:
    docs = table(spark, sf_dir, name).select(F.concat(F.lit(f"{name}-"), F.col(f"{prefix}key").cast("string")).alias("id"), F.col(f"{prefix[:2]}name").alias("name"), F.col(f"{prefix[:2]}acctbal").alias("acctbal"), F.col(f"{prefix[:2]}nationkey").alias("nationkey"))
    fields = [FieldConfig("name").index("standard").sort("LOWERCASE"), FieldConfig("acctbal", "NUMERIC_DOUBLE").index().sort(), FieldConfig("nationkey", "NUMERIC_INT").index().facet().sort()]
    return Index(IndexConfig(name, fields, unique_id="id"), docs)


# SQL pieces -----------------------------------------------------------------------------------------------------------

#: Fixed values, written out apart from the engine's own: what a word is, and the usual short list of English stop words.
SQL_WORD = r"[\p{L}\p{M}\p{N}_]+(?:[''’.][\p{L}\p{M}\p{N}_]+)*"
SQL_STOPS = "'a', 'an', 'and', 'are', 'as', 'at', 'be', 'but', 'by', 'for', 'if', 'in', 'into', 'is', 'it', 'no', 'not', 'of', 'on', 'or', 'such', 'that', 'the', 'their', 'then', 'there', 'these', 'they', 'this', 'to', 'was', 'will', 'with'"
#: Tokens in order with nulls for stop words, and the terms without them.
TOKENS = f"""
docs AS (
  SELECT doc_id::VARCHAR AS unique_id, lang, source, n_chars, list_transform(list_filter(regexp_extract_all(text, '{SQL_WORD}'), lambda t: length(t) <= 255), lambda t: CASE WHEN lower(t) IN ({SQL_STOPS}) THEN NULL ELSE lower(t) END) AS toks FROM documents
), d AS (SELECT *, list_filter(toks, lambda t: t IS NOT NULL) AS terms FROM docs)"""


def has(*words: str, joined: str = " OR ") -> str:
    return "(" + joined.join(f"list_contains(terms, '{w}')" for w in words) + ")"


def register(name: str, run: Run, sql: str | None) -> None:
    CATALOGUE[name] = (run, sql)


def matching(name: str, index, query: Callable[[], Query] | str, sql: str | None) -> None:
    """Ids of all matches."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        i = index(spark, sf_dir)
        q = Query(query) if isinstance(query, str) else query()
        return Search(i, q).matches().select(i.uid.alias("unique_id"))

    register(name, run, sql)


def text_match(name: str, query: Callable[[], Query] | str, where: str) -> None:
    matching(name, documents, query, f"WITH {TOKENS} SELECT unique_id FROM d WHERE {where}")


def plain_match(name: str, index, query: Callable[[], Query] | str, sql_table: str, key: str, where: str) -> None:
    matching(name, index, query, f"SELECT {key}::VARCHAR AS unique_id FROM {sql_table} WHERE {where}")


# Text queries (F1-F9, F16, F20) -----------------------------------------------------------------------------------------

text_match("term_match", "from", has("from"))
text_match("default_or", "from than", has("from", "than"))
text_match("bool_and_or_not", "+from than -ther", f"{has('from')} AND NOT {has('ther')}")
text_match("classic_precedence", "ther OR from AND than", has("from", "than", joined=" AND "))
text_match("default_and", lambda: Query("from than ther", default_and=True), has("from", "than", "ther", joined=" AND "))
text_match("min_should_match", lambda: Query("from OR than OR ther OR thon", mm=3), "(list_contains(terms, 'from')::INT + list_contains(terms, 'than')::INT + list_contains(terms, 'ther')::INT + list_contains(terms, 'thon')::INT) >= 3")
text_match("nested_groups", "(from AND than) OR (de AND la) -lang:es", f"({has('from', 'than', joined=' AND ')} OR {has('de', 'la', joined=' AND ')}) AND lang <> 'es'")
text_match("pure_negative", "-from", f"NOT {has('from')}")
text_match("phrase_match", '"anea eriner thanea"', "list_has_any(list_transform(range(1, len(toks) - 1), lambda i: coalesce(toks[i] = 'anea' AND toks[i + 1] = 'eriner' AND toks[i + 2] = 'thanea', false)), [true])")
text_match("phrase_slop", '"de le"~2', "list_has_any(list_transform(range(1, len(toks) + 1), lambda i: coalesce(toks[i] = 'de', false) AND list_contains(list_slice(toks, greatest(1, i - 1), i + 3), 'le')), [true])")
text_match("prefix_match", "thon*", "len(list_filter(terms, lambda t: starts_with(t, 'thon'))) > 0")
text_match("wildcard_match", "?ro*", "len(list_filter(terms, lambda t: regexp_full_match(t, '.ro.*'))) > 0")
text_match("leading_wildcard", "*tionre", "len(list_filter(terms, lambda t: t LIKE '%tionre')) > 0")
text_match("regex_match", "/th(on|an)[a-e]+/", "len(list_filter(terms, lambda t: regexp_full_match(t, 'th(on|an)[a-e]+'))) > 0")
text_match("string_range", "text:[fra TO frz}", "len(list_filter(terms, lambda t: t >= 'fra' AND t < 'frz')) > 0")
matching("fuzzy_match", documents, "frmo~1", f"""
WITH {TOKENS}, x AS (
  SELECT term FROM (SELECT DISTINCT unnest(terms) AS term FROM d) WHERE abs(length(term) - 4) <= 1 AND damerau_levenshtein(term, 'frmo') <= 1
  ORDER BY damerau_levenshtein(term, 'frmo'), term LIMIT 50
) SELECT unique_id FROM d WHERE list_has_any(terms, (SELECT list(term) FROM x))""")

# Clauses that the analyzer leaves without a term are as if they were not there.
text_match("stop_word_and", "from AND the", has("from"))
text_match("stop_word_must", "+the from -than", f"{has('from')} AND NOT {has('than')}")
text_match("stop_word_phrase_default_and", lambda: Query('from "the" text:and', default_and=True), has("from"))
text_match("stop_word_pure_negative", "+the -from", f"NOT {has('from')}")
text_match("or_helper", lambda: Query(or_query("text", ["from", "than", "a \"b\""])), has("from", "than"))
text_match("only_stop_words", "the OR (and OR of)", "false")

# Typed fields, filters, drill-down (F10-F15, F21-F23) -------------------------------------------------------------------

plain_match("numeric_range_inclusive", orders, "o_totalprice:[100000 TO 200000.5]", "orders", "o_orderkey", "o_totalprice BETWEEN 100000 AND 200000.5")
plain_match("numeric_range_exclusive", parts, "p_size:{10 TO 13}", "part", "p_partkey", "p_size > 10 AND p_size < 13")
plain_match("numeric_range_mixed", parts, "p_size:[10 TO 13}", "part", "p_partkey", "p_size >= 10 AND p_size < 13")
plain_match("open_range", orders, "o_totalprice:[450000 TO *]", "orders", "o_orderkey", "o_totalprice >= 450000")
plain_match("numeric_term", parts, "p_size:7", "part", "p_partkey", "p_size = 7")
plain_match("numeric_term_not_a_number", parts, "p_size:seven", "part", "p_partkey", "false")
plain_match("date_range", orders, "o_orderdate:[1996-01-01 TO 1996-03-31]", "orders", "o_orderkey", "o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-03-31'")
plain_match("date_range_exclusive", orders, "o_orderdate:{1996-01-01 TO 1996-01-03}", "orders", "o_orderkey", "o_orderdate > TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-01-03'")
plain_match("date_term", orders, "o_orderdate:1997-05-28", "orders", "o_orderkey", "o_orderdate = TIMESTAMP '1997-05-28'")
plain_match("date_instant", events, 'ts:["2024-01-01T06:00:00Z" TO *]', "events", "event_id", "ts >= TIMESTAMP '2024-01-01 06:00:00'")
plain_match("field_exists", events, "value:*", "events", "event_id", "event_type <> 'click' AND value IS NOT NULL")
plain_match("field_missing", events, "-value:*", "events", "event_id", "NOT (event_type <> 'click' AND value IS NOT NULL)")
plain_match("match_all", orders, "*:*", "orders", "o_orderkey", "true")
plain_match("empty_with_fields", events, lambda: Query("").fields("value"), "events", "event_id", "event_type <> 'click' AND value IS NOT NULL")
plain_match("filter_query_chain", orders, lambda: Query("o_orderstatus:f").filter("o_totalprice:[* TO 50000]", "-o_orderpriority:5-low"), "orders", "o_orderkey", "o_orderstatus = 'F' AND o_totalprice <= 50000 AND o_orderpriority <> '5-LOW'")
plain_match("drilldown_or_and", orders, lambda: Query().drill("o_orderpriority", "1-URGENT", "2-HIGH").drill("o_orderstatus", "P"), "orders", "o_orderkey", "o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'P'")
plain_match("drilldown_date", orders, lambda: Query().drill("day", "1997-05-28"), "orders", "o_orderkey", "o_orderdate::DATE = DATE '1997-05-28'")

# Scores (R1-R8, F18, F19, F22) ------------------------------------------------------------------------------------------

STATS = """
s AS (SELECT count(*) FILTER (len(terms) > 0)::DOUBLE AS n, sum(len(terms))::DOUBLE / count(*) FILTER (len(terms) > 0) AS mean FROM d)"""


def sql_term(word: str, kind: str, boost: float = 1.0, terms_: str = "terms") -> str:
    tf, df = f"len(list_filter({terms_}, lambda t: t = '{word}'))::DOUBLE", f"(SELECT count(*) FROM d WHERE list_contains({terms_}, '{word}'))::DOUBLE"
    one = {
        "BM25": f"ln(1 + (n - {df} + 0.5) / ({df} + 0.5)) * {tf} * 2.2::DOUBLE / ({tf} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len({terms_}) / mean))",
        "TFIDF": f"sqrt({tf}) * (1 + ln((n + 1) / ({df} + 1))) / sqrt(len({terms_})::DOUBLE)",
        "TF": tf,
        "CONSTANT": "1.0::DOUBLE",
    }[kind]
    return f"CASE WHEN list_contains({terms_}, '{word}') THEN {boost}::DOUBLE * {one} ELSE 0 END"


def top(name: str, query: Callable[[], Query], where: str, score: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return hits(documents(spark, sf_dir), query()).select("rank", "unique_id", F.round("score", 6).alias("score"))

    register(name, run, f"""
WITH {TOKENS}, {STATS}, r AS (SELECT unique_id, {score} AS score FROM d, s WHERE {where})
SELECT (row_number() OVER (ORDER BY score DESC, unique_id))::INT AS rank, unique_id, round(score, 6) AS score FROM r ORDER BY r.score DESC, unique_id LIMIT 10""")


for _kind in ("BM25", "TFIDF", "TF", "CONSTANT"):
    top(f"{_kind.lower()}_topk", lambda k=_kind: Query("from than thon").similar("text", k), has("from", "than", "thon"), " + ".join(sql_term(w, _kind) for w in ("from", "than", "thon")))
top("boosted_topk", lambda: Query("from^3 OR than"), has("from", "than"), f"{sql_term('from', 'BM25', 3)} + {sql_term('than', 'BM25')}")
top("must_should_topk", lambda: Query("+lang:en from than").similar("lang", "CONSTANT"), "lang = 'en'", f"1 + {sql_term('from', 'BM25')} + {sql_term('than', 'BM25')}")
top("scored_query_topk", lambda: Query("from").score_also("than"), has("from", "than", joined=" AND "), f"{sql_term('from', 'BM25')} + {sql_term('than', 'BM25')}")
top("constant_multi_term_topk", lambda: Query("from thon*"), f"{has('from')} OR len(list_filter(terms, lambda t: starts_with(t, 'thon'))) > 0", f"{sql_term('from', 'BM25')} + (len(list_filter(terms, lambda t: starts_with(t, 'thon'))) > 0)::INT")

# The same searches over inverted tables


_inverted: dict[tuple[str, str], Index] = {}


def inverted(spark: SparkSession, sf_dir: str) -> Index:
    """The documents over inverted tables, which a session writes once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _inverted:
        _inverted[key] = documents(spark, sf_dir).invert(f"{shared_folder(spark)}/inverted-{uuid4().hex}", "text")
    return _inverted[key]


def inverted_top(name: str, like: str, query: Callable[[], Query]) -> None:
    register(name, lambda spark, sf_dir: hits(inverted(spark, sf_dir), query()).select("rank", "unique_id", F.round("score", 6).alias("score")), CATALOGUE[like][1])


def inverted_match(name: str, like: str, query: Callable[[], Query] | str) -> None:
    matching(name, inverted, query, CATALOGUE[like][1])


inverted_top("inverted_bm25_topk", "bm25_topk", lambda: Query("from than thon"))
inverted_top("inverted_constant_multi_term_topk", "constant_multi_term_topk", lambda: Query("from thon*"))
inverted_match("inverted_bool_and_or_not", "bool_and_or_not", "+from than -ther")
inverted_match("inverted_pure_negative", "pure_negative", "-from")
inverted_match("inverted_phrase_match", "phrase_match", '"anea eriner thanea"')
inverted_match("inverted_phrase_slop", "phrase_slop", '"de le"~2')
inverted_match("inverted_fuzzy_match", "fuzzy_match", "frmo~1")
inverted_match("inverted_stop_word_and", "stop_word_and", "from AND the")

PARTS = f"""
p AS (SELECT p_partkey::VARCHAR AS unique_id, list_transform(regexp_extract_all(p_name, '{SQL_WORD}'), lambda t: lower(t)) AS a, list_transform(regexp_extract_all(p_type, '{SQL_WORD}'), lambda t: lower(t)) AS b FROM part),
st AS (SELECT count(*)::DOUBLE AS n, sum(len(a)) / count(*)::DOUBLE AS ma, sum(len(b)) / count(*)::DOUBLE AS mb FROM p)"""


def sql_part(word: str, side: str) -> str:
    tf, df = f"len(list_filter({side}, lambda t: t = '{word}'))::DOUBLE", f"(SELECT count(*) FROM p WHERE list_contains({side}, '{word}'))::DOUBLE"
    return f"CASE WHEN list_contains({side}, '{word}') THEN ln(1 + (n - {df} + 0.5) / ({df} + 0.5)) * {tf} * 2.2::DOUBLE / ({tf} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len({side}) / m{side})) ELSE 0 END"


def parts_top(name: str, query: Callable[[], Query], score: str) -> None:
    register(name, lambda spark, sf_dir: hits(parts(spark, sf_dir), query()).select("rank", "unique_id", F.round("score", 6).alias("score")), f"""
WITH {PARTS}, r AS (SELECT unique_id, {score} AS score FROM p, st WHERE list_has_any(a, ['small', 'ring']) OR list_has_any(b, ['small', 'ring']))
SELECT (row_number() OVER (ORDER BY score DESC, unique_id))::INT AS rank, unique_id, round(score, 6) AS score FROM r ORDER BY r.score DESC, unique_id LIMIT 10""")


parts_top("multifield_boost", lambda: Query("small ring").fields("p_name^2", "p_type"), f"2 * ({sql_part('small', 'a')}) + 2 * ({sql_part('ring', 'a')}) + {sql_part('small', 'b')} + {sql_part('ring', 'b')}")
_best = " + ".join(f"greatest({sql_part(w, 'a')}, {sql_part(w, 'b')}) + 0.1::DOUBLE * least({sql_part(w, 'a')}, {sql_part(w, 'b')})" for w in ("small", "ring"))
parts_top("dismax_tie", lambda: Query("small ring", dismax=True, tie=0.1).fields("p_name", "p_type"), _best)

# Facets and counts (G1-G12) ---------------------------------------------------------------------------------------------


def faceted(name: str, index, query: Callable[[], Query], sql: str) -> None:
    register(name, lambda spark, sf_dir: search_facets(index(spark, sf_dir), query()), sql)


def sql_facet(facet: str, value: str, source: str, limit: int = 10) -> str:
    cut = f" ORDER BY count DESC, value LIMIT {limit}" if limit else ""
    return f"SELECT '{facet}' AS facet, value, count(*) AS count, 0::BIGINT AS max_error, false AS possible_missing, 0::BIGINT AS max_value_possible_missing FROM (SELECT {value} AS value FROM {source}) WHERE value <> '' GROUP BY value{cut}"


faceted("facet_count", documents, lambda: Query("from").count("lang", 0), f"WITH {TOKENS} {sql_facet('lang', 'lang', 'd WHERE ' + has('from'), 0)}")
faceted("facet_topn", documents, lambda: Query().count("source", 5), sql_facet("source", "source", "documents", 5))
faceted("facet_multivalued", parts, lambda: Query().count("words", 0), sql_facet("words", "unnest(list_distinct(string_split(p_name, ' ')))", "part", 0))
faceted("facet_date_ymd", orders, lambda: Query("o_totalprice:[400000 TO *]").count("day", 7), sql_facet("day", "strftime(o_orderdate, '%Y-%m-%d')", "orders WHERE o_totalprice >= 400000", 7))
faceted("facet_date_compact", orders, lambda: Query().count("compact", 7), sql_facet("compact", "strftime(o_orderdate, '%Y%m%d')", "orders", 7))
faceted("facet_after_drilldown", orders, lambda: Query().drill("o_orderstatus", "F").count("o_orderpriority"), sql_facet("o_orderpriority", "o_orderpriority", "orders WHERE o_orderstatus = 'F'"))
faceted("facet_two_at_once", orders, lambda: Query("o_totalprice:[400000 TO *]").count("o_orderstatus").count("o_orderpriority", 2), "(" + sql_facet("o_orderstatus", "o_orderstatus", "orders WHERE o_totalprice >= 400000") + ") UNION ALL (" + sql_facet("o_orderpriority", "o_orderpriority", "orders WHERE o_totalprice >= 400000", 2) + ")")
register("facet_multi_index", lambda spark, sf_dir: search_facets([people(spark, sf_dir, "customer", "c_cust"), people(spark, sf_dir, "supplier", "s_supp")], Query().count("nationkey", 5)), "SELECT 'nationkey' AS facet, value, count(*) AS count, 0::BIGINT AS max_error, false AS possible_missing, 0::BIGINT AS max_value_possible_missing FROM (SELECT c_nationkey::VARCHAR AS value FROM customer UNION ALL SELECT s_nationkey::VARCHAR FROM supplier) GROUP BY value ORDER BY count DESC, value LIMIT 5")
register("total_hits", lambda spark, sf_dir: Search(documents(spark, sf_dir), Query("from AND than")).total(), f"WITH {TOKENS} SELECT count(*) AS total_hits FROM d WHERE {has('from', 'than', joined=' AND ')}")
register("doc_count", lambda spark, sf_dir: documents(spark, sf_dir).doc_counts().groupBy(F.col("shard").isNull().alias("is_total")).agg(F.sum("count").alias("count")), "SELECT true AS is_total, count(*) AS count FROM documents UNION ALL SELECT false, count(*) FROM documents")
register("field_names", lambda spark, sf_dir: documents(spark, sf_dir).field_names(), "SELECT unnest(['lang', 'n_chars', 'source', 'text']) AS field")

# Sorts and paging (T1-T14, U1) ------------------------------------------------------------------------------------------


def page(name: str, index, query: Callable[[], Query], sql: str, keys: dict[str, str]) -> None:
    register(name, lambda spark, sf_dir: hits(index(spark, sf_dir), query()).select("rank", "unique_id", *(F.col(k).alias(v) for k, v in keys.items())), sql)


def sql_page(key: str, columns: str, source: str, order: str, limit: int, offset: int = 0) -> str:
    return f"SELECT (row_number() OVER (ORDER BY {order}, {key}::VARCHAR))::INT AS rank, {key}::VARCHAR AS unique_id, {columns} FROM {source} ORDER BY {order}, unique_id LIMIT {limit} OFFSET {offset}"


page("sort_multi_key", parts, lambda: Query(amount=20).sort("p_size", True).sort("p_retailprice"), sql_page("p_partkey", "p_size, p_retailprice", "part", "p_size DESC, p_retailprice", 20), {"s0": "p_size", "s1": "p_retailprice"})
page("sort_lowercase", parts, lambda: Query(amount=20).sort("p_name"), sql_page("p_partkey", "lower(p_name) AS name", "part", "lower(p_name)", 20), {"s0": "name"})
page("sort_multivalued_min", parts, lambda: Query(amount=20).sort("words"), sql_page("p_partkey", "least(string_split(p_name, ' ')[1], string_split(p_name, ' ')[2]) AS word", "part", "least(string_split(p_name, ' ')[1], string_split(p_name, ' ')[2])", 20), {"s0": "word"})
page("sort_multivalued_max", parts, lambda: Query(amount=20).sort("words", True), sql_page("p_partkey", "greatest(string_split(p_name, ' ')[1], string_split(p_name, ' ')[2]) AS word", "part", "greatest(string_split(p_name, ' ')[1], string_split(p_name, ' ')[2]) DESC", 20), {"s0": "word"})
page("sort_missing_values", events, lambda: Query(amount=20).sort("value").sort("ts", True), sql_page("event_id", "CASE WHEN event_type <> 'click' THEN value ELSE 0 END AS value", "events", "CASE WHEN event_type <> 'click' THEN value ELSE 0 END, ts DESC", 20), {"s0": "value"})
page("sort_date", orders, lambda: Query("o_orderstatus:p", amount=20).sort("o_orderdate", True), sql_page("o_orderkey", "o_orderdate", "orders WHERE o_orderstatus = 'P'", "o_orderdate DESC", 20), {"s0": "o_orderdate"})
page("offset_limit", orders, lambda: Query(amount=15, start=30).sort("o_totalprice", True), sql_page("o_orderkey", "o_totalprice", "orders", "o_totalprice DESC", 15, 30), {"s0": "o_totalprice"})


def second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.search import cursor

    index, query = orders(spark, sf_dir), Query(amount=10).sort("o_orderdate").sort("o_totalprice", True)
    last = hits(index, query).orderBy(F.desc("rank")).first()
    return hits(index, Query(amount=10, after=cursor(last, query)).sort("o_orderdate").sort("o_totalprice", True)).select("rank", "unique_id", F.col("s1").alias("o_totalprice"))


register("search_after_page2", second_page, "SELECT (row_number() OVER (ORDER BY o_orderdate, o_totalprice DESC, o_orderkey::VARCHAR) - 10)::INT AS rank, o_orderkey::VARCHAR AS unique_id, o_totalprice FROM orders ORDER BY o_orderdate, o_totalprice DESC, unique_id LIMIT 10 OFFSET 10")
register("multi_index_search", lambda spark, sf_dir: hits([people(spark, sf_dir, "customer", "c_cust"), people(spark, sf_dir, "supplier", "s_supp")], Query("acctbal:[* TO 0}", amount=25).sort("acctbal")).select("rank", "unique_id", "index_name", F.col("s0").alias("acctbal")), """
WITH u AS (SELECT 'customer' AS index_name, 'customer-' || c_custkey AS unique_id, c_acctbal AS acctbal FROM customer UNION ALL SELECT 'supplier', 'supplier-' || s_suppkey, s_acctbal FROM supplier)
SELECT (row_number() OVER (ORDER BY acctbal, unique_id))::INT AS rank, unique_id, index_name, acctbal FROM u WHERE acctbal < 0 ORDER BY acctbal, unique_id LIMIT 25""")
register("include_and_mask", lambda spark, sf_dir: hits(parts(spark, sf_dir), Query("p_size:7", amount=10).sort("p_retailprice").show("p_name", "p_size", "-p_size")).select("unique_id", F.to_json("document").alias("document")), "SELECT p_partkey::VARCHAR AS unique_id, '{\"p_name\":\"' || p_name || '\"}' AS document FROM part WHERE p_size = 7 ORDER BY p_retailprice, unique_id LIMIT 10")

register("page_has_more", lambda spark, sf_dir: hits_with_next(orders(spark, sf_dir), Query("o_orderstatus:p", amount=12, start=12).sort("o_totalprice", True)).select("rank", "unique_id", "has_more"), """
SELECT rank, unique_id, n > 24 AS has_more FROM (SELECT (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey::VARCHAR))::INT AS rank, o_orderkey::VARCHAR AS unique_id, count(*) OVER () AS n FROM orders WHERE o_orderstatus = 'P') WHERE rank BETWEEN 13 AND 24""")
register("page_of_none", lambda spark, sf_dir: hits(orders(spark, sf_dir), Query(amount=0).sort("o_totalprice")).select("rank", "unique_id"), "SELECT 1::INT AS rank, '' AS unique_id WHERE false")


def flagged(spark: SparkSession, sf_dir: str) -> Index:
    """Customers, with a boolean field: whether they owe."""
    docs = table(spark, sf_dir, "customer").select("c_custkey", "c_name", (F.col("c_acctbal") < 0).alias("owes"))
    return Index(IndexConfig("flagged", [FieldConfig("owes", "BOOL").index().sort(), FieldConfig("c_name").index("lcKeyword").sort("LOWERCASE_FOLDING")], unique_id="c_custkey"), docs)


plain_match("boolean_term", flagged, "owes:true", "customer", "c_custkey", "c_acctbal < 0")
page("sort_boolean", flagged, lambda: Query(amount=30).sort("owes", True), sql_page("c_custkey", "c_acctbal < 0 AS owes", "customer", "c_acctbal < 0 DESC", 30), {"s0": "owes"})
page("sort_folded", flagged, lambda: Query(amount=30).sort("c_name", True), sql_page("c_custkey", "lower(c_name) AS name", "customer", "lower(c_name) DESC", 30), {"s0": "name"})

# Terms (D1-D7) and analysis (H2-H8) -------------------------------------------------------------------------------------

SQL_TERMS = f"WITH {TOKENS}, t AS (SELECT term, count(DISTINCT unique_id) AS doc_freq, count(*)::BIGINT AS term_freq FROM (SELECT unique_id, unnest(terms) AS term FROM d) GROUP BY term) SELECT * FROM t"


def scan(name: str, sql_tail: str, **options) -> None:
    register(name, lambda spark, sf_dir: terms.terms(documents(spark, sf_dir), terms.TermsRequest("text", **options)), f"{SQL_TERMS} {sql_tail}")


scan("terms_scan", "")
scan("terms_range", "WHERE term >= 'thon' AND term < 'thoo'", start="thon", end="thoo")
scan("terms_filter_match", "WHERE regexp_full_match(term, 'th.*') AND NOT regexp_full_match(term, '.*(on|an).*')", term_match="th.*", term_filter=".*(on|an).*")
scan("terms_min_freq", "WHERE doc_freq >= 50 AND term_freq >= 100", min_doc_freq=50, min_term_freq=100)
scan("terms_amount", "WHERE term >= 'de' ORDER BY term LIMIT 25", start="de", amount=25)
scan("terms_include", "WHERE term IN ('from', 'than', 'nosuchterm')", include=["from", "than", "nosuchterm"])
register("terms_fuzzy", lambda spark, sf_dir: terms.terms(documents(spark, sf_dir), terms.TermsRequest("text", fuzzy="than", edits=1)).withColumn("score", F.round("score", 6)), SQL_TERMS.replace("SELECT * FROM t", "SELECT *, round(1 - damerau_levenshtein(term, 'than')::DOUBLE / least(length(term), 4), 6) AS score FROM t WHERE abs(length(term) - 4) <= 1 AND damerau_levenshtein(term, 'than') <= 1"))


register("inverted_terms_min_freq", lambda spark, sf_dir: terms.terms(inverted(spark, sf_dir), terms.TermsRequest("text", min_doc_freq=50, min_term_freq=100)), f"{SQL_TERMS} WHERE doc_freq >= 50 AND term_freq >= 100")
register("terms_last_term", lambda spark, sf_dir: terms.terms_with_last(documents(spark, sf_dir), terms.TermsRequest("text", start="de", end="df", min_doc_freq=20)), SQL_TERMS.replace("SELECT * FROM t", "SELECT *, (SELECT max(term) FROM t WHERE term >= 'de' AND term < 'df') AS last_term FROM t WHERE term >= 'de' AND term < 'df' AND doc_freq >= 20"))
register("terms_last_term_of_amount", lambda spark, sf_dir: terms.terms_with_last(inverted(spark, sf_dir), terms.TermsRequest("text", start="de", amount=25)), SQL_TERMS.replace("SELECT * FROM t", "SELECT *, max(term) OVER () AS last_term FROM (SELECT * FROM t WHERE term >= 'de' ORDER BY term LIMIT 25)"))


def analysed(kind: Callable[..., DataFrame], r: terms.AnalysisRequest, of=documents, **options) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = of(spark, sf_dir)
        out = kind(index, Search(index, Query("from AND than")).matches(), r, **options)
        return out.withColumn("score", F.round("score", 6))

    return run


def sql_analysis(tail: str, keep: str = "true") -> str:
    return f"""WITH {TOKENS}, n AS (SELECT count(*)::DOUBLE AS n FROM d), w AS (SELECT unique_id, {has('from', 'than', joined=' AND ')} AS hit, unnest(terms) AS term FROM d),
f AS (SELECT term, count(DISTINCT unique_id) AS df FROM w GROUP BY term), m AS (SELECT unique_id, term, count(*) AS tf FROM w WHERE hit GROUP BY ALL),
x AS (SELECT unique_id, term, tf, df, sqrt(tf::DOUBLE) * (1 + ln((n + 1) / (df + 1))) AS score FROM m JOIN f USING (term), n WHERE {keep}),
y AS (SELECT unique_id, term, tf, df, round(score, 6) AS score, (row_number() OVER (PARTITION BY unique_id ORDER BY x.score DESC, term))::INT AS place FROM x), {tail}"""


_sum = "SELECT term, tf, df, round(score, 6) AS score FROM (SELECT term, sum(tf)::BIGINT AS tf, first(df) AS df, sqrt(sum(tf)::DOUBLE) * (1 + ln(((SELECT n FROM n) + 1) / (first(df) + 1))) AS score FROM {} GROUP BY term) z ORDER BY z.score DESC, term LIMIT 10"
register("doc_top_terms", analysed(terms.top_terms, terms.AnalysisRequest("text", top=5)), sql_analysis("o AS (SELECT 1) SELECT * FROM y WHERE place <= 5"))
register("summary_terms_all", analysed(terms.summary_terms, terms.AnalysisRequest("text")), sql_analysis("o AS (SELECT 1) " + _sum.format("x")))
register("inverted_summary_terms_all", analysed(terms.summary_terms, terms.AnalysisRequest("text"), inverted), CATALOGUE["summary_terms_all"][1])
register("summary_terms_top", analysed(terms.summary_terms, terms.AnalysisRequest("text"), of_top=True), sql_analysis("o AS (SELECT * FROM y WHERE place <= 10) " + _sum.format("o")))
register("doc_top_terms_tf", analysed(terms.top_terms, terms.AnalysisRequest("text", top=5, sort="TF")), sql_analysis("o AS (SELECT 1) SELECT unique_id, term, tf, df, score, p AS place FROM (SELECT *, (row_number() OVER (PARTITION BY unique_id ORDER BY tf DESC, term))::INT AS p FROM y) WHERE p <= 5"))
register("summary_terms_abc", analysed(terms.summary_terms, terms.AnalysisRequest("text", sort="ABC", top=20)), sql_analysis("o AS (SELECT 1) " + _sum.format("x").replace("ORDER BY z.score DESC, term LIMIT 10", "ORDER BY term LIMIT 20")))
register("doc_tokens", lambda spark, sf_dir: terms.doc_tokens(i := documents(spark, sf_dir), Search(i, Query("from AND than")).matches(), "text").select("unique_id", F.array_join("tokens", " ").alias("tokens")), f"WITH {TOKENS} SELECT unique_id, array_to_string(terms, ' ') AS tokens FROM d WHERE {has('from', 'than', joined=' AND ')}")
register("term_len_df_filter", analysed(terms.doc_terms, terms.AnalysisRequest("text", min_length=4, max_length=8, min_doc_freq=5, max_share=0.1)), sql_analysis("o AS (SELECT 1) SELECT * FROM y", "length(term) BETWEEN 4 AND 8 AND df >= 5 AND df <= round(n * 0.1)"))

# Analyzer chains (A1-A14) -----------------------------------------------------------------------------------------------


def chain(name: str, steps: list[str], sql: str, tokenizer: str = "STANDARD") -> None:
    """(term, tf) over all documents."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tokens = Analyzer(name, tokenizer, steps).column(F.array(F.coalesce("text", F.lit(""))))
        return table(spark, sf_dir, "documents").select(F.explode(tokens).alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("tf"))

    raw = f"list_transform(regexp_extract_all(text, '{SQL_WORD}'), lambda t: lower(t))"
    register(name, run, f"WITH r AS (SELECT text, {raw} AS raw FROM documents) SELECT term, count(*) AS tf FROM (SELECT unnest({sql.format(raw='raw')}) AS term FROM r) WHERE term IS NOT NULL GROUP BY term")


chain("analyzer_lowercase", ["LOWERCASE"], "{raw}")
chain("analyzer_stopwords", ["LOWERCASE", "STOPWORDS"], f"list_filter({{raw}}, lambda t: t NOT IN ({SQL_STOPS}))")
chain("analyzer_whitespace", [], "list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')", "WHITESPACE")
chain("analyzer_possessive", ["LOWERCASE", "ENGLISH_POSSESSIVE"], "list_transform({raw}, lambda t: regexp_replace(t, '[''’＇][sS]$', ''))")
chain("analyzer_concat_all", ["CONCAT_ALL"], "list_filter(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> ''), lambda t: regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda t: t <> '')", "WHITESPACE")
chain("analyzer_min_stem", ["LOWERCASE", "ENGLISH_MIN_STEM"], "list_transform({raw}, lambda t: CASE WHEN length(t) < 3 OR t NOT LIKE '%s' OR regexp_matches(t, '[us]s$') THEN t WHEN regexp_matches(t, '[^ae]ies$') THEN left(t, length(t) - 3) || 'y' WHEN regexp_matches(t, '[iaoe]es$') THEN t ELSE left(t, length(t) - 1) END)")
chain("analyzer_folding", ["LOWERCASE", "ASCII_FOLDING"], "list_transform({raw}, lambda t: replace(replace(replace(replace(strip_accents(t), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o'))")
chain("analyzer_shingle_2", ["LOWERCASE", "TWO_TWO_SHINGLE"], "list_transform(range(1, len({raw})), lambda i: {raw}[i] || ' ' || {raw}[i + 1])")
chain("analyzer_shingle_3", ["LOWERCASE", "THREE_THREE_SHINGLE"], "list_transform(range(1, len({raw}) - 1), lambda i: {raw}[i] || ' ' || {raw}[i + 1] || ' ' || {raw}[i + 2])")

chain("analyzer_uppercase", ["UPPERCASE"], "list_transform({raw}, lambda t: replace(replace(upper(t), 'ß', 'SS'), 'ẞ', 'SS'))")
for _n, _name in ((4, "FOUR_FOUR_SHINGLE"), (5, "FIVE_FIVE_SHINGLE")):
    chain(f"analyzer_shingle_{_n}", ["LOWERCASE", _name], "list_transform(range(1, len({raw}) - " + str(_n - 2) + "), lambda i: array_to_string(list_slice({raw}, i, i + " + str(_n - 1) + "), ' '))")

# Vectors (V1-V3) --------------------------------------------------------------------------------------------------------


def vectors(spark: SparkSession, sf_dir: str) -> Index:
    f = FieldConfig("embedding", "VECTOR", project_as=[Projection("bits", 64, 2)])
    return Index(IndexConfig("vectors", [f], unique_id="vec_id"), table(spark, sf_dir, "embeddings"))


def exact_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "embeddings")
    asked = docs.where("vec_id = 7").first()["embedding"]
    scored = docs.select(F.col("vec_id").cast("string").alias("unique_id"), vector.cosine(F.col("embedding"), F.lit(asked)).alias("score"))
    return scored.orderBy(F.desc("score"), "unique_id").limit(10).withColumn("score", F.round("score", 6))


register("cosine_topk_exact", exact_cosine, "SELECT vec_id::VARCHAR AS unique_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) DESC, unique_id LIMIT 10")


def superbit(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = vectors(spark, sf_dir)
    asked = index.docs.where("vec_id = 7").first()["embedding"]
    return hits(index, Query(amount=50).cosine("bits", asked, 0.3)).select("rank", "unique_id", "score")


register("superbit_candidates", superbit, None)


def minhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document whose id is divisible by 50, all documents that share at least 0.8 of its MinHash tokens (itself included)."""
    config = IndexConfig("near", [FieldConfig("text").index("lsh", "near")], unique_id="doc_id")
    return near_documents(Index(config, table(spark, sf_dir, "documents")), "near", F.col("doc_id") % 50 == 0)


register("minhash_neardup", minhash_near, None)

# Store, fetch, projection, ingest (S1-S20, P1-P5) -----------------------------------------------------------------------


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return store.latest(rows, ["user_id"], "ts", "event_id")


register("upsert_latest", upsert_latest, "SELECT user_id, ts, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def scratch(run: Callable[[SparkSession, str, str], DataFrame]) -> Run:
    """A query over a store of its own in the shared folder, deleted once the rows are read out."""

    def over(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{shared_folder(spark)}/store-{uuid4().hex}"
        out = run(spark, sf_dir, path).checkpoint(eager=True)
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        return out

    return over


def customers(spark: SparkSession, sf_dir: str, path: str) -> DocumentStore:
    """A store of all customers, those of nation 3 written twice."""
    made = DocumentStore(spark, path, "name string, nation int, balance double")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("unique_id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("int").alias("nation"), F.col("c_acctbal").alias("balance"))
    made.store(rows)
    made.store(rows.where("nation = 3").withColumn("name", F.concat(F.lit("again "), "name")))
    return made


def nation(spark: SparkSession, sf_dir: str, key: int) -> DataFrame:
    return table(spark, sf_dir, "customer").where(F.col("c_nationkey") == key).select(F.col("c_custkey").cast("string").alias("unique_id"))


@scratch
def store_upsert(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    return customers(spark, sf_dir, path).documents().select("unique_id", "name", "nation", "balance")


@scratch
def store_delete(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    made = customers(spark, sf_dir, path)
    made.delete(nation(spark, sf_dir, 7))
    return made.documents().select("unique_id", "name")


@scratch
def store_late_data(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """Stored, nation 7 deleted, compacted; then older rows of all come late: the deleted stay away, the others stay as they are."""
    made = DocumentStore(spark, path, "name string")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("unique_id"), F.col("c_name").alias("name"))
    made.store(rows.withColumn("ts", F.lit(100)), ts_col="ts")
    made.delete(nation(spark, sf_dir, 7))
    made.compact()
    made.store(rows.withColumn("name", F.lit("late")).withColumn("ts", F.lit(50)), ts_col="ts")
    return made.documents().select("unique_id", "ts", "name")


@scratch
def store_fetch(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """Every supplier's number asked for among the customers: found ones with two fields of the document."""
    asked = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 20).cast("string").alias("unique_id"))
    found = customers(spark, sf_dir, path).fetch(asked, include=["name", "nation"])
    return found.select("unique_id", "found", F.when(F.col("found"), F.to_json("document")).alias("document"))


@scratch
def store_batch_fetch(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    found = customers(spark, sf_dir, path).batch_fetch(["7", "nosuchid", "3", "7"])
    return found.select("place", "unique_id", "found", "document.name")


@scratch
def store_files(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """Two attachments for each part, one compressed; those of size 7 lose the plain one, and all of size 8 go."""
    made, parts_ = DocumentStore(spark, path, "name string"), table(spark, sf_dir, "part")
    of = lambda name, text, squeeze: parts_.select(F.col("p_partkey").cast("string").alias("unique_id"), F.lit(name).alias("filename"), F.col(text).cast("binary").alias("content"), F.lit(squeeze).alias("compressed"))
    made.store_files(of("name.txt", "p_name", False).unionByName(of("type.txt", "p_type", True)))
    ids = lambda size: parts_.where(F.col("p_size") == size).select(F.col("p_partkey").cast("string").alias("unique_id"))
    made.delete(ids(7), documents=False, files=False, filename="name.txt")
    made.delete(ids(8))
    made.compact()
    return made.files("FULL").select("unique_id", "filename", "compressed", F.col("content").cast("string").alias("content"))


@scratch
def store_cleared(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    made = customers(spark, sf_dir, path)
    made.clear()
    made.store(nation(spark, sf_dir, 5).withColumn("name", F.lit("new")))
    return made.documents().groupBy("name").agg(F.count("*").alias("n"))


_stored = "SELECT c_custkey::VARCHAR AS unique_id, CASE WHEN c_nationkey = 3 THEN 'again ' ELSE '' END || c_name AS name, c_nationkey::INT AS nation, c_acctbal AS balance FROM customer"
register("store_upsert", store_upsert, _stored)
register("store_delete", store_delete, f"SELECT unique_id, name FROM ({_stored}) WHERE nation <> 7")
register("store_late_data", store_late_data, "SELECT c_custkey::VARCHAR AS unique_id, 100::BIGINT AS ts, c_name AS name FROM customer WHERE c_nationkey <> 7")
register("store_fetch", store_fetch, "SELECT (s_suppkey * 20)::VARCHAR AS unique_id, c.unique_id IS NOT NULL AS found, CASE WHEN c.unique_id IS NOT NULL THEN '{\"name\":\"' || name || '\",\"nation\":' || nation || '}' END AS document FROM supplier LEFT JOIN (" + _stored + ") c ON c.unique_id = (s_suppkey * 20)::VARCHAR")
register("store_batch_fetch", store_batch_fetch, f"SELECT place::INT AS place, a.unique_id, c.unique_id IS NOT NULL AS found, name FROM (VALUES (0, '7'), (1, 'nosuchid'), (2, '3'), (3, '7')) a(place, unique_id) LEFT JOIN ({_stored}) c USING (unique_id)")
register("store_files", store_files, "SELECT p_partkey::VARCHAR AS unique_id, 'name.txt' AS filename, false AS compressed, p_name AS content FROM part WHERE p_size NOT IN (7, 8) UNION ALL SELECT p_partkey::VARCHAR, 'type.txt', true, p_type FROM part WHERE p_size <> 8")
register("store_cleared", store_cleared, "SELECT 'new' AS name, count(*) AS n FROM customer WHERE c_nationkey = 5")
register("delete_anti", lambda spark, sf_dir: table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey", "left_anti").select("c_custkey", "c_name"), "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")


def dotted_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k long"))
    docs = docs.withColumn("list", F.array(F.struct(F.col("p.k").alias("k"), F.col("user_id").alias("u")), F.struct(F.lit(None).cast("long").alias("k"), F.col("user_id").alias("u"))))
    return docs.select("event_id", extract(docs.schema, "p.k").alias("k"), F.to_json(extract(docs.schema, "list.k")).alias("ks"), extract(docs.schema, "p.nosuch.path").alias("missing"))


register("dotted_path", dotted_path, "SELECT event_id, (props->>'k')::BIGINT AS k, '[' || (props->>'k') || ']' AS ks, NULL::VARCHAR AS missing FROM events")
register("csv_documents", lambda spark, sf_dir: formats.csv_lines(parts(spark, sf_dir).docs, ["p_partkey", "p_name", "words", "p_size", "-p_size"]), "SELECT 'p_partkey,p_name,words' AS line UNION ALL SELECT p_partkey || ',\"' || p_name || '\",\"' || replace(p_name, ' ', ';') || '\"' FROM part")
register("json_results", lambda spark, sf_dir: formats.json_results(hits(orders(spark, sf_dir), Query(amount=5).sort("o_totalprice", True)).select("rank", "unique_id")), "SELECT '{\"rank\":' || row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey::VARCHAR) || ',\"unique_id\":\"' || o_orderkey || '\"}' AS json FROM orders ORDER BY o_totalprice DESC, o_orderkey::VARCHAR LIMIT 5")
register("facet_csv", lambda spark, sf_dir: formats.facet_csv(search_facets(documents(spark, sf_dir), Query().count("source", 5))), "SELECT 'facetName,facetKey,facetValue' AS line UNION ALL SELECT 'source,' || source || ',' || n FROM (SELECT source, count(*) AS n FROM documents WHERE source <> '' GROUP BY source ORDER BY n DESC, source LIMIT 5)")
register("terms_csv", lambda spark, sf_dir: formats.terms_csv(terms.terms(inverted(spark, sf_dir), terms.TermsRequest("text", start="de", end="dea"))), SQL_TERMS.replace("SELECT * FROM t", "SELECT 'term,termFreq,docFreq' AS line UNION ALL SELECT CASE WHEN term LIKE '% %' THEN '\"' || term || '\"' ELSE term END || ',' || term_freq || ',' || doc_freq FROM t WHERE term >= 'de' AND term < 'dea'"))


def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two indexes created, one updated, one deleted: what the catalog lists, and its settings."""
    catalog = Catalog(spark)
    shared_folder(spark)  # where the listing is kept
    for index in (orders(spark, sf_dir), parts(spark, sf_dir), flagged(spark, sf_dir)):
        catalog.create(replace(index.config, name=f"listed_{index.config.name}"), index.docs)
    catalog.update(replace(catalog.get("listed_parts").config, default_search_field="p_type"))
    catalog.delete("listed_flagged")
    out = catalog.listing().select("index_name", F.get_json_object("settings", "$.default_search_field").alias("field")).checkpoint(eager=True)
    catalog.delete("listed_orders")
    catalog.delete("listed_parts")
    return out


register("catalog_listing", catalog_listing, "SELECT 'listed_orders' AS index_name, '' AS field UNION ALL SELECT 'listed_parts', 'p_type'")
register("html_text_extract", lambda spark, sf_dir: formats.web_documents(table(spark, sf_dir, "pages")), None)


def highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents(spark, sf_dir)
    search = Search(index, Query("from OR than"))
    best = hits(index, Query("from OR than")).select(F.col("unique_id").cast("long").alias("doc_id"))
    return terms.highlight(search, index.docs.join(F.broadcast(best), "doc_id"), "text")  # ten ids


register("highlight", highlighted, None)
register("event_windows", lambda spark, sf_dir: counts_by_window(table(spark, sf_dir, "events"), "ts", "1 hour", "event_type").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "count"), "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS count FROM events GROUP BY ALL")
register("events_by_hour", lambda spark, sf_dir: table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").agg(F.count("*").alias("count")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "count"), "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS count FROM events GROUP BY ALL")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 top 10 of an OR query."""
    return hits(documents(spark, sf_dir), Query("from OR than")).select("rank", "unique_id", F.round("score", 6).alias("score"))


def queries() -> dict[str, Run]:
    return {name: run for name, (run, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOGUE.items() if sql}


__all__ = ["W", "flagship", "oracle_sql", "queries"]
