"""The search engine on small data with known answers."""

import base64
import io
import math
from dataclasses import dataclass
from datetime import datetime

import pytest

from lodestack.functions.analysis import SPELLINGS, Analyzer, built_in, load_spellings
from lodestack.functions.stemming import min_stem, porter2
from lodestack.functions.values import extract
from lodestack.operators import terms
from lodestack.operators.pool import WorkPool
from lodestack.operators.search import Catalog, FieldConfig, Index, IndexConfig, Query, ResultCache, Search, cursor, hits, hits_with_next, near_documents, or_query, search_facets
from lodestack.operators.store import LOG, DocumentStore
from lodestack.plans import parser as P
from lodestack.plans.config import ConfigError, from_schema
from lodestack.plans.parser import QueryError
from lodestack.sources import formats
from lodestack.sources.mapper import Mapper, saved
from lodestack.streaming.upsert import counts_by_window, latest_by_key, upsert_stream


def total(index, q, **o):
    return Search(index, Query(q, **o) if isinstance(q, str) else q).total().first()[0]


def ids(index, query):
    return [r["unique_id"] for r in hits(index, query).orderBy("rank").collect()]


@pytest.fixture(scope="module")
def journals(spark):
    rows = []
    for issn in ("1234-1234", "3333-1234", "1234-5555", "1234-4444", "2222-2222"):
        for i in range(10):
            day = datetime(2014, 10, 4) if i == 0 else datetime(2013, 9, 4) if i % 2 == 0 else datetime(2013, 8, 4)
            rows.append((f"myId-{len(rows) + 1}", issn, "Facet Userguide", "US" if i % 2 == 0 else "France", day, None))
    docs = spark.createDataFrame(rows, "unique_id string, issn string, title string, country string, date timestamp, keyword string")
    fields = [FieldConfig("issn").index("lcKeyword").facet(), FieldConfig("title").index("standard"), FieldConfig("country").index("lcKeyword").facet(), FieldConfig("date", "DATE").index().facet(), FieldConfig("keyword").index("lcKeyword").facet()]
    return Index(IndexConfig("journals", fields, default_search_field="title"), docs)


def test_facets_and_drill_down(journals):
    def facet(name, query):
        return {r["value"]: r["count"] for r in search_facets(journals, query.count(name)).collect()}

    assert facet("keyword", Query("title:userguide")) == {}
    assert total(journals, "title:userguide") == 50 and set(facet("issn", Query("title:userguide")).values()) == {10}
    assert facet("date", Query("userguide")) == {"2014-10-04": 5, "2013-09-04": 20, "2013-08-04": 25}
    for day, n in (("2014-10-04", 5), ("2013-09-04", 20), ("2013-08-04", 25)):
        assert total(journals, Query().drill("date", day)) == n
    assert total(journals, Query().drill("issn", "1234-1234")) == 10 and total(journals, Query().drill("issn", "1234-1234", "3333-1234")) == 20
    both = Query().drill("issn", "1234-1234").drill("country", "France")
    assert total(journals, both) == 5 and facet("issn", both) == {"1234-1234": 5}
    with pytest.raises(ConfigError, match="not defined as a facetable field"):
        search_facets(journals, Query().count("nosuch"))
    with pytest.raises(ConfigError):
        Query().count("issn", 10, segment_facets=5)


@pytest.fixture(scope="module")
def numbered(spark):
    docs = spark.createDataFrame([(f"someUniqueId-{i}", "1234-1234", "Distributed Search and Storage System", i, i % 2 == 0) for i in range(5)], "unique_id string, issn string, title string, an int, flag boolean")
    fields = [FieldConfig("issn").index("lcKeyword"), FieldConfig("title").index("standard"), FieldConfig("an", "NUMERIC_INT").index().sort(), FieldConfig("flag", "BOOL").index()]
    return Index(IndexConfig("numbered", fields, default_search_field="title", segments=16), docs)


def test_ranges_sorts_and_paging(numbered):
    assert [total(numbered, q) for q in ("an:3", "an:[1 TO 3]", "an:{1 TO 3}", "an:[2 TO *]", "an:x")] == [1, 3, 1, 3, 0]
    assert ids(numbered, Query("an:[1 TO 5]").sort("an"))[0] == "someUniqueId-1" and ids(numbered, Query("an:[1 TO 4]").sort("an", True))[0] == "someUniqueId-4"
    assert [total(numbered, q) for q in ("title:distributed", "distributed", "issn:1234-1234", "title:cluster", "flag:true", "flag:F")] == [5, 5, 5, 0, 3, 2]
    seen, after = [], None
    for amount, want in ((2, 2), (10, 3), (10, 0)):
        page = hits(numbered, Query("distributed", amount=amount, after=after).sort("an")).orderBy("rank").collect()
        assert len(page) == want
        seen += [r["unique_id"] for r in page]
        after = cursor(page[-1], Query().sort("an")) if page else after
    assert seen == [f"someUniqueId-{i}" for i in range(5)] and base64.b64decode(after)
    first = hits(numbered, Query("distributed", amount=2)).orderBy("rank").collect()
    assert ids(numbered, Query("distributed", amount=9, after=cursor(first[-1], Query()))) == [f"someUniqueId-{i}" for i in (2, 3, 4)]
    assert ids(numbered, Query("distributed", amount=2, start=3).sort("an")) == ["someUniqueId-3", "someUniqueId-4"]
    with pytest.raises(ConfigError, match="must have sortAs defined"):
        hits(numbered, Query().sort("title"))
    with pytest.raises(ConfigError, match="names no field"):
        total(Index(IndexConfig("x", []), numbered.docs), "word")
    cache = ResultCache()
    assert cache.get(numbered, Query("an:3")) is cache.get(numbered, Query("an:3")) and len(cache.kept) == 1


@pytest.fixture(scope="module")
def tiny(spark):
    docs = spark.createDataFrame([("a", ["red fox jumps", "over the lazy dog"], 1), ("b", ["red red fox"], 2), ("c", ["blue dog's fox-trot"], None)], "unique_id string, body array<string>, n int")
    return Index(IndexConfig("tiny", [FieldConfig("body").index("standard"), FieldConfig("n", "NUMERIC_INT").index().sort()], default_search_field="body"), docs)


def test_scores_by_hand(tiny):
    scores = {r["unique_id"]: r["score"] for r in hits(tiny, Query("red")).collect()}
    n, df, mean = 3, 2, (6 + 3 + 4) / 3
    want = lambda tf, size: math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))
    assert scores == {"a": pytest.approx(want(1, 6)), "b": pytest.approx(want(2, 3))}
    assert {r["unique_id"]: r["score"] for r in hits(tiny, Query("red^2").similar("*", "TF")).collect()} == {"a": 2.0, "b": 4.0}
    assert {r["unique_id"]: r["score"] for r in hits(tiny, Query("red").similar("body", "TFIDF")).collect()}["b"] == pytest.approx(math.sqrt(2) * (1 + math.log(4 / 3)) / math.sqrt(3))


def test_inverted_tables_answer_alike(spark, tiny, tmp_path):
    inverted = tiny.invert(str(tmp_path / "inverted"), "body")
    asked = ["red fox", "+red +dog", "red AND NOT dog", "-red", '"red fox"', '"fox over"', '"red jumps"~1', "ju*", "f?x", "/(lazy|blue)/", "bleu~1", "body:[blue TO fox}", "n:*", "-n:*", "*:*", "(red AND jumps) OR blue", "red^3 n:[2 TO *]", "nosuchword", '"the"', "red -n:1"]
    requests = [Query(q) for q in asked] + [Query("red jumps blue", mm=2), Query("red fox", default_and=True), Query("fox").filter("n:[2 TO *]"), Query("fox").score_also("red"), Query("fox").sort("n", True), Query("red fox").similar("*", "TFIDF"), Query("fox").filter("-dog").show("n"), Query("").fields("n")]
    for q in requests:
        get = lambda i: [(r["unique_id"], None if r["score"] is None else round(r["score"], 9)) for r in hits(i, q).orderBy("rank").collect()]  # noqa: B023, E731
        assert get(inverted) == get(tiny), q
        assert Search(inverted, q).total().first()[0] == Search(tiny, q).total().first()[0], q
    for r in (terms.TermsRequest("body"), terms.TermsRequest("body", start="f", end="s"), terms.TermsRequest("body", fuzzy="rad", edits=1)):
        assert terms.terms(inverted, r).collect() == terms.terms(tiny, r).collect()
    assert sorted(inverted.postings("body").collect()) == sorted(tiny.postings("body").collect())
    plan = hits(inverted, Query("red fox"))._jdf.queryExecution().toString()
    assert "EqualTo(term,red)" in plan and "Join" not in plan  # only the terms' postings are read
    empty = Index(tiny.config, tiny.docs.limit(0)).invert(str(tmp_path / "empty"), "body")
    assert hits(empty, Query("red")).count() == 0 and Search(empty, Query("-red")).total().first()[0] == 0


def test_text_queries(tiny):
    cases = {
        "red fox": "abc", "+red +dog": "a", "red AND NOT dog": "b", "-red": "c", '"red fox"': "ab", '"fox over"': "", '"lazy dog"': "a", '"red jumps"~1': "a", "ju*": "a", "f?x": "abc",
        "/(lazy|blue)/": "ac", "blu~1": "c", "bleu~1": "c", "body:[blue TO fox}": "ac", "n:*": "ab", "-n:*": "c", "*:*": "abc", "(red AND jumps) OR blue": "ac", "body:(lazy OR blue)": "ac", or_query("body", ["lazy", "blue"]): "ac", "dog's": "c",
    }
    for q, want in cases.items():
        assert sorted(ids(tiny, Query(q))) == list(want), q
    assert sorted(ids(tiny, Query("red jumps blue", mm=2))) == ["a"] and sorted(ids(tiny, Query("red fox", default_and=True))) == ["a", "b"]
    assert sorted(ids(tiny, Query("").fields("n"))) == ["a", "b"] and sorted(ids(tiny, Query("fox").filter("n:[2 TO *]"))) == ["b"]
    with pytest.raises(ConfigError, match="Invalid queryText field boost"):
        Query().fields("body^x")
    for bad in ("(red", "red)", "red AND", '"open', "a:[1 TO"):
        with pytest.raises(P.QueryError):
            P.parse(bad)


def test_or_holds_more_and_postings(tiny):
    assert set(ids(tiny, Query("red OR lazy"))) >= set(ids(tiny, Query("red"))) | set(ids(tiny, Query("lazy")))
    posted = {(r["unique_id"], r["term"]): list(r["positions"]) for r in tiny.postings("body").collect()}
    assert posted["b", "red"] == [0, 1] and posted["a", "over"] == [103] and posted["a", "dog"] == [106]
    assert {r["field"] for r in tiny.field_names().collect()} == {"body", "n"}


def test_terms_highlight_and_summary(tiny):
    found = {r["term"]: (r["doc_freq"], r["term_freq"]) for r in terms.terms(tiny, terms.TermsRequest("body", start="f", end="s")).collect()}
    assert found == {"fox": (3, 3), "jumps": (1, 1), "lazy": (1, 1), "over": (1, 1), "red": (2, 3)}
    search = Search(tiny, Query("red OR do*"))
    marked = {r["unique_id"]: list(r["fragments"]) for r in terms.highlight(search, search.matches(), "body", fragments=2).collect()}
    assert marked["b"] == ["<em>red</em> <em>red</em> fox"] and marked["a"] == ["<em>red</em> fox jumps", "over the lazy <em>dog</em>"]
    best = terms.summary_terms(tiny, search.matches(), terms.AnalysisRequest("body", top=1, sort="TF")).first()
    assert (best["term"], best["tf"]) in (("fox", 3), ("red", 3))


def test_analyzers_agree_on_both_sides(spark):
    texts = ["The Dogs' cities aren't ponies: cafés, naïve Straße wi-fi 4", "", "running happily nationalization hopping", "a b c d e f g"]
    chains = [*built_in().values(), Analyzer("porter", "STANDARD", ["LOWERCASE", "SNOWBALL_STEM"]), Analyzer("fold", "WHITESPACE", ["LOWERCASE", "ASCII_FOLDING", "ENGLISH_POSSESSIVE", "BRITISH_US"]), Analyzer("up", "WHITESPACE", ["UPPERCASE", "CONCAT_ALL"])]
    docs = spark.createDataFrame([(i, [t]) for i, t in enumerate(texts)], "i int, v array<string>")
    for chain in chains:
        got = {r["i"]: r["t"] for r in docs.select("i", chain.column(docs["v"]).alias("t")).collect()}
        for i, t in enumerate(texts):
            assert sorted(map(str, got[i])) == sorted(map(str, chain.tokens(t))), chain.name


def test_stemmers():
    assert [porter2(w) for w in ("running", "happily", "nationalization", "hopping", "hoped", "ponies", "ties", "skies", "generously", "knightly", "relational", "by")] == ["run", "happili", "nation", "hop", "hope", "poni", "tie", "sky", "generous", "knight", "relat", "by"]
    assert [min_stem(w) for w in ("cities", "dogs", "boss", "bus", "shoes", "is", "ties", "aies")] == ["city", "dog", "boss", "bus", "shoes", "is", "ty", "aies"]


def test_dotted_paths_and_schema(spark):
    schema = "field1 string, myfield int, field2 struct<subfield1: string, subfield2: struct<otherfield: string>>, thisfield array<struct<key1: string, key2: string>>"
    docs = spark.createDataFrame([("someVal", 40, ("val2", ("1",)), [("val1", "val2"), ("someval", None)])], schema)
    paths = {"field1": "someVal", "thisfield.key1": ["val1", "someval"], "thisfield.key2": ["val2"], "field2.subfield2.otherfield": "1", "field2.nosuch": None, "nosuch": None}
    row = docs.select(*(extract(docs.schema, p).alias(f"c{i}") for i, p in enumerate(paths))).first()
    assert list(row) == list(paths.values())
    config = from_schema("x", docs.schema, "field1")
    assert config.indexed("thisfield.key1") and IndexConfig.from_json(config.to_json()) == config


@dataclass
class Phone:
    type: str = saved(index="lcKeyword", facet=True)
    number: str = saved(index="standard")


@dataclass
class Person:
    id: str = saved(unique_id=True)
    firstName: str = saved(index={"firstName": "standard", "firstNameExact": "lcKeyword"}, facet=True)
    address: str = saved(index="standard", default_search=True)
    phoneNumbers: list[Phone] = saved()
    otherStuff: str = saved(keep=False)


def test_mapper(spark):
    people = [Person("001", "John", "444 White House Drive", [Phone("Mobile", "123-333-2222"), Phone("Home", "111-111-2222")], "x"), Person("002", "Bob", "111 Black River Drive", [Phone("Home", "222-222-2222")], "y")]
    mapper = Mapper(Person)
    index = Index(mapper.config("people"), mapper.frame(spark, people))
    assert [total(index, q) for q in ("firstName:Bob", "phoneNumbers.type:Mobile", "phoneNumbers.type:Home", "drive")] == [1, 1, 2, 2]
    back = mapper.from_dict(index.docs.where("id = '001'").first().asDict())
    assert back.phoneNumbers[0].type == "Mobile" and back.otherStuff is None
    assert mapper.from_dict({"id": "3", "phoneNumbers": {"type": "a", "number": "b"}}).phoneNumbers[0].number == "b"
    with pytest.raises(ConfigError):
        mapper.from_dict({"id": ["1", "2"]})


def test_store(spark, tmp_path):
    store = DocumentStore(spark, f"{tmp_path}/s", "title string, n int")
    make = lambda rows: spark.createDataFrame(rows, "unique_id string, title string, n int")
    store.store(make([(f"id-{i}", "old", i) for i in range(5)]))
    store.store(make([(f"id-{i}", "new", i) for i in range(5)]))
    assert {(r["unique_id"], r["title"]) for r in store.documents().collect()} == {(f"id-{i}", "new") for i in range(5)}
    store.store_files(spark.createDataFrame([("id-3", n, b, c) for n, b, c in (("myfile", b"Some Text", True), ("myfile2", b"Other", False), ("filef", b"Other", True))], "unique_id string, filename string, content binary, compressed boolean"))
    full = {r["filename"]: bytes(r["content"]) for r in store.files("FULL").collect()}
    assert full == {"myfile": b"Some Text", "myfile2": b"Other", "filef": b"Other"} and "content" not in store.files().columns
    id3 = spark.createDataFrame([("id-3",)], "unique_id string")
    store.delete(id3, documents=False, files=False, filename="myfile2")
    assert store.files().count() == 2
    got = store.batch_fetch(["id-3", "nosuch", "id-1"], include=["title"]).collect()
    assert [(r["unique_id"], r["found"], r["document"] and r["document"]["title"]) for r in got] == [("id-3", True, "new"), ("nosuch", False, None), ("id-1", True, "new")]
    store.compact()
    assert store.documents().count() == 5 and store.files().count() == 2
    store.delete(id3)
    assert store.documents().count() == 4 and store.files().count() == 0
    store.clear()
    assert store.documents().count() == 0


def test_store_keeps_deletions_and_batches_written_meanwhile(spark, tmp_path):
    store = DocumentStore(spark, f"{tmp_path}/s", "title string")
    make = lambda i, title, ts: spark.createDataFrame([(i, title, ts)], "unique_id string, title string, ts long")
    titles = lambda: {(r["unique_id"], r["title"]) for r in store.documents().collect()}
    one = lambda i: spark.createDataFrame([(i,)], "unique_id string")
    store.store(make("b", "first", 100), ts_col="ts")
    store.delete(one("b"))
    store.compact()
    store.store(make("b", "late", 50), ts_col="ts")
    assert titles() == set()
    store.store(make("b", "newer", 101), ts_col="ts")
    states = {store.state()}
    live = store._live("log")  # what a compaction begins with; a batch comes before it ends
    store.store(make("c", "meanwhile", 1), ts_col="ts")
    store._switch("log", live, store._read("log", LOG, live))
    assert titles() == {("b", "newer"), ("c", "meanwhile")}
    states.add(store.state())
    for _ in range(3):
        store.compact()
        states.add(store.state())
        assert titles() == {("b", "newer"), ("c", "meanwhile")}
    assert len(states) >= 4 and len(store._names("log")) <= 3  # what was replaced long ago is gone
    store.clear()
    assert titles() == set()


def test_large_attachments_in_chunks(spark, tmp_path):
    store = DocumentStore(spark, f"{tmp_path}/s", "title string")
    content = bytes(range(256)) * 500
    assert store.store_large("a", "big", io.BytesIO(content), chunk=1000) == len(content)
    store.store_large("a", "other", io.BytesIO(b""), chunk=1000)
    assert b"".join(store.fetch_large("a", "big")) == content and list(store.fetch_large("a", "other")) == list(store.fetch_large("b", "big")) == []
    store.store_large("a", "big", io.BytesIO(content[:2500]), chunk=1000)
    store.compact()
    assert [len(x) for x in store.fetch_large("a", "big")] == [1000, 1000, 500]
    assert {(r["filename"], r["chunks"]) for r in store.large_files().collect()} == {("big", 3), ("other", 0)}
    store.delete(spark.createDataFrame([("a",)], "unique_id string"))
    assert store.large_files().count() == 0


def test_results_of_a_changed_store_are_not_answered_from_before(spark, tmp_path):
    store = DocumentStore(spark, f"{tmp_path}/s", "title string")
    make = lambda rows: spark.createDataFrame(rows, "unique_id string, title string")
    store.store(make([("a", "red fox")]))
    index, cache = Index.of_store(IndexConfig("s", [FieldConfig("title").index("standard").facet()], default_search_field="title"), store), ResultCache()
    found = lambda: {r["unique_id"] for r in cache.get(index, Query("red"))}
    assert found() == {"a"} and found() == {"a"} and len(cache.kept) == 1
    store.store(make([("b", "red dog")]))
    assert found() == {"a", "b"} and {r["value"]: r["count"] for r in search_facets(index, Query("red").count("title")).collect()} == {"red fox": 1, "red dog": 1}
    plain = Index(index.config, make([("x", "red")]))
    assert [r["unique_id"] for r in cache.get(plain, Query("red"))] == ["x"]
    plain.docs = make([("y", "red")])
    assert [r["unique_id"] for r in cache.get(plain, Query("red"))] == ["y"]


def test_commands_beside_one_another(spark, tiny, tmp_path):
    store = DocumentStore(spark, f"{tmp_path}/s", "title string")
    with WorkPool(spark, 4) as pool:
        pool.store(store, spark.createDataFrame([("a", "one"), ("b", "two")], "unique_id string, title string")).result(120)
        asked = [pool.query(tiny, Query(q)) for q in ("red", "blue", "nosuchword")]
        fetched = pool.batch_fetch(store, ["b", "c"])
        assert [[r["unique_id"] for r in f.result(120)] for f in asked] == [["b", "a"], ["c"], []]
        assert [(r["unique_id"], r["found"]) for r in fetched.result(120)] == [("b", True), ("c", False)]
        pool.delete(store, spark.createDataFrame([("a",)], "unique_id string")).result(120)
        assert store.documents().count() == 1
        with pytest.raises(QueryError):
            pool.query(tiny, Query("(red")).result(120)


def test_pages_tell_whether_more_follows(numbered):
    page = lambda **o: [(r["unique_id"], r["has_more"]) for r in hits_with_next(numbered, Query("distributed", **o).sort("an")).orderBy("rank").collect()]
    assert page(amount=2) == [("someUniqueId-0", True), ("someUniqueId-1", True)] and page(amount=2, start=3) == [("someUniqueId-3", False), ("someUniqueId-4", False)]
    assert page(amount=5)[-1] == ("someUniqueId-4", False) and page(amount=5, start=5) == []
    assert hits(numbered, Query("distributed", amount=0)).collect() == [] and hits(numbered, Query("distributed", amount=0).sort("an")).columns == hits(numbered, Query("distributed").sort("an")).columns


def test_clauses_without_terms_are_as_if_not_there(tiny):
    cases = {"red AND the": "ab", "+the red": "ab", "the": "", "red -the": "ab", "-the": "", "+the -red": "c", '"the of"': "", "(the OR of) blue": "c", "the^3 OR blue": "c", "body:the AND body:blue": "c", "the NOT red": "c"}
    for q, want in cases.items():
        assert sorted(ids(tiny, Query(q))) == list(want), q
    assert sorted(ids(tiny, Query('red "the"', default_and=True))) == ["a", "b"] and ids(tiny, Query("blue OR the", mm=2)) == []


def test_tokens_by_hand(spark):
    want = {
        "Don't stop": ["Don't", "stop"], "O’Neil's 3.14 a_b": ["O’Neil's", "3.14", "a_b"], "wi-fi e.g. x.": ["wi", "fi", "e.g", "x"], "漢字とkana": ["漢", "字", "と", "kana"], "abc漢字 def": ["abc", "漢", "字", "def"], "カタカナ 한국어": ["カタカナ", "한국어"],
        "cafe\u0301 naïve": ["cafe\u0301", "naïve"], "a'b'c ''d": ["a'b'c", "d"], "": [], "1,5 $20": ["1", "5", "20"], "x" * 256 + " y": ["y"],
    }
    chain = Analyzer("plain", "STANDARD")
    docs = spark.createDataFrame([(t, [t]) for t in want], "t string, v array<string>")
    assert {r["t"]: r["x"] for r in docs.select("t", chain.column(docs["v"]).alias("x")).collect()} == want
    assert {t: chain.tokens(t) for t in want} == want
    assert Analyzer("stops", "STANDARD", ["LOWERCASE", "STOPWORDS"]).tokens("The cat IS on it") == [None, "cat", None, None, None]


def test_query_handling_is_kept_with_the_settings():
    config = IndexConfig("x", [FieldConfig("a").index("near")], analyzers={"near": Analyzer("near", "STANDARD", ["MINHASH"], query_handling="MINHASH_QUERY")})
    assert IndexConfig.from_json(config.to_json()).analyzer("near").query_handling == "MINHASH_QUERY"
    with pytest.raises(ValueError, match="unknown query handling"):
        Analyzer("near", query_handling="OTHER")


def test_near_documents_are_what_mm_finds(spark, tmp_path):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen".split()
    texts = [" ".join(base), " ".join(base), " ".join([*base, "nineteen"]), " ".join(reversed(base)), "too short", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = Index(IndexConfig("near", [FieldConfig("text").index("lsh", "near")], unique_id="doc_id", default_search_field="near"), docs)
    got = {(r["query_id"], r["unique_id"]): r["likeness"] for r in near_documents(index, "near", docs["doc_id"] >= 0, 0.5).collect()}
    inverted = index.invert(str(tmp_path / "near"), "near")
    for i, text in enumerate(texts):
        n = len(index.config.analyzer("lsh").tokens(text))
        query = Query(text, mm=math.ceil(n / 2), amount=100)
        assert {b for a, b in got if a == str(i)} == (set(ids(index, query)) if n else set()), text
        if i == 2:
            score = lambda of: [(r["unique_id"], r["score"]) for r in hits(of, query).orderBy("rank").collect()]  # noqa: B023, E731
            assert score(index) == score(inverted) and score(index)[0] == ("2", 512.0)
            assert {(a, b): x for (a, b), x in got.items() if a == "2"} == {("2", b): x / 512 for b, x in score(index)}
    assert got["0", "1"] == 1.0 and got["0", "2"] < 1.0


def test_spellings_from_a_file(spark, tmp_path):
    chain = Analyzer("us", "STANDARD", ["LOWERCASE", "BRITISH_US"])
    assert chain.tokens("Aluminium colour") == ["aluminium", "color"]
    (tmp_path / "uk.txt").write_text("UK\tUS\naluminium\taluminum\n")
    load_spellings(str(tmp_path / "uk.txt"))
    docs = spark.createDataFrame([(["Aluminium colour"],)], "v array<string>")
    assert chain.tokens("Aluminium colour") == docs.select(chain.column(docs["v"])).first()[0] == ["aluminum", "color"]
    del SPELLINGS["aluminium"]


def test_several_facets_take_one_pass(journals):
    query = Query("userguide").count("issn", 2).count("country", 0)
    rows = search_facets(journals, query).collect()
    assert [(r["facet"], r["value"], r["count"]) for r in rows if r["facet"] == "issn"] == [("issn", "1234-1234", 10), ("issn", "1234-4444", 10)]
    assert {(r["value"], r["count"]) for r in rows if r["facet"] == "country"} == {("US", 25), ("France", 25)}
    assert {(r["max_error"], r["possible_missing"], r["max_value_possible_missing"]) for r in rows} == {(0, False, 0)}
    plan = search_facets(journals, query)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Union" not in plan


def test_catalog_builds_inverted_tables(spark, tiny, tmp_path):
    catalog = Catalog(spark)
    index = catalog.create(tiny.config, tiny.docs, invert=str(tmp_path))
    assert index.inverted and ids(index, Query("red")) == ids(tiny, Query("red"))
    frequencies = lambda i: sorted((r["term"], r["df"]) for r in terms.doc_terms(i, Search(i, Query("red")).matches(), terms.AnalysisRequest("body")).collect())
    assert frequencies(index) == frequencies(tiny)
    catalog.delete("tiny")


def test_streams(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.createDataFrame([("a", "one", 1), ("b", "two", 1)], "unique_id string, title string, ts long").write.parquet(source)
    spark.createDataFrame([("a", "three", 2), ("a", "late", 0)], "unique_id string, title string, ts long").write.mode("append").parquet(source)
    store = DocumentStore(spark, f"{tmp_path}/s", "title string")
    stream = spark.readStream.schema("unique_id string, title string, ts long").option("maxFilesPerTrigger", 1).parquet(source)
    upsert_stream(stream, store, f"{tmp_path}/c", ts_col="ts").awaitTermination(120)
    assert {(r["unique_id"], r["title"]) for r in store.documents().collect()} == {("a", "three"), ("b", "two")}
    assert latest_by_key(stream, "unique_id", "ts").isStreaming
    events = spark.createDataFrame([(datetime(2024, 1, 1, 0, m), "x") for m in (1, 2, 11)], "ts timestamp, kind string")
    assert {r["count"] for r in counts_by_window(events, "ts", "10 minutes", "kind").collect()} == {1, 2}


def test_catalog_sinks_and_several_indexes(spark, tiny, numbered, tmp_path):
    catalog = Catalog(spark)
    catalog.create(tiny.config, tiny.docs)
    with pytest.raises(ConfigError, match="exists already"):
        catalog.create(tiny.config, tiny.docs)
    assert [r["index_name"] for r in catalog.listing().collect()] == ["tiny"] and catalog.members().count() >= 1
    catalog.delete("tiny")
    with pytest.raises(ConfigError, match="does not exist"):
        catalog.get("tiny")
    other = Index(IndexConfig("other", [FieldConfig("an", "NUMERIC_INT").index("keyword", "n").sort(name="n")]), numbered.docs)
    assert [r["unique_id"] for r in hits([tiny, other], Query("n:[2 TO 3]").sort("n")).orderBy("rank").collect()] == ["b", "someUniqueId-2", "someUniqueId-3"]
    lines = [r["line"] for r in formats.csv_lines(tiny.docs, ["unique_id", "body", "n", "-n"]).collect()]
    assert lines[0] == "unique_id,body" and 'a,"red fox jumps;over the lazy dog"' in lines
    formats.write_csv(tiny.docs, ["unique_id", "body"], f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 3
    page = hits(tiny, Query("red"))
    assert '"totalHits": 2' in formats.response_json(page, 2)
    (tmp_path / "w.xml").write_text("<mediawiki><page><title>A</title><ns>0</ns><id>1</id><revision><id>9</id><text>Hello</text></revision></page><page><title>B</title><id>2</id><redirect title='A'/></page></mediawiki>")
    assert [(r["id"], r["text"]) for r in formats.wiki_pages(spark, str(tmp_path / "w.xml")).collect()] == [(1, "Hello")]
    web = spark.createDataFrame([("u", "<title>T &amp; t</title><script>x</script><p>a</p>b")], "url string, html string")
    assert formats.web_documents(web).first()[1:] == ("T & t", "a b")
