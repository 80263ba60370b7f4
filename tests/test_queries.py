"""Every registered query of the search engine against its SQL."""

import os

import duckdb
import pytest

from lodestack import queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    return c


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(repr([None if x is None or x != x else round(float(x), 6) if isinstance(x, float) else str(x) for x in row]) for row in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, name):
    got = queries.queries()[name](spark, SMALL).toPandas()
    sql = queries.oracle_sql().get(name)
    if sql:
        want = con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["rank", "unique_id", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_top_k_is_one_pass_without_a_full_sort(spark):
    plan = queries.queries()["bm25_topk"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = queries.queries()["numeric_range_inclusive"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_totalprice,100000" in plan


def test_minhash_asks_for_a_set_of_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id <> 8")
    copies = docs.where("doc_id = 50").selectExpr("doc_id + 100000 as doc_id", "text", "lang", "source", "n_chars")
    docs.unionByName(copies).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["query_id"], r["unique_id"]): r["likeness"] for r in queries.queries()["minhash_neardup"](spark, str(tmp_path)).collect()}
    some = {r["doc_id"]: r["text"] for r in docs.unionByName(copies).collect()}
    of = lambda t: set(minhash_tokens_of(t))
    have = {i: of(t) for i, t in some.items()}
    want = {(str(q), str(i)): len(have[q] & have[i]) / 512 for q in have if q % 50 == 0 for i in have if len(have[q] & have[i]) >= 0.8 * 512}
    assert got == want and ("50", "100050") in got


def minhash_tokens_of(text):
    from lodestack.plans.config import FieldConfig, IndexConfig

    return IndexConfig("near", [FieldConfig("text").index("lsh", "near")], unique_id="doc_id").analyzer("lsh").tokens(text)
