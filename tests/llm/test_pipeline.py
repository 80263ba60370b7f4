"""The pipeline on small tables: every stage against what its operator decides, on its own input."""

import os
import re

import numpy as np
from pyspark.sql import functions as F
from test_operators import brute_dedup, brute_mix, brute_quality, brute_spans

import corpus_pipeline as P
from lodestack.llm import bpe_stream, mixing, quality, secrets, simhash_dedup
from lodestack.llm.common import checkpoint_dir, vocabulary_path


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = (docs, after)
        docs = after
    for name, (before, after) in kept.items():
        assert after.columns[:5] == before.columns and (name == "tokens" or after.columns == before.columns)

    before, after = kept["quality"]
    good = {r["doc_id"] for r in rows(quality.scores(before, spark.read.parquet(f"{small}/labels.parquet"))) if r["predicted"]}
    assert sorted(r["doc_id"] for r in rows(after)) == sorted(good)

    before, after = kept["near_duplicates"]
    assert sorted(r["doc_id"] for r in rows(after)) == sorted({r["component_id"] for r in rows(simhash_dedup.duplicates(before))})

    before, after = kept["secrets"]
    spans, text = {r["doc_id"]: r["spans"] for r in rows(secrets.scan(before))}, {r["doc_id"]: r["text"] for r in rows(before)}
    for r in rows(after):
        out, end = "", 0
        for s in (x.split(":") for x in spans[r["doc_id"]].split(",") if x):
            if int(s[1]) >= end:
                out += text[r["doc_id"]][end : int(s[1])] + "[secret]"
            end = max(end, int(s[2]))
        assert r["text"] == out + text[r["doc_id"]][end:] and r["n_chars"] == len(r["text"])

    before, after = kept["mix"]
    times = {r["doc_id"]: round(r["taken"] / r["size"]) for r in rows(mixing.mix(before, whole=True)) if r["size"]}
    assert sorted(r["doc_id"] for r in rows(after)) == sorted(i for i, n in times.items() for _ in range(n))

    before, after = kept["tokens"]
    encoder = bpe_stream.Encoder(vocabulary_path())
    assert after.count() == before.count()
    assert all(np.array(r["token_ids"], "<u4").tobytes() == b"".join(encoder.encode(r["text"])) for r in rows(after))


def test_stages_against_brute_force(spark, small, documents, odd):
    """Every stage on its own input, of plain and of odd rows, against a plain computation."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    library.no_truncation()
    library.no_padding()
    labels = rows(spark.read.parquet(f"{small}/labels.parquet"))
    mixed = documents.limit(120).unionByName(odd.select("doc_id", "text", "source", "lang", "n_chars").where("doc_id is null or doc_id <> 6").withColumn("doc_id", F.col("doc_id") + 10_000))
    for docs in (documents, mixed):
        stages = dict(P.STAGES)
        table = rows(docs)
        key = lambda r: (str(r["doc_id"]), r["text"] or "", str(r["source"]))

        scored = brute_quality(table, labels)
        assert sorted(map(key, rows(stages["quality"](spark, docs, small)))) == sorted(key(r) for r, s in zip(table, scored, strict=True) if s >= 0.3)

        components = {}
        for i, _, c in brute_dedup(table):
            components.setdefault(c, set()).add(i)
        kept = [str(r["doc_id"]) for r in rows(stages["near_duplicates"](spark, docs, small))]
        assert len(kept) == len(components) and all(sum(i == c for i in kept) == 1 for c in components if c != "None")

        found = {key(r): r for r in rows(secrets.scan(docs).join(docs.select("doc_id", "text", "source").distinct(), "doc_id", "left"))}
        for r in rows(stages["secrets"](spark, docs, small)):
            if r["text"] is not None:
                assert not brute_spans(r["text"].replace("[secret]", " "))
        clean = {str(r["doc_id"]): r["text"] for r in rows(stages["secrets"](spark, docs, small))}
        for r in table:
            spans = brute_spans(r["text"] or "")
            if r["doc_id"] is not None and "random" not in str(found.get(key(r), {"spans": "random"})["spans"]):
                out, end = "", 0
                for begin, _, name, _ in spans:
                    if begin >= end:
                        out += r["text"][end:begin] + "[secret]"
                    end = max(end, int(name.split(":")[2]))
                assert clean[str(r["doc_id"])] == (r["text"] if not spans else out + r["text"][end:])

        times = {}
        for r, _, taken in brute_mix(table, True):
            n = len((r["text"] or "").split())
            times[key(r)] = times.get(key(r), 0) + (round(taken / n) if n and len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) == n else 0)
        got = {}
        for r in rows(stages["mix"](spark, docs, small)):
            got[key(r)] = got.get(key(r), 0) + 1
        assert {k: n for k, n in got.items() if times[k]} == {k: n for k, n in times.items() if n}

        for r in rows(stages["tokens"](spark, docs, small)):
            assert r["token_ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids


def test_folders_of_earlier_stages_go(spark, small):
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert P.run(spark, small).count() > 0
    mine = [x for x in set(os.listdir(folder)) - before if x.startswith("pipeline-")]
    assert [os.listdir(f"{folder}/{x}") for x in mine] == [["4-tokens"]]


def test_repeated_rows_and_rows_without_id(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    some = docs.limit(1)
    copies = some.selectExpr("doc_id", "text", "lang", "source", "n_chars", "explode(sequence(1, 50))").drop("col")
    lost = some.selectExpr("cast(null as long) doc_id", "'no words like these ' || text text", "lang", "source", "n_chars", "explode(sequence(1, 50))").drop("col")
    full = docs.unionByName(copies).unionByName(lost)
    left = [r["doc_id"] for r in rows(P.dedup_stage(spark, full, small))]
    assert len(left) == len(set(left))  # one row of each id, one of the copies without id at most
    assert len(left) == len({(r["component_id"]) for r in rows(simhash_dedup.duplicates(full))})

    odd = spark.createDataFrame([(None if i % 2 else 7, " ".join(["w"] * (i + 1)), "abc"[i % 3], "en", 1) for i in range(90)], "doc_id long, text string, source string, lang string, n_chars int")
    goal, biggest = {r["source_size"]: r["target"] for r in rows(mixing.mix(odd))}, 90
    words = {}
    for r in rows(mixing.mixed_documents(odd)):
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
    size = {s: sum(i + 1 for i in range(90) if "abc"[i % 3] == s) for s in "abc"}
    assert all(abs(words[s] - goal[size[s]]) <= biggest for s in "abc")


def test_run_on_odd_tables(spark, small, odd, nothing, tmp_path):
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{tmp_path}/a/labels.parquet")
    odd.write.parquet(f"{tmp_path}/a/documents.parquet")
    assert P.run(spark, f"{tmp_path}/a").columns == [*odd.columns, "token_ids"]
    spark.read.parquet(f"{small}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/b/labels.parquet")
    nothing.write.parquet(f"{tmp_path}/b/documents.parquet")
    assert P.run(spark, f"{tmp_path}/b").count() == 0
