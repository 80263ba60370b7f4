"""Readers (XML, web pages, files) and writers (JSON, CSV) of documents, facets and terms."""

from __future__ import annotations

from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Readers ----------------------------------------------------------------------------------------------------------------


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One row for each element ``row_tag``."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a wiki dump with their first revision; redirects are left out."""
    schema = "id long, ns int, title string, redirect struct<_title: string>, revision array<struct<id: long, timestamp: timestamp, contributor: struct<username: string, id: long>, text: string>>"
    first = F.col("revision")[0]
    return read_xml(spark, path, "page", schema).where("redirect is null").select("id", "title", F.col("ns").alias("namespace"), first["text"].alias("text"), first["id"].alias("revision"), first["contributor"]["id"].alias("user_id"), first["contributor"]["username"].alias("user"), first["timestamp"].alias("revision_date"))


class _Visible(HTMLParser):
    """Visible text and title."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text, self.title, self.inside = [], [], None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.inside = tag

    def handle_endtag(self, tag):
        if tag == self.inside:
            self.inside = None

    def handle_data(self, data):
        if self.inside == "title":
            self.title.append(data)
        elif self.inside is None:
            self.text.append(data)


def web_documents(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """url, title, text (all visible text, white space as one space) of raw web pages."""

    @F.pandas_udf("struct<title:string,text:string>")
    def read(raw: pd.Series) -> pd.DataFrame:
        out = []
        for page in raw:
            parser = _Visible()
            parser.feed(page or "")
            parser.close()
            out.append((" ".join(unescape("".join(parser.title)).split()), " ".join(" ".join(parser.text).split())))
        return pd.DataFrame(out, columns=["title", "text"])

    return pages.select(F.col(url).alias("url"), read(html).alias("r")).select("url", "r.title", "r.text")


def read_attachments(spark: SparkSession, path: str, id_col: Column | None = None) -> DataFrame:
    """unique_id, filename, content of the files under ``path``; the id is the folder's name unless given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    return files.select((id_col if id_col is not None else F.element_at(parts, -2)).alias("unique_id"), F.element_at(parts, -1).alias("filename"), "content")


# Writers ----------------------------------------------------------------------------------------------------------------


def json_results(hits: DataFrame) -> DataFrame:
    """One JSON text for each hit."""
    return hits.select(F.to_json(F.struct(*hits.columns), {"ignoreNullFields": "false"}).alias("json"))


def response_json(hits: DataFrame, total: int, facets: DataFrame | None = None, cursor: str | None = None) -> str:
    """A whole answer (one page of hits and its facets) as one JSON text."""
    import json

    out = {"totalHits": total, "results": [json.loads(r["json"]) for r in json_results(hits.orderBy("rank")).collect()]}
    if cursor:
        out["cursor"] = cursor
    if facets is not None:
        names: dict[str, list] = {}
        for r in facets.collect():
            names.setdefault(r["facet"], []).append({"label": r["value"], "count": r["count"], "maxError": r["max_error"]})
        out["facets"] = [{"field": k, "values": v} for k, v in names.items()]
    return json.dumps(out)


def _quoted(text: Column, always: bool = False) -> Column:
    escaped = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return escaped if always else F.when(text.rlike('[, "\n\r]'), escaped).otherwise(text)


def csv_lines(docs: DataFrame, columns: list[str], header: bool = True) -> DataFrame:
    """Documents as CSV lines: lists joined by ; inside quotes, nested documents as JSON, ``-name`` in columns left out."""
    names = [c for c in columns if not c.startswith("-") and f"-{c}" not in columns]
    cells = []
    for n in names:
        kind, col = docs.schema[n].dataType, F.col(f"`{n}`")
        if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StructType, T.MapType, T.ArrayType)):
            cell = F.when(col.isNotNull(), _quoted(F.concat_ws(";", col.cast("array<string>")), always=True))
        elif isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
            cell = _quoted(F.to_json(col))
        else:
            cell = _quoted(col.cast("string"))
        cells.append(F.coalesce(cell, F.lit("")))
    lines = docs.select(F.concat_ws(",", *cells).alias("line"))
    return docs.sparkSession.createDataFrame([(",".join(names),)], "line string").unionByName(lines) if header else lines


def write_csv(docs: DataFrame, columns: list[str], path: str) -> None:
    """The whole match set, in parallel; every part begins with the header."""
    names = [c for c in columns if not c.startswith("-") and f"-{c}" not in columns]
    flat = docs.select(*(F.concat_ws(";", F.col(n).cast("array<string>")).alias(n) if isinstance(docs.schema[n].dataType, T.ArrayType) and not isinstance(docs.schema[n].dataType.elementType, (T.StructType, T.MapType)) else F.to_json(n).alias(n) if isinstance(docs.schema[n].dataType, (T.StructType, T.MapType, T.ArrayType)) else F.col(n) for n in names))
    flat.write.option("header", True).option("escape", '"').csv(path)


def facet_csv(facets: DataFrame) -> DataFrame:
    """facetName,facetKey,facetValue lines."""
    head = facets.sparkSession.createDataFrame([("facetName,facetKey,facetValue",)], "line string")
    return head.unionByName(facets.select(F.concat_ws(",", "facet", _quoted(F.col("value")), F.col("count").cast("string")).alias("line")))


def terms_csv(terms: DataFrame) -> DataFrame:
    """term,termFreq,docFreq and score, if the scan has one."""
    names = ["term", "term_freq", "doc_freq"] + (["score"] if "score" in terms.columns else [])
    head = terms.sparkSession.createDataFrame([(",".join(["term", "termFreq", "docFreq", "score"][: len(names)]),)], "line string")
    return head.unionByName(terms.select(F.concat_ws(",", *(_quoted(F.col(n).cast("string")) for n in names)).alias("line")))
