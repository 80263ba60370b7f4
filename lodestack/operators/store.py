"""A document store on Parquet: upsert, delete, fetch, attachments. Every change is an appended batch; readers take the last one.

Layout of the store's folder: ``log/`` holds rows (unique_id, ts, seq, op, meta, doc as JSON), ``files/`` those of attachments,
``large/`` those of attachments in chunks. Below each, a batch is a folder ``b...``, put in place by one rename, and ``compact``
writes the latest rows as a generation ``g...`` that lists the batches it has taken in. Readers take the last generation and the
batches that it does not list, so a batch written while ``compact`` runs is not lost, and a failed job leaves nothing visible.
Deletions are kept as rows, also by ``compact``, so that an older row that arrives late does not bring a document back. Batches and
generations that nobody lists as live go at the second ``compact`` after, when readers that began before it are done.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.config import ConfigError

LOG = T.StructType([T.StructField("unique_id", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("meta", T.MapType(T.StringType(), T.StringType())), T.StructField("doc", T.StringType())])
FILES = T.StructType([T.StructField("unique_id", T.StringType()), T.StructField("filename", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("meta", T.MapType(T.StringType(), T.StringType())), T.StructField("compressed", T.BooleanType()), T.StructField("content", T.BinaryType())])


LARGE = T.StructType([T.StructField("unique_id", T.StringType()), T.StructField("filename", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("place", T.LongType()), T.StructField("content", T.BinaryType())])
#: Bytes of a chunk of a large attachment, and chunks written at a time.
CHUNK, CHUNKS = 1 << 20, 16


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a private one only where it is unset and Spark runs in one process."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not context.master.startswith("local"):
                raise ConfigError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            import tempfile

            where = tempfile.mkdtemp(prefix="lodestack-shared-")
        context.setCheckpointDir(where)
    return str(context._jsc.sc().getCheckpointDir().get())


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row with the greatest ``order`` of each key: one aggregate, combined before the shuffle, no sort of a key's rows."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, *(F.col("_best")[c].alias(c) for c in rest))


@F.pandas_udf(T.BinaryType())
def deflate(content: pd.Series) -> pd.Series:
    import zlib

    return content.map(lambda c: None if c is None else zlib.compress(c))


@F.pandas_udf(T.BinaryType())
def inflate(content: pd.Series) -> pd.Series:
    import zlib

    return content.map(lambda c: None if c is None else zlib.decompress(c))


class DocumentStore:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str):
        """``schema``: the stored documents'; unknown keys are kept in the JSON and come back with ``fetch(raw=True)``."""
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self._seq = time.time_ns()

    def _next(self) -> int:
        self._seq = max(self._seq + 1, time.time_ns())
        return self._seq

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p, jvm

    def _names(self, kind: str) -> list[str]:
        fs, p, _ = self._fs(f"{self.path}/{kind}")
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _listed(self, kind: str, generation: str) -> list[str]:
        """Batches that a generation has taken in."""
        fs, p, jvm = self._fs(f"{self.path}/{kind}/{generation}/_batches")
        stream = fs.open(p)
        try:
            return [x for x in jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n") if x]
        finally:
            stream.close()

    def _live(self, kind: str) -> list[str]:
        """The last generation and the batches after it."""
        names = self._names(kind)
        last = [x for x in names if x.startswith("g")][-1:]
        done = set(self._listed(kind, last[0])) if last else set()
        return last + [x for x in names if x.startswith("b") and x not in done]

    def state(self) -> str:
        """A text that changes with every change of the store."""
        live = {kind: self._live(kind) for kind in ("log", "files", "large")}
        return hashlib.sha256(json.dumps([self.path, live]).encode()).hexdigest()

    def _read(self, kind: str, schema: T.StructType, names: list[str] | None = None) -> DataFrame:
        live = self._live(kind) if names is None else names
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{kind}/{x}" for x in live)) if live else self.spark.createDataFrame([], schema)

    def _place(self, df: DataFrame, kind: str, name: str, batches: list[str] | None = None) -> None:
        """Writes aside, then renames: all of it is visible or nothing."""
        staged, target = f"{self.path}/{kind}/_staged-{uuid.uuid4().hex}", f"{self.path}/{kind}/{name}"
        df.write.parquet(staged)
        fs, p, jvm = self._fs(staged)
        if batches is not None:
            out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{staged}/_batches"))
            out.write("\n".join(batches).encode())
            out.close()
        to = jvm.org.apache.hadoop.fs.Path(target)
        if fs.exists(to) or not fs.rename(p, to):
            raise OSError(f"could not put {target} in place")

    def _append(self, df: DataFrame, kind: str) -> None:
        self._place(df, kind, f"b{self._next():020d}-{uuid.uuid4().hex[:8]}")

    # Documents --------------------------------------------------------------------------------------------------------

    def store(self, docs: DataFrame, id_col: str = "unique_id", ts_col: str | None = None, meta_col: str | None = None, clear_files: bool = False) -> None:
        """Replaces documents by id. In one batch, and between batches, the greatest ts wins; equal ts: the later batch."""
        ts = F.col(ts_col).cast("long") if ts_col else F.lit(time.time_ns() // 1_000_000)
        body = [c for c in docs.columns if c not in (id_col, ts_col, meta_col)]
        meta = F.col(meta_col) if meta_col else F.lit(None)
        rows = docs.select(F.col(id_col).cast("string").alias("unique_id"), ts.alias("ts"), F.lit(self._next()).alias("seq"), F.lit("store").alias("op"), meta.cast("map<string,string>").alias("meta"), F.to_json(F.struct(*body), {"ignoreNullFields": "true"}).alias("doc"))
        rows = latest(rows, ["unique_id"], "ts", "seq")
        self._append(rows, "log")
        if clear_files:
            self.delete_files(rows.select("unique_id"))

    def _rows(self) -> DataFrame:
        return latest(self._read("log", LOG), ["unique_id"], "ts", "seq").where("op = 'store'")

    def documents(self) -> DataFrame:
        """unique_id, ts, meta and the document's columns."""
        parsed = self._rows().withColumn("d", F.from_json("doc", self.schema))
        return parsed.select("unique_id", "ts", "meta", *(F.col("d")[f.name].alias(f.name) for f in self.schema))

    def delete(self, ids: DataFrame, documents: bool = True, files: bool = True, filename: str | None = None) -> None:
        """``ids``: column unique_id. All attachments go before a single one is looked at."""
        ids = ids.select(F.col("unique_id").cast("string").alias("unique_id")).distinct()
        if documents:
            last = self._read("log", LOG).join(ids, "unique_id", "left_semi").groupBy("unique_id").agg(F.max("ts").alias("ts"))
            gone = ids.join(last, "unique_id").select("unique_id", "ts", F.lit(self._next()).alias("seq"), F.lit("delete").alias("op"), F.lit(None).cast("map<string,string>").alias("meta"), F.lit(None).cast("string").alias("doc"))
            self._append(gone, "log")
        if files or filename is not None:
            self.delete_files(ids, None if files else filename)
            self.delete_large(ids, None if files else filename)

    def clear(self) -> None:
        """Takes all documents and attachments, keeps the settings."""
        for kind, schema in (("log", LOG), ("files", FILES), ("large", LARGE)):
            self._switch(kind, self._live(kind), self.spark.createDataFrame([], schema))

    def _switch(self, kind: str, live: list[str], df: DataFrame) -> None:
        """A new generation ``df`` in place of the live folders; what was replaced by the generation before is deleted."""
        names = self._names(kind)
        generations = [x for x in names if x.startswith("g")]
        if generations:
            current, taken = generations[-1], set(self._listed(kind, generations[-1]))
            for name in [x for x in names if x.startswith("g") and x != current or x in taken]:
                fs, p, _ = self._fs(f"{self.path}/{kind}/{name}")
                fs.delete(p, True)
        number = int(generations[-1][1:]) + 1 if generations else 1
        self._place(df, kind, f"g{number:08d}", [x for x in live if x.startswith("b")])

    def compact(self) -> None:
        """The latest row of each id, deletions too, in one generation; batches written meanwhile stay beside it."""
        for kind, schema, keys in (("log", LOG, ["unique_id"]), ("files", FILES, ["unique_id", "filename"])):
            live = self._live(kind)
            self._switch(kind, live, latest(self._read(kind, schema, live), keys, "ts", "seq"))
        live = self._live("large")
        self._switch("large", live, self._large(live))

    def fetch(self, ids: DataFrame, kind: str = "FULL", include: list[str] | None = None, mask: list[str] | None = None, raw: bool = False) -> DataFrame:
        """One row for each asked id in asked order: unique_id, found, and by ``kind`` (NONE, META, FULL) ts, meta, document.

        A missing id has found = false and nulls.
        """
        if kind not in ("NONE", "META", "FULL"):
            raise ConfigError(f"unknown fetch type {kind}")
        asked = ids.select(F.col("unique_id").cast("string").alias("unique_id"), *([F.col("place")] if "place" in ids.columns else []))
        docs = self._rows().join(asked.select("unique_id").distinct(), "unique_id", "left_semi")
        names = [f.name for f in self.schema if (not include or f.name in include) and f.name not in (mask or [])]
        parsed = F.from_json("doc", self.schema)
        columns = {"NONE": [], "META": ["ts", "meta"], "FULL": ["ts", "meta", (F.col("doc") if raw else F.struct(*(parsed[n].alias(n) for n in names))).alias("document")]}[kind]
        out = asked.join(docs.select("unique_id", F.lit(True).alias("found"), *columns), "unique_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
        return out.orderBy("place") if "place" in ids.columns else out

    def batch_fetch(self, ids: list[str], **options) -> DataFrame:
        asked = self.spark.createDataFrame(list(enumerate(ids)), "place int, unique_id string")
        return self.fetch(asked, **options)

    # Attachments ------------------------------------------------------------------------------------------------------

    def store_files(self, files: DataFrame) -> None:
        """Columns unique_id, filename, content, and optionally compressed (deflate it) and meta; replaces by (id, name)."""
        meta = F.col("meta") if "meta" in files.columns else F.lit(None)
        squeeze = F.coalesce(F.col("compressed"), F.lit(False)) if "compressed" in files.columns else F.lit(False)
        rows = files.select(F.col("unique_id").cast("string").alias("unique_id"), "filename", F.lit(time.time_ns() // 1_000_000).alias("ts"), F.lit(self._next()).alias("seq"), F.lit("store").alias("op"), meta.cast("map<string,string>").alias("meta"), squeeze.alias("compressed"), F.col("content").cast("binary").alias("content"))
        self._append(rows.withColumn("content", F.when(F.col("compressed"), deflate(F.when(F.col("compressed"), F.col("content")))).otherwise(F.col("content"))), "files")

    def files(self, kind: str = "META") -> DataFrame:
        """unique_id, filename, ts, meta, compressed, and content with ``kind`` FULL (META does not read it)."""
        rows = self._read("files", FILES)
        if kind != "FULL":
            rows = rows.drop("content")
        out = latest(rows, ["unique_id", "filename"], "ts", "seq").where("op = 'store'").drop("op", "seq")
        return out.withColumn("content", F.when(F.col("compressed"), inflate(F.when(F.col("compressed"), F.col("content")))).otherwise(F.col("content"))) if kind == "FULL" else out

    def store_large(self, unique_id: str, filename: str, stream: BinaryIO, chunk: int = CHUNK) -> int:
        """An attachment of any size from an open stream, read and written CHUNKS chunks at a time; returns its bytes.

        It replaces one of its name once the last chunk is written.
        """
        seq, ts, place, size = self._next(), time.time_ns() // 1_000_000, 0, 0
        while True:
            some = [x for x in (stream.read(chunk) for _ in range(CHUNKS)) if x]
            rows = [(unique_id, filename, ts, seq, "chunk", place + i, x) for i, x in enumerate(some)]
            if rows:
                self._append(self.spark.createDataFrame(rows, LARGE), "large")
            place, size = place + len(some), size + sum(map(len, some))
            if len(some) < CHUNKS:
                break
        self._append(self.spark.createDataFrame([(unique_id, filename, ts, seq, "store", place, None)], LARGE), "large")
        return size

    def _large(self, live: list[str] | None = None) -> DataFrame:
        """Chunks of the last complete version of each large attachment, the row that completes it, and deletions."""
        rows = self._read("large", LARGE, live)
        marks = rows.where("op <> 'chunk'").groupBy("unique_id", "filename").agg(F.max("seq").alias("seq"))
        return rows.join(marks, ["unique_id", "filename", "seq"], "left_semi").select(LARGE.names)

    def fetch_large(self, unique_id: str, filename: str) -> Iterator[bytes]:
        """The chunks of a large attachment in order, fetched as they are consumed; none if there is no such attachment."""
        mine = self._large().where((F.col("unique_id") == unique_id) & (F.col("filename") == filename) & (F.col("op") == "chunk"))
        for r in mine.select("place", "content").orderBy("place").toLocalIterator(prefetchPartitions=False):
            yield bytes(r["content"])

    def large_files(self) -> DataFrame:
        """unique_id, filename, ts, chunks of the large attachments."""
        return self._large().where("op = 'store'").select("unique_id", "filename", "ts", F.col("place").alias("chunks"))

    def delete_large(self, ids: DataFrame, filename: str | None = None) -> None:
        mine = self.large_files().join(ids.select("unique_id").distinct(), "unique_id", "left_semi")
        mine = mine if filename is None else mine.where(F.col("filename") == filename)
        self._append(mine.select("unique_id", "filename", "ts", F.lit(self._next()).alias("seq"), F.lit("delete").alias("op"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("content")), "large")

    def delete_files(self, ids: DataFrame, filename: str | None = None) -> None:
        mine = self.files("META").join(ids.select("unique_id").distinct(), "unique_id", "left_semi")
        if filename is not None:
            mine = mine.where(F.col("filename") == filename)
        gone = mine.select("unique_id", "filename", "ts", F.lit(self._next()).alias("seq"), F.lit("delete").alias("op"), "meta", "compressed", F.lit(None).cast("binary").alias("content"))
        self._append(gone, "files")

    def file_listing(self) -> DataFrame:
        """One JSON text for each attachment, without its content."""
        return self.files("META").select(F.to_json(F.struct("unique_id", "filename", "ts", "meta", "compressed")).alias("json"))


def save_settings(spark: SparkSession, path: str, name: str, text: str) -> None:
    spark.createDataFrame([(name, json.dumps(json.loads(text)))], "index_name string, settings string").write.mode("overwrite").json(f"{path}/settings/{name}")
