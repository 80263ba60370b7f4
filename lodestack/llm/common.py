"""What the operators share: reading tables, walking Arrow batches, checkpoints."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabulary files are looked up when no path is given.
VOCABULARY = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Bytes a core below which a table in few files is dealt to all cores.
SMALL = 16 << 20


def parallel(df: DataFrame) -> DataFrame:
    """A small table in fewer files than there are cores, dealt to all of them; any other table as it is."""
    cores, files = df.sparkSession.sparkContext.defaultParallelism, len(df.inputFiles())
    if not 0 < files < cores or int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > SMALL * cores:
        return df
    return df.repartition(cores)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, so that extra columns (also ones with clashing names) never travel; null text becomes empty."""
    return parallel(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Type of ``row_key``.
ROW_KEY = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.LongType(), False)])


def row_key(columns: list[str]) -> Column:
    """Two 64-bit hashes of a row's whole content; only equal rows share them, nulls included."""
    every = [*map(F.col, columns), *(F.col(c).isNull() for c in columns)]
    return F.struct(F.xxhash64(F.lit(0), *every).alias("a"), F.xxhash64(F.lit(1), *every).alias("b"))


def slices(batches: Iterator[pa.RecordBatch], max_chars: int = 1_000_000, max_rows: int = 512, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches with about ``max_chars`` bytes of text (one longer text stays whole), and their texts."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        begin = 0
        while begin < len(sizes):
            end, n = begin, 0
            while end < len(sizes) and end - begin < max_rows and (end == begin or n + sizes[end] <= max_chars):
                n += sizes[end]
                end += 1
            part = batch.slice(begin, end - begin)
            yield part, [x or "" for x in part.column(column).to_pylist()]
            begin = end


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a private one only where it is unset and Spark runs in one process."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            import tempfile

            where = tempfile.mkdtemp(prefix="lodestack-checkpoint-")
        context.setCheckpointDir(where)
    return str(context._jsc.sc().getCheckpointDir().get())


def checkpoint_folder(spark: SparkSession, name: str) -> str:
    """Path of a new folder in the shared one, for files that executors map into memory."""
    where = checkpoint_dir(spark)
    if not where.startswith(("file:", "/")):
        raise ValueError(f"{where}: files can only be mapped into memory from a mounted folder (file:)")
    path = os.path.join("/" + where.removeprefix("file:").lstrip("/"), f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """A folder of this library's own in the shared one, wherever that lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut from its lineage, in the folder all executors share."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the executions inside are deleted as each ends; otherwise they stay until the driver's JVM collects."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)
