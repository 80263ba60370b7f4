"""Real-time upserts: a stream of documents into a store, micro-batch by micro-batch; and latest-per-key on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import DocumentStore


def upsert_stream(stream: DataFrame, store: DocumentStore, checkpoint: str, id_col: str = "unique_id", ts_col: str | None = None, trigger: str | None = None, available_now: bool = True, name: str | None = None) -> StreamingQuery:
    """Every micro-batch is stored; a batch that is run again after a failure stores equal rows with equal ts, which is no change.

    ``trigger``: interval of batches, as ``30 seconds`` (the commit interval); else the stream's available rows are taken once.
    """

    def batch(rows: DataFrame, _: int) -> None:
        store.store(rows, id_col=id_col, ts_col=ts_col)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=available_now)
    return writer.start()


def latest_by_key(stream: DataFrame, key: str, ts: str) -> DataFrame:
    """The row with the greatest ts of each key, as a streaming aggregate (complete or update mode)."""
    rest = [c for c in stream.columns if c != key]
    best = stream.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(ts)).alias("row"))
    return best.select(key, *(F.col("row")[c].alias(c) for c in rest))


def counts_by_window(stream: DataFrame, ts: str, width: str, label: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts by event-time window and label with a watermark; beyond what the search engine needs, for event streams."""
    window = F.window(F.col(ts).cast("timestamp"), width, slide) if slide else F.window(F.col(ts).cast("timestamp"), width)
    marked = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return marked.groupBy(window.alias("w"), label).agg(F.count("*").alias("count")).select(F.col("w.start").alias("start"), label, "count")
