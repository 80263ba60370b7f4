"""Commands that run beside one another: every call returns a future, whose result a caller awaits or gets later.

Spark jobs of several threads share the executors; each command is a job group of its own, so that it can be cancelled alone.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any
from uuid import uuid4

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

from .search import Index, Query, hits, search_facets
from .store import DocumentStore


class WorkPool:
    """At most ``threads`` commands at once; the rest wait their turn."""

    def __init__(self, spark: SparkSession, threads: int = 16):
        self.spark, self.pool, self.groups = spark, ThreadPoolExecutor(threads, thread_name_prefix="lodestack"), {}

    def __enter__(self) -> WorkPool:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def submit(self, command: Callable[..., Any], *args: Any, **options: Any) -> Future:
        group = f"lodestack-{uuid4().hex}"

        def run() -> Any:
            self.spark.sparkContext.setJobGroup(group, getattr(command, "__name__", "command"), interruptOnCancel=True)
            return command(*args, **options)

        future = self.pool.submit(inheritable_thread_target(self.spark)(run))
        self.groups[future] = group
        future.add_done_callback(lambda f: self.groups.pop(f, None))
        return future

    def cancel(self, future: Future) -> None:
        """A command that has not begun never does; the jobs of one that runs are stopped."""
        group = self.groups.get(future)
        if not future.cancel() and group:
            self.spark.sparkContext.cancelJobGroup(group)

    def close(self) -> None:
        self.pool.shutdown()

    # The commands -----------------------------------------------------------------------------------------------------

    def query(self, index: Index, query: Query) -> Future:
        """One page of hits, as rows."""
        return self.submit(lambda: hits(index, query).orderBy("rank").collect())

    def facets(self, index: Index, query: Query) -> Future:
        return self.submit(lambda: search_facets(index, query).collect())

    def store(self, store: DocumentStore, docs: Any, **options: Any) -> Future:
        return self.submit(store.store, docs, **options)

    def delete(self, store: DocumentStore, ids: Any, **options: Any) -> Future:
        return self.submit(store.delete, ids, **options)

    def batch_fetch(self, store: DocumentStore, ids: list[str], **options: Any) -> Future:
        """Documents in asked order, as rows."""
        return self.submit(lambda: store.batch_fetch(ids, **options).collect())
