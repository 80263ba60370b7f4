"""Connected components of a link table, without collecting it: large-star and small-star rounds over DataFrames.

Links up to ``LOCAL_LINKS`` (16 bytes each) are solved in one task, whose memory that number bounds; more links take as many
rounds as their paths need. Either way the result is the same and holds every link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Links that one task may solve.
LOCAL_LINKS = 1_000_000


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b) of longs; root is the smallest node of its component."""
    pairs = checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    if pairs.count() <= LOCAL_LINKS:
        return pairs.repartition(1).mapInArrow(_solve, "node long, root long")
    return _stars(pairs, max_rounds)


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links, ascending, and the smallest node of each one's component.

    Least labels run along the links and along the labels themselves until nothing changes.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for ends in (a, b, label[a], label[b]):
            np.minimum.at(new, ends, least)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One link from each node to the smallest of its component: the same components with fewer links than nodes."""
    nodes, roots = least_labels(a, b)
    return nodes[nodes != roots], roots[nodes != roots]


def _solve(batches):
    parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if len(b)]
    if parts:
        nodes, roots = least_labels(*(np.concatenate([p[k] for p in parts]) for k in range(2)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])


def _stars(pairs: DataFrame, max_rounds: int) -> DataFrame:
    """Each round joins every node to the smallest neighbour seen, first over larger neighbours, then over smaller ones.

    The aggregations are combined before the shuffle, so a hub of many links is never gathered in one task. Rounds end when the
    links no longer change. Every round is cut from its lineage by a checkpoint in the shared folder, so that a lost executor
    costs a recomputation of one round at most.
    """
    before = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = checkpointed(small.unionByName(smallest.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
