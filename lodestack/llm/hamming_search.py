"""Operator 5: exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit set where the component is positive (first component: highest bit). Equal codes are stored once
with their k smallest ids, which is all that a top-k with ties broken by id can use, so groups of copies of any size cost one
entry. The distinct codes are dealt into parts; in each part the code is cut into m segments with a table per segment. A query
probes, for radius r = 0, 1, 2, ..., the entries whose segment differs in exactly r bits, and stops once its k-th verified
distance is at most m * (r + 1) - 1: an entry not met yet differs in more than r bits in every segment. If a radius would need
more probes than the part has entries, the rest of the part is verified instead. Parts' answers are merged per query.

Queries are distinct codes too, in blocks, sent to every part; the answer of a code holds for all its ids.

Defined results: null vectors (and those with a null component) are no entries and no queries; other lengths than 64 use their
first 64 components, absent ones count as not positive; rows without id are left out; rows repeated with one id count once; an
empty table gives an empty result; other columns are ignored.

Every part meets every block, so the rows sent grow as entries * blocks + queries * parts; what a query verifies in a part does not.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed

BITS = 64
#: Most entries of a part, and queries of a block; entries for which a part of its own is worth while if cores are idle.
PART, BLOCK, LEAST = 131_072, 65_536, 4096


def codes(vectors: DataFrame) -> DataFrame:
    """(vec_id, code)."""
    v = F.slice("embedding", 1, BITS)
    whole = F.aggregate(v, F.lit(0).cast("long"), lambda acc, x: F.call_function("shiftleft", acc, F.lit(1)) + F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    padded = F.call_function("shiftleft", whole, F.lit(BITS) - F.size(v))
    return vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0").where(~F.exists("embedding", lambda x: x.isNull())).select(F.col("vec_id").cast("long").alias("vec_id"), padded.alias("code"))


class SegmentTables:
    """Multi-index of the codes of one part."""

    def __init__(self, values: np.ndarray):
        self.values = values
        width = min(16, max(4, int(len(values)).bit_length()))
        self.m = -(-BITS // width)
        edges = [round(BITS * i / self.m) for i in range(self.m + 1)]
        self.segments = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
        self.tables = []
        for shift, width in self.segments:
            key = (values >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)
            order = np.argsort(key, kind="stable")
            self.tables.append((order, np.searchsorted(key[order], np.arange((1 << width) + 1))))
        self.flips: dict[tuple[int, int], np.ndarray] = {}

    def masks(self, width: int, r: int) -> np.ndarray:
        if (width, r) not in self.flips:
            self.flips[width, r] = np.array([sum(1 << b for b in c) for c in combinations(range(width), r)], np.int64)
        return self.flips[width, r]

    def probes(self, r: int) -> int:
        out = 0
        for _, width in self.segments:
            n = 1
            for i in range(r):
                n = n * (width - i) // (i + 1)
            out += n
        return out

    def search(self, code: np.uint64, k: int, tie: np.ndarray) -> np.ndarray:
        """Places of the codes with the k smallest distances, and of all that tie with the last of them."""
        met = np.zeros(len(self.values), bool)
        places: list[np.ndarray] = []
        distances: list[np.ndarray] = []
        total, r = 0, 0
        while total < len(self.values):
            if self.probes(r) > len(self.values):
                new = np.flatnonzero(~met)
            else:
                found = []
                for (shift, width), (order, at) in zip(self.segments, self.tables, strict=True):
                    key = int(code >> np.uint64(shift)) & (1 << width) - 1 ^ self.masks(width, r)
                    lo, n = at[key], at[key + 1] - at[key]
                    some = np.flatnonzero(n)
                    lo, n = lo[some], n[some]
                    if len(n):
                        found.append(order[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())])
                new = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
                new = new[~met[new]]
            met[new] = True
            total += len(new)
            places.append(new)
            distances.append(np.bitwise_count(self.values[new] ^ code))
            d = np.concatenate(distances)
            if len(d) >= k and np.partition(d, k - 1)[k - 1] <= self.m * (r + 1) - 1:
                break
            r += 1
        place, d = np.concatenate(places), np.concatenate(distances)
        if len(d) > k:
            place, d = place[keep := d <= np.partition(d, k - 1)[k - 1]], d[keep]
        order = np.lexsort((tie[place], d))[:k]
        return place[order]


def top_k(vectors: DataFrame, k: int = 10, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, distance: for every row whose id is divisible by ``every``, the k nearest rows (itself included)."""
    found = checkpointed(codes(vectors).distinct())
    entries = _entries(found, k)
    entries = checkpointed(entries)
    asked = found.where(F.col("vec_id") % every == 0)
    wanted = asked.select("code").distinct()
    n, q = entries.count(), wanted.count()
    idle = vectors.sparkSession.sparkContext.defaultParallelism
    parts, blocks = max(1, -(-n // PART), min(idle, n // LEAST)), max(1, -(-q // BLOCK))
    dealt = entries.withColumn("part", F.pmod(F.xxhash64("code"), F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    posed = wanted.withColumn("block", F.pmod(F.xxhash64("code", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def answer(keys, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame({"code": pd.Series(dtype="int64"), "ids": pd.Series(dtype=object), "distance": pd.Series(dtype="int32")})
        values = own["code"].to_numpy().view(np.uint64)
        tie = own["ids"].map(lambda x: x[0]).to_numpy()
        index, out = SegmentTables(values), []
        for code in asked["code"].to_numpy().view(np.uint64):
            best = index.search(code, k, tie)
            out.append(pd.DataFrame({"code": np.full(len(best), np.int64(code.astype(np.int64))), "ids": own["ids"].to_numpy()[best], "distance": np.bitwise_count(values[best] ^ code).astype(np.int32)}))
        return pd.concat(out)

    # Asked for, so that small parts are not put into one task; of a few, two seldom meet in one of many partitions.
    tasks = max(parts * blocks, min(16 * parts * blocks, 200))
    near = dealt.repartition(tasks, "part", "block").groupBy("part", "block").cogroup(posed.repartition(tasks, "part", "block").groupBy("part", "block")).applyInPandas(answer, "code long, ids array<long>, distance int")
    by = W.partitionBy("code").orderBy("distance", "vec_id")
    ranked = near.select("code", "distance", F.explode("ids").alias("vec_id")).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return asked.select(F.col("vec_id").alias("query_id"), "code").join(ranked, "code").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "distance")


def _entries(found: DataFrame, k: int) -> DataFrame:
    """(code, ids): the k smallest ids of each code; copies are cut to k in slices of the ids first, so no group meets whole."""
    slim = found.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    for keys in (["code", "slice"], ["code"]):
        slim = slim.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy("vec_id"))).where(F.col("r") <= k).drop("r")
    return slim.groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


ORACLE = """
WITH c AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: (x > 0)::INT) AS bits FROM embeddings WHERE vec_id IS NOT NULL
), d AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(range(1, 65), lambda i: (q.bits[i] <> r.bits[i])::INT))::INT AS distance
  FROM c q CROSS JOIN c r WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, distance FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id))::INT AS rank FROM d
) WHERE rank <= 10
"""
