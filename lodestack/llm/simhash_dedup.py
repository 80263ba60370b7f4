"""Operator 7: SimHash near-duplicates, with candidates pruned by the pigeonring principle.

A text's fingerprint has a bit set where over half of its shingle hashes (XXH64, seed 42) have it. Two fingerprints link at
``radius`` or fewer differing bits. The fingerprint is cut into a ring of m > radius segments. If two fingerprints link, there
is a segment from which every chain of consecutive segments (of any length l, round the ring) differs in at most
l * radius / m bits. The chain's first segment then agrees wholly, its first two differ in at most one bit (for m = 5 and
radius 4): a fingerprint is filed under each segment with that chain of two, and candidates of a file must pass the chains of
three, of four and so on one after the other; the longest is the whole ring, that is the full Hamming check.

Only distinct fingerprints are compared, so exact copies never multiply. In files of up to SMALL fingerprints all candidates are
judged at once; in larger ones links are found breadth first, each newly reached fingerprint against those not yet reached. A task
keeps only a spanning forest of the links it finds, so a dense group of any size yields one link for each member and no link
between components is lost. A file with more than DENSE fingerprints is dealt into blocks by a hash, and every two blocks meet in a
task of their own (``files.dealt``), so that no task ever holds a denser one.

Defined results: null text counts as empty; a text without words has fingerprint 0 and links like any other; repeated rows
stay; a null doc_id keeps its row and never names a component (null if the component has no other); an empty table gives an
empty result; other columns are ignored; of a very long text all shingles vote, BLOCK at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROW_KEY, checkpointed, fresh, map_arrow, row_key, slices, texts
from .components import components, forest
from .files import DENSE, SALTS, dealt, joined, scattered

#: Shingles whose bits are counted at a time, so that very long texts need bounded memory.
BLOCK = 1 << 15


def fingerprint(text: str, words: int = 4) -> int:
    raw = b" ".join(text.encode().lower().split())  # of bytes, both know ASCII only
    if not raw:
        return 0
    gaps = np.flatnonzero(np.frombuffer(raw, np.uint8) == 0x20)
    n = max(1, len(gaps) + 2 - words)
    first = np.concatenate([[0], gaps + 1])[:n].tolist()
    last = np.concatenate([gaps, [len(raw)]])[-n:].tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        hashes = np.fromiter((digest(raw[a:b], 42) for a, b in zip(first[i : i + BLOCK], last[i : i + BLOCK], strict=True)), ">u8", min(BLOCK, n - i))
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


FINGERPRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) for every row; fp is the unsigned 64-bit fingerprint kept in a long."""

    def run(batches):
        for part, values in slices(batches):
            fps = np.array([fingerprint(t, words) for t in values], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return map_arrow(texts(docs), run, FINGERPRINTS)


def segments(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of the ring's radius + 1 segments of 64 bits."""
    m = radius + 1
    edges = [round(64 * i / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def chained(x: np.ndarray, at: np.ndarray, ring: list[tuple[int, int]], radius: int, since: int = 1) -> list[np.ndarray]:
    """Places of the differences x that keep every chain from segment ``at`` on within its share, after each length from ``since``.

    Shorter chains must hold already. The last entry, after the whole ring, holds the links.
    """
    m, out, left = len(ring), [], np.arange(len(x))
    shifts, masks = (np.array(v, np.uint64) for v in ([a for a, _ in ring], [(1 << w) - 1 for _, w in ring]))
    count = lambda some, k: np.bitwise_count(x[some] >> shifts[(at[some] + k) % m] & masks[(at[some] + k) % m]).astype(np.int64)
    total = sum((count(left, k) for k in range(since - 1)), np.zeros(len(x), np.int64))
    for length in range(since, m + 1):
        total = total + count(left, length - 1)
        ok = total * m <= length * radius
        left, total = left[ok], total[ok]
        out.append(left)
    return out


#: Fingerprints of a file whose candidates are judged all at once.
SMALL = 32


def file_links(fp: np.ndarray, at: np.ndarray, key: np.ndarray, ring: list[tuple[int, int]], radius: int, since: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (a, b), of the links among fingerprints with equal key and segment; rows ascend by (key, at)."""
    edge = np.concatenate([[True], (key[1:] != key[:-1]) | (at[1:] != at[:-1]), [True]])
    edges = np.flatnonzero(edge)
    size = np.diff(edges)
    found_a, found_b = [], []
    some = np.flatnonzero((size > 1) & (size <= SMALL))
    first, n = edges[some], size[some]
    left = np.repeat(first, n)
    left = left + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)  # every row of a small file
    end = np.repeat(first + n, n)
    for step in range(1, SMALL):
        on = left + step < end
        left, end = left[on], end[on]
        if not len(left):
            break
        linked = chained(fp[left] ^ fp[left + step], at[left], ring, radius, since)[-1]
        found_a.append(fp[left[linked]])
        found_b.append(fp[left[linked] + step])
    for k in np.flatnonzero(size > SMALL).tolist():
        rest, which = fp[edges[k] : edges[k + 1]], at[edges[k] : edges[k] + 1]
        while len(rest) > 1:
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                x = queue.pop()
                near = chained(rest ^ x, np.broadcast_to(which, len(rest)), ring, radius, since)[-1]
                if len(near):
                    found_a.append(np.full(len(near), x, np.uint64))
                    found_b.append(rest[near])
                    queue += list(rest[near])
                    rest = np.delete(rest, near)
    if not found_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(found_a), np.concatenate(found_b)


LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def filed(distinct: DataFrame, radius: int) -> tuple[DataFrame, int]:
    """(fp, at, key): each fingerprint under every segment with the chain that begins there, and the first chain not yet judged."""
    ring = segments(radius)
    m = len(ring)
    part = lambda k: F.shiftrightunsigned("fp", ring[k % m][0]).bitwiseAND(F.lit((1 << ring[k % m][1]) - 1))
    free = 2 * radius // m  # differing bits that a chain of two may have
    rows = []
    for k in range(m):
        if free == 1:  # once for each value that differs from its own in that one bit at most: the bit is left out of the key
            nexts = [part(k + 1).bitwiseAND(F.lit(~(1 << b))) * 64 + b for b in range(ring[(k + 1) % m][1])]
        else:
            nexts = [part(k + 1) if free == 0 else F.lit(0).cast("long")]
        rows += [F.struct(F.lit(k).alias("at"), F.xxhash64(F.lit(k), part(k), n).alias("key")) for n in nexts]
    return distinct.select("fp", F.explode(F.array(*rows)).alias("file")).select("fp", "file.at", "file.key"), 3 if free < 2 else 2


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp`` whose components are those of all links."""
    ring, n = segments(radius), distinct.count()
    every, since = filed(scattered(distinct, n), radius)
    def run(batches):
        found = [[batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "at", "key")] for batch in batches]
        if not found:
            return
        fp, at, key = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((at, key))
        a, b = file_links(fp[order].view(np.uint64), at[order].astype(np.int64), key[order], ring, radius, since)
        a, b = forest(a.view(np.int64), b.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], LINKS.names)

    width = max(w for _, w in ring) if 2 * radius // len(ring) == 1 else 1
    parts = max(2 * distinct.sparkSession.sparkContext.defaultParallelism, -(-n * len(ring) * width // 1_000_000))
    return map_arrow(dealt(every, DENSE).repartition(parts, "key"), run, LINKS)


def duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id reachable over links)."""
    fps = checkpointed(fingerprints(docs, words))
    groups = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    roots = components(links(groups.select("fp"), radius))
    rooted = checkpointed(groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left"))
    # One component may hold a third of the linked fingerprints, so the join by root is dealt over salts as well.
    linked = rooted.where("root is not null").withColumn("salt", F.pmod(F.hash("fp"), F.lit(SALTS)))
    best = linked.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = linked.join(best, ["root", "salt"]).select("fp", "n", "component_id")
    named = checkpointed(named.unionByName(rooted.where("root is null").select("fp", "n", F.col("first_id").alias("component_id"))))
    # Copies share a fingerprint; one may have a third of all rows.
    return joined(fps, named, "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


KEYED = T.StructType([*FINGERPRINTS, T.StructField("row", ROW_KEY)])


def one_row_of_each(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """One row of ``docs`` of each component: the smallest doc_id (null last), then the smallest row key. Of equal rows one stays,
    and rows without id compete like any other."""
    key = fresh(docs, "_row")
    keyed = docs.withColumn(key, row_key(docs.columns))

    def run(batches):
        for part, values in slices(batches):
            fps = np.array([fingerprint(t, words) for t in values], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps), part.column("row")], KEYED.names)

    rows = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col(key).alias("row"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = checkpointed(map_arrow(rows, run, KEYED).groupBy("fp").agg(F.min(place).alias("first")))
    roots = components(links(groups.select("fp"), radius))
    rooted = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    kept = rooted.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.row").alias(key)).distinct()
    return keyed.dropDuplicates([key]).join(kept, key, "left_semi").select(docs.columns)  # equal rows are combined before the shuffle
