"""Operator 10: SimHash fingerprints of documents, and block tables that find near ones.

A text's terms are its pairs of neighbouring words (a single word alone: itself), lower-cased; each occurrence weighs the
number of its characters, so that pairs of short, frequent words count little. Term hashes vote with their weight on 64 signed
bits; a bit is set where the votes are positive. Likeness is 1 - differing bits / 64.

``first_near`` finds all fingerprints within a Hamming radius by permuted block tables: 64 bits are cut into ``radius`` + k blocks,
every choice of k blocks that may agree is one table whose key these blocks lead, and rows of equal keys are compared. The more
fingerprints there are, the more blocks lead a key (``leading``); the result does not depend on it. Of the near ones each row is
named the smallest doc_id, so a dense file gives a row for each member instead of all pairs; files with more than DENSE
fingerprints are dealt into blocks that meet two by two.

The next document, ascending doc_id, is found without a global sort in one task: rows are dealt into id ranges whose limits are
taken from quantiles, and the first row of every range also travels to the range before it. Ids should be unique: rows of one id, or
without one, stream through one range, whatever their number.

Defined results: null text is empty (fingerprint 0, edited text empty); repeated ids are ordered by text; rows without id come
last; a single document is its own next; an empty table gives an empty result; other columns are ignored; of a very long text all
terms vote, BLOCK at a time, and the edit is made on the whole text.
"""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, map_arrow, slices, texts
from .files import DENSE, dealt, joined, scattered

#: Words whose hashes are remembered, and terms whose votes are counted at a time.
CACHE, BLOCK = 200_000, 1 << 14
#: Rows of an id range on average, the most ranges, of which the driver holds a few numbers each (beyond, ranges grow; rows stream
#: through them), ranges of a task.
RANGE_ROWS, MOST_RANGES, TASK_RANGES = 500, 1_000_000, 8
#: Fingerprints of a file that are compared all at once.
SMALL = 32


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh64_intdigest(word, 0)
        if len(self) < CACHE and len(word) < 64:
            self[word] = out
        return out


_hashes = WordHashes()


def fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    h, size = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)), np.fromiter(map(len, words), np.int64, len(words))
    if len(words) > 1:
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        size = size[:-1] + size[1:]
    votes = np.zeros(64, np.float64)
    for i in range(0, len(h), BLOCK):
        bits = np.unpackbits(h[i : i + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += size[i : i + BLOCK].astype(np.float32) @ bits.astype(np.float32)
    return int.from_bytes(np.packbits(2 * votes > size.sum()).tobytes(), "big")


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / 64


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the first as many characters of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


FINGERPRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the unsigned 64-bit fingerprint kept in a long."""

    def run(batches):
        for part, values in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array([fingerprint(t) for t in values], np.uint64).view(np.int64))], ["doc_id", "fp"])

    return map_arrow(texts(docs), run, FINGERPRINTS)


NEAREST = T.StructType([T.StructField("fp", T.LongType()), T.StructField("first_id", T.LongType())])


def leading(radius: int, n: int) -> int:
    """Number of blocks that lead a key, two or more: as many as give the least rows to file and to compare for n fingerprints."""
    return min(range(2, 7), key=lambda k: comb(radius + k, k) * (1 + n / 2 ** (64 * k / (radius + k))))


def near_names(fp: np.ndarray, name: np.ndarray, key: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each fingerprint that has one, the smallest name of those within the radius and of equal key; rows ascend by (key, name)."""
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(edges)
    named, names = [], []
    some = np.flatnonzero((size > 1) & (size <= SMALL))
    first, n = edges[some], size[some]
    left, end = np.repeat(first, n), np.repeat(first + n, n)
    left = left + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)  # every row of a small file
    for step in range(1, SMALL):
        on = left + step < end
        left, end = left[on], end[on]
        near = left[np.bitwise_count(fp[left] ^ fp[left + step]) <= radius]
        named.append(fp[near + step])
        names.append(name[near])
    for k in np.flatnonzero(size > SMALL).tolist():
        rest, since = fp[edges[k] : edges[k + 1]], name[edges[k] : edges[k + 1]]
        for x, least in zip(rest, since, strict=True):  # each names those near it that have no name yet
            near = np.bitwise_count(rest ^ x) <= radius
            named.append(rest[near])
            names.append(np.full(int(near.sum()), least))
            rest, since = rest[~near], since[~near]
            if not len(rest):
                break
    named, names = np.concatenate([*named, fp[:0]]), np.concatenate([*names, name[:0]])
    order = np.lexsort((names, named))
    one = np.concatenate([[True], named[order[1:]] != named[order[:-1]]]) if len(order) else np.zeros(0, bool)
    return named[order[one]], names[order[one]]


def first_near(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, first_id, n): of each distinct fingerprint of (doc_id, fp) the smallest doc_id within ``radius``, its own rows included,
    and the number of its own rows."""
    distinct = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    n = distinct.count()
    k = leading(radius, n)
    edges = [round(64 * i / (radius + k)) for i in range(radius + k + 1)]
    block = lambda j: F.shiftrightunsigned("fp", edges[j]).bitwiseAND(F.lit((1 << edges[j + 1] - edges[j]) - 1))
    keys = [F.xxhash64(F.lit(i), *map(block, some)) for i, some in enumerate(combinations(range(radius + k), k))]
    filed = scattered(distinct, n).select("fp", F.coalesce("first_id", F.lit((1 << 63) - 1)).alias("id"), F.explode(F.array(*keys)).alias("key"))

    def run(batches):
        found = [[batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "id", "key")] for batch in batches]
        if not found:
            return
        fp, at, key = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((at, key))
        named, names = near_names(fp[order].view(np.uint64), at[order], key[order], radius)
        yield pa.RecordBatch.from_arrays([pa.array(named.view(np.int64)), pa.array(names)], NEAREST.names)

    parts = max(2 * fps.sparkSession.sparkContext.defaultParallelism, -(-n * len(keys) // 1_000_000))
    named = map_arrow(dealt(filed, DENSE).repartition(parts, "key"), run, NEAREST)
    named = named.select("fp", F.nullif("first_id", F.lit((1 << 63) - 1)).alias("first_id"), F.lit(0).cast("long").alias("n"))
    return named.unionByName(distinct).groupBy("fp").agg(F.min("first_id").alias("first_id"), F.max("n").alias("n"))


RESULT = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()))])


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Every text's fingerprint, that of its edited text, and the likeness to it and to the next document's."""
    rows = texts(docs)
    last = F.lit((1 << 63) - 1)
    ids = rows.select(F.coalesce("doc_id", last).alias("i"))
    n = ids.count()
    if not n:
        return rows.sparkSession.createDataFrame([], RESULT)
    parts = min(MOST_RANGES, -(-n // RANGE_ROWS))
    limits = sorted({int(x) for x in ids.select(F.percentile_approx("i", F.lit([k / parts for k in range(1, parts)]), min(100 * parts, 2_000_000))).first()[0]}) if parts > 1 else []
    place = _place(limits) if limits else F.lit(0)
    firsts = {r["range"]: r["first"] for r in ids.withColumn("range", place).groupBy("range").agg(F.min("i").alias("first")).collect()}  # one row a range
    order = sorted(firsts)
    before = dict(zip(order, [order[-1], *order], strict=False))  # the range that needs a range's first row
    array = lambda numbers, kind: F.split(F.lit(",".join(map(str, numbers))), ",").cast(f"array<{kind}>")
    # Ranges without rows have any numbers: no row looks there.
    first_of, needs = (array([own.get(r, -1) for r in range(len(limits) + 1)], kind) for own, kind in ((firsts, "bigint"), (before, "int")))
    dealt_rows = rows.withColumn("i", F.coalesce("doc_id", last)).withColumn("range", place.cast("int"))
    also = F.when(F.element_at(first_of, F.col("range") + 1) == F.col("i"), F.element_at(needs, F.col("range") + 1))
    to = F.array_compact(F.array(F.struct(F.col("range"), F.lit(0).alias("next")), F.when(also.isNotNull(), F.struct(also.alias("range"), F.lit(1).alias("next")))))
    ranged = dealt_rows.select("doc_id", "i", "text", F.explode(to).alias("to")).select("doc_id", "i", "text", "to.range", "to.next")
    ranged = ranged.repartition(-(-len(order) // TASK_RANGES), "range").sortWithinPartitions("range", "next", "i", "text")

    def run(batches):
        held: tuple | None = None  # range, doc_id, text, fingerprint of the row that waits for the next one

        def result(row: tuple, text: str, fp: int) -> tuple:
            new = edited(row[2], text)
            other = fingerprint(new)
            return row[1], len(row[2]), hashlib.sha256(new.encode()).hexdigest(), f"{row[3]:016x}", f"{other:016x}", likeness(row[3], other), likeness(row[3], fp)

        for part, values in slices(batches):
            out = []
            for doc_id, at, ahead_of, text in zip(part.column("doc_id").to_pylist(), part.column("range").to_pylist(), part.column("next").to_pylist(), values, strict=True):
                if ahead_of and (held is None or held[0] != at):
                    continue  # a later one of equal ids, or a range without rows
                fp = fingerprint(text)
                if held is not None and held[0] == at:
                    out.append(result(held, text, fp))
                held = None if ahead_of else (at, doc_id, text, fp)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], RESULT.names)

    return map_arrow(ranged, run, RESULT)


def edits_and_neighbours(docs: DataFrame, radius: int = 3) -> DataFrame:
    """``fingerprint_edits`` with near_doc_id: the smallest doc_id whose fingerprint is within ``radius`` (own rows included)."""
    edits = checkpointed(fingerprint_edits(docs)).withColumn("fp", F.conv("fingerprint", 16, -10).cast("long"))
    near = first_near(edits.select("doc_id", "fp"), radius).withColumnRenamed("first_id", "near_doc_id")
    return joined(edits, checkpointed(near), "fp", "n").select(*RESULT.names, "near_doc_id")


def _place(limits: list[int]):
    """Number of limits at or below i, by a binary search written as one expression over a constant array."""
    table = F.split(F.lit(",".join(map(str, limits))), ",").cast("array<bigint>")
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(limits)).alias("hi"))

    def step(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = (acc["lo"] < acc["hi"]) & (F.element_at(table, F.least(mid, F.lit(len(limits) - 1)) + 1) <= F.col("i"))
        return F.struct(F.when(below, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(below | (acc["lo"] >= acc["hi"]), acc["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(limits).bit_length() + 1)), start, step, lambda acc: acc["lo"])
