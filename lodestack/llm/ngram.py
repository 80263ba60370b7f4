"""Operator 9: language-model scoring with an Elias-Fano n-gram trie.

Tokens are lower-cased words and one end token; a start mark precedes each text. The model interpolates its orders: with c the
counts in the training texts, P(w | h) = p(w | h) + b(h) * P(w | h'), where h' is h without its first token, p(w | h) =
c(h w) / (c(h) + m(h)) is smoothed by m(h) = A * c(h) ** B, and b(h) = m(h) / (c(h) + m(h)). The lowest order is
P(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)). A context that was not seen leaves the decision to the shorter one. It sums to one over
the known words and one unknown.

Passes: read the texts once, as numbers into the words of blocks of BLOCK tokens, whose words are counted; number the words and
write each text as word ids (with its base score); for each order count its n-grams and build its level; score the ids.

Level 1 holds the words' 64-bit hashes in order, and their counts; a word's id is its shard and place. Level k holds the n-grams
of k tokens as children of their contexts. A context is the place of a node of the level before, so a shard has

* its contexts, ascending, in Elias-Fano form: the rank i of a context is its place among them;
* the children's word ids, relative to their context: i * 2**b + word, b bits holding any word. In Elias-Fano form with b low
  bits the high bits, one unary string, are at the same time the monotone pointers: bucket i is the range of the children of i;
* the smoothed p of each child, its logarithm quantised to 16 bits, and, below the highest order, its count, exact below 32,768 and
  within 0.05 % above.

A query finds its context's rank, reads the pointers, and searches the successor of the word among that context's children only.

N-grams are dealt by their context, and a context over a run of an eighth of all shards by the word, so that a frequent context
never meets in one task. Shards are files in the folder all executors share, written under a temporary name and renamed, so that
a repeated task does no harm. Tasks map them into memory, at most OPEN at a time, and ask them in order of shard. Of each level one
row (totals) reaches the driver. The result is written before the folder is deleted.

Bounds: a shard holds about SHARD_TOKENS tokens' n-grams, a task BUFFER tokens, so memory does not grow with the corpus; a batch of
SCORED tokens asks each shard once, which stays cheap while there are fewer shards than tokens of a batch. Word ids have 32 bits; a
corpus with more distinct words is refused.

Defined results: null text is empty (one token, the end); rows without id are training rows; repeated rows count as often as they
occur; without training rows N and V are 0 and every word is unknown; an empty table gives an empty result; other columns are
ignored; a very long text is read whole and its ids are scored in one piece, in memory in proportion to it. Two words that share a
64-bit hash would be taken for one.
"""

from __future__ import annotations

import os
import shutil
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import brief_shuffles, checkpoint_folder, checkpointed, map_arrow, slices, texts
from .elias_fano import EliasFano

ORDER = 3
#: Weight m of the shorter context against a context's counts, by order from 2 on (the last for all above): as the number of
#: different followers, it grows as a power of the count. Chosen on training rows alone.
A, B = (4.0, 2.0), 0.8
#: Fixed values of the base score.
ADD = 0.1
END = 1  # hash kept for the end; no word's hash is mapped there
UNKNOWN = (1 << 32) - 1
#: Tokens of a shard, on average.
SHARD_TOKENS = 3_000_000
#: Tokens of a block, those that a task handles at a time when counting and when scoring, files it keeps open.
BLOCK, BUFFER, SCORED, OPEN = 500_000, 2_000_000, 1_000_000, 256


def prior(counts: np.ndarray, order: int) -> np.ndarray:
    return A[min(order - 2, len(A) - 1)] * np.maximum(counts, 1) ** B


# Words ------------------------------------------------------------------------------------------------------------------


class Words(dict):
    """Word -> place in ``hashes``, for the words of a block."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = [END]

    def __missing__(self, word: bytes) -> int:
        self.hashes.append(max(xxhash.xxh64_intdigest(word, 9), END + 1))
        self[word] = len(self.hashes) - 1
        return len(self.hashes) - 1

    def places(self, text: str) -> np.ndarray:
        """Of a text's tokens, the end (place 0) last."""
        words = text.encode().lower().split()  # of bytes, both know ASCII only
        out = np.zeros(len(words) + 1, "<u4")
        out[:-1] = np.fromiter(map(self.__getitem__, words), "<u4", len(words))
        return out


def log_codes(values: np.ndarray) -> np.ndarray:
    """Counts as 16 bits: below 32,768 as they are, above on a logarithmic scale."""
    above = 32768 + np.round(np.log2(np.maximum(values, 32768) / 32768) * 700)
    return np.where(values < 32768, values, np.minimum(above, 65535)).astype("<u2")


def decoded(codes: np.ndarray) -> np.ndarray:
    out = codes.astype(np.float64)
    some = np.flatnonzero(codes >= 32768)
    out[some] = 32768 * 2 ** ((out[some] - 32768) / 700)
    return out


# Columns on their way to a shard ----------------------------------------------------------------------------------------


def pack(values: np.ndarray, ascending: bool) -> bytes:
    """Unsigned integers as compressed byte planes, ascending ones as differences."""
    if ascending:
        values = np.diff(values, prepend=np.zeros(1, values.dtype))
    size = values.dtype.itemsize
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, size).T).tobytes(), 1)


def unpack(raw: bytes, kind: str, ascending: bool) -> np.ndarray:
    size = np.dtype(kind).itemsize
    out = np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(size, -1).T).view(kind).ravel()
    return np.cumsum(out, dtype=kind) if ascending else out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def blobs(shard: np.ndarray, columns: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
    """One row for each shard. Rows must ascend within a shard by the first column."""
    order = np.argsort(shard, kind="stable")
    shard, columns, counts = shard[order], [c[order] for c in columns], counts[order].astype("<u4")
    edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
    cut = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    packed = [pa.array([pack(c[a:b], i == 0) for a, b in cut], pa.binary()) for i, c in enumerate(columns)]
    return pa.RecordBatch.from_arrays([pa.array(shard[edges[:-1]].astype(np.int64)), *packed, pa.array([pack(counts[a:b], False) for a, b in cut], pa.binary())], ["shard", *(f"c{i}" for i in range(len(columns))), "counts"])


def blob_schema(columns: int) -> T.StructType:
    return T.StructType([T.StructField("shard", T.LongType()), *(T.StructField(f"c{i}", T.BinaryType()) for i in range(columns)), T.StructField("counts", T.BinaryType())])


def gathered(group: pd.DataFrame, name: str, kind: str, ascending: bool = False) -> np.ndarray:
    return np.concatenate([unpack(x, kind, ascending) for x in group[name]])


# Shards -----------------------------------------------------------------------------------------------------------------


def _write(folder: str, name: str, *parts: np.ndarray) -> None:
    """Arrays of 64-bit words in one file."""
    final, temporary = os.path.join(folder, name), os.path.join(folder, f".{name}-{uuid.uuid4().hex}")
    with open(temporary, "wb") as f:
        for p in parts:
            f.write(p.tobytes())
    os.replace(temporary, final)


def _whole(values: np.ndarray) -> np.ndarray:
    """Filled up to whole 64-bit words."""
    out = np.zeros(-(-len(values) * values.itemsize // 8) * 8 // values.itemsize, values.dtype)
    out[: len(values)] = values
    return out


class WordShard:
    """Level 1: hashes and counts of the words whose hash falls into the shard."""

    @staticmethod
    def write(folder: str, k: int, hashes: np.ndarray, counts: np.ndarray) -> None:
        _write(folder, f"level1-{k}", EliasFano.build(hashes), counts.astype("<u8"))

    def __init__(self, path: str):
        w = np.asarray(np.memmap(path, "<u8", "r"))
        self.hashes = EliasFano(w)
        self.counts = w[self.hashes.size : self.hashes.size + self.hashes.n]


class Nodes:
    """A shard of a level above 1: contexts, their children's words, quantised p and counts."""

    @staticmethod
    def write(folder: str, name: str, contexts: np.ndarray, rank: np.ndarray, words: np.ndarray, low: int, logs: np.ndarray, counts: np.ndarray | None) -> None:
        floor = float(logs.min())
        step = max((float(logs.max()) - floor) / 65535, 1e-12)
        children = EliasFano.build(rank.astype(np.uint64) << np.uint64(low) | words.astype(np.uint64), low, len(contexts))
        extra = [] if counts is None else [_whole(log_codes(counts))]
        _write(folder, name, EliasFano.build(contexts), children, np.array([floor, step]), _whole(np.round((logs - floor) / step).astype("<u2")), *extra)

    def __init__(self, path: str):
        w = np.asarray(np.memmap(path, "<u8", "r"))
        self.contexts = EliasFano(w)
        self.children = EliasFano(w[self.contexts.size :])
        at, n = self.contexts.size + self.children.size, self.children.n
        self.floor, self.step = w[at : at + 2].view("<f8").tolist()
        self.codes = w[at + 2 : at + 2 + -(-n // 4)].view("<u2")
        self.counts = w[at + 2 + -(-n // 4) :].view("<u2")

    def find(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each context's child with the word, and whether there is one. Equal contexts, and in them equal words, stand together."""
        new = np.concatenate([[True], contexts[1:] != contexts[:-1]])
        rank, there = self.contexts.successor(contexts[new])
        first, end = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        first[there], end[there] = self.children.bucket(rank[there])  # the pointers
        asked = new.copy()
        asked[1:] |= words[1:] != words[:-1]
        each = (np.cumsum(new) - 1)[asked]
        place, found = self.children.within(first[each], end[each], words[asked])
        back = np.cumsum(asked) - 1
        return place[back], found[back]


@lru_cache(maxsize=OPEN)
def _open(path: str) -> WordShard | Nodes:
    return (WordShard if os.path.basename(path).startswith("level1-") else Nodes)(path)


def by_shard(shard: np.ndarray, contexts: np.ndarray | None = None, words: np.ndarray | None = None):
    """(shard, places of its rows) in order of shard; rows with equal context, and among them with equal word, mostly stand together."""
    if contexts is None:
        order = np.argsort(shard, kind="stable")
    else:
        near = (contexts * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) << np.uint64(20) | words * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(44)
        order = np.argsort(shard.astype(np.uint64) << np.uint64(44) | near)
    edges = np.flatnonzero(np.concatenate([[True], shard[order[1:]] != shard[order[:-1]], [True]])) if len(order) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(shard[order[a]]), order[a:b]


def mixed(mix: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Hash of a context from that of its start and its last id."""
    out = (mix ^ ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ out >> np.uint64(29)


def spread(mix: np.ndarray, word: np.ndarray, shards: int) -> np.ndarray:
    """Shard of an n-gram: contexts are dealt by their hash, and each over a run of shards by a hash of the word."""
    run = max(1, shards // 8)
    own = (word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(run)
    return (((mix >> np.uint64(24)) % np.uint64(shards) + own) % np.uint64(shards)).astype(np.int64)


class Trie:
    """What a task needs to know of the files in ``folder``: shards of each level, nodes of the largest shard, totals."""

    def __init__(self, folder: str, order: int):
        self.folder, self.order = folder, order
        self.shards, self.width = [0] * (order + 1), [1] * (order + 1)
        self.n = self.v = self.docs = 0

    @property
    def start(self) -> int:
        """Id of the mark before each text."""
        return self.shards[1] * self.width[1]

    @property
    def low(self) -> int:
        """Bits that hold any id."""
        return self.start.bit_length()

    def level(self, k: int, shard: int):
        return _open(os.path.join(self.folder, f"level{k}-{shard}"))

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + ADD) / (self.n + ADD * (self.v + 1))

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id and count of each hash; UNKNOWN and 0 where there is none."""
        ids, counts = np.full(len(h), UNKNOWN, np.int64), np.zeros(len(h), np.int64)
        if self.v:
            step = np.uint64((1 << 64) // self.shards[1] + 1)
            for k, some in by_shard((h // step).astype(np.int64)):
                own = self.level(1, k)
                place, found = own.hashes.successor(h[some])
                ids[some[found]] = k * self.width[1] + place[found]
                counts[some[found]] = own.counts[place[found]]
        return ids, counts

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of ids; the start mark counts as many times as there are training texts."""
        out = np.where(ids == self.start, self.docs, 0)
        known = np.flatnonzero(ids < self.start)
        for k, some in by_shard(ids[known] // self.width[1]):
            some = known[some]
            out[some] = self.level(1, k).counts[ids[some] - k * self.width[1]]
        return out

    def find(self, k: int, contexts: np.ndarray, mix: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Node (-1: none), p and count of the children ``words`` of nodes of level k - 1; ``mix``: the contexts' hashes."""
        node, p, n = np.full(len(words), -1, np.int64), np.zeros(len(words)), np.zeros(len(words))
        if self.shards[k]:
            contexts, words = contexts.astype(np.uint64), words.astype(np.uint64)
            for s, some in by_shard(spread(mix, words, self.shards[k]), contexts, words):
                own = self.level(k, s)
                place, found = own.find(contexts[some], words[some])
                some, place = some[found], place[found]
                node[some], p[some] = s * self.width[k] + place, 10.0 ** (own.floor + own.step * own.codes[place])
                if k < self.order:
                    n[some] = decoded(own.counts[place])
        return node, p, n

    def walk(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Node and count of paths of ids that are in the trie."""
        node, mix = columns[0].astype(np.int64), mixed(np.zeros(len(columns[0]), np.uint64), columns[0])
        n = self.counts_of(node).astype(np.float64) if len(columns) == 1 else np.zeros(0)
        for k, ids in enumerate(columns[1:], 2):
            node, _, n = self.find(k, node, mix, ids)
            mix = mixed(mix, ids)
        return node, n


# Building ---------------------------------------------------------------------------------------------------------------


BLOCKS = T.StructType([T.StructField(n, T.BinaryType()) for n in ("doc_ids", "known_ids", "training", "sizes", "places", "hashes", "counts")])


def blocks(rows: DataFrame, every: int) -> DataFrame:
    """The texts in blocks: their tokens as places in the block's words, these words' hashes and their counts in training texts.

    Columns are little-endian arrays: ids (0 where ``known_ids`` is 0), whether a text is for training, tokens of each text.
    """

    def run(batches):
        words, held, parts = Words(), 0, []

        def out():
            places, training = np.concatenate([p for _, _, ps in parts for p in ps]), np.concatenate([t for _, t, _ in parts])
            sizes = np.array([len(p) for _, _, ps in parts for p in ps], "<u4")
            counts = np.bincount(places[np.repeat(training, sizes)], minlength=len(words.hashes)).astype("<u4")
            ids = [i for some, _, _ in parts for i in some]
            columns = [np.array([i or 0 for i in ids], "<i8"), np.array([i is not None for i in ids]), training, sizes, places, np.array(words.hashes, "<u8"), counts]
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], BLOCKS.names)

        for part, values in slices(batches):
            ids = part.column("doc_id").to_pylist()
            parts.append((ids, np.array([i is None or zlib.crc32(str(i).encode()) % every != 0 for i in ids]), [words.places(t) for t in values]))
            held += sum(map(len, parts[-1][2]))
            if held >= BLOCK:
                yield out()
                words, held, parts = Words(), 0, []
        if parts:
            yield out()

    return map_arrow(rows, run, BLOCKS)


def build_words(read: DataFrame, trie: Trie) -> None:
    """Level 1 of the blocks, and the totals."""
    folder = trie.folder
    flags = F.regexp_count(F.hex("training"), F.lit("01"))  # texts for training; a byte is 00 or 01
    trie.docs, tokens = read.agg(F.coalesce(F.sum(flags), F.lit(0)), F.coalesce(F.sum(F.length("places") / 4), F.lit(0))).first()
    shards = 2 + int(tokens // SHARD_TOKENS)
    step = np.uint64((1 << 64) // shards + 1)

    def deal(batches):
        for batch in batches:
            for h, c in zip(batch.column("hashes"), batch.column("counts"), strict=True):
                hashes, counts = np.frombuffer(h.as_py(), "<u8"), np.frombuffer(c.as_py(), "<u4")
                keys, n = summed(hashes[counts > 0], counts[counts > 0])
                if len(keys):
                    yield blobs((keys // step).astype(np.int64), [keys], n)

    def level(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        hashes, counts = summed(np.concatenate([unpack(x, "<u8", True) for x in group["c0"]]), gathered(group, "counts", "<u4").astype(np.int64))
        WordShard.write(folder, int(key[0]), hashes, counts)
        return pd.DataFrame({"n": [len(hashes)], "tokens": [int(counts.sum())]})

    for k in range(shards):  # a shard that no word falls into
        WordShard.write(folder, k, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    found = map_arrow(read.select("hashes", "counts"), deal, blob_schema(1))
    made = found.repartition(max(shards, 8), "shard").groupBy("shard").applyInPandas(level, "n long, tokens long")
    v, n, width = made.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.max("n"), F.lit(1))).first()
    trie.shards[1], trie.width[1], trie.v, trie.n = shards, max(1, width), v, n
    if trie.start >= UNKNOWN:
        raise ValueError(f"{v} distinct words are more than 32-bit ids can tell apart")


ENCODED = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("training", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("ids", T.BinaryType()))])


def encoded(read: DataFrame, trie: Trie) -> DataFrame:
    """Every text of the blocks as 32-bit word ids, the start mark first, with what only depends on the words."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                column = lambda name, kind: np.frombuffer(row[name], kind)  # noqa: B023, E731
                ids, counts = trie.words(column("hashes", "<u8"))
                places, sizes = column("places", "<u4"), column("sizes", "<u4").astype(np.int64)
                first = np.cumsum(sizes) - sizes
                stream = np.insert(ids[places], first, trie.start).astype("<u4")
                edges = pa.array(np.concatenate([[0], 4 * np.cumsum(sizes + 1)]), pa.int64())
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, edges.buffers()[1], pa.py_buffer(stream.tobytes())]).cast(pa.binary())
                known, base = np.add.reduceat((counts > 0).astype(np.int64)[places], first), np.add.reduceat(np.log10(trie.unigram(counts))[places], first)
                doc_ids = pa.array(column("doc_ids", "<i8"), mask=~column("known_ids", bool))
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(column("training", bool)), pa.array(sizes), pa.array(known), pa.array(base), raw], ENCODED.names)

    return map_arrow(read.drop("counts"), run, ENCODED)


def streams(batches, tokens: int):
    """Batches with about ``tokens`` ids each (one longer text stays whole), their ids, and where the texts' start marks stand."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column("ids")).to_numpy(zero_copy_only=False).astype(np.int64) // 4
        ends, begin = np.cumsum(sizes), 0
        while begin < len(sizes):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + tokens, side="right")))
            part = batch.slice(begin, end - begin)
            ids = np.frombuffer(b"".join(part.column("ids").to_pylist()), "<u4")
            yield part, ids, np.cumsum(sizes[begin:end]) - sizes[begin:end]
            begin = end


def _after(ids: np.ndarray, firsts: np.ndarray, k: int) -> np.ndarray:
    """Whether a whole n-gram of k tokens, start mark included, ends at each id."""
    out = np.ones(len(ids), bool)
    for i in range(k - 1):
        out[np.minimum(firsts + i, len(ids) - 1)] = False  # every text has a mark and an end
    return out


def ngrams(ids: np.ndarray, ends: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams of k ids that end at the given places, as columns in ascending order, and their counts."""
    columns, rank = [], ids[ends - k + 1].astype(np.uint64)
    for i in range(k - 2, -1, -1):
        key = rank << np.uint64(32) | ids[ends - i].astype(np.uint64)
        if i:
            distinct, back = np.unique(key, return_inverse=True)
            rank = back.astype(np.uint64)
        else:
            distinct, counts = np.unique(key, return_counts=True)
        before, last = (distinct >> np.uint64(32)).astype(np.int64), (distinct & np.uint64(0xFFFFFFFF)).astype("<u4")
        columns = [c[before] for c in columns] if columns else [before.astype("<u4")]
        columns.append(last)
    return columns, counts


def build_level(training: DataFrame, trie: Trie, k: int) -> None:
    """Level k >= 2 of the encoded texts."""
    shards, folder = int(trie.n // SHARD_TOKENS) + 1 if trie.n else 0, trie.folder
    trie.shards[k] = 0  # not there yet for the tasks that build it

    def count(batches):
        def out(held):
            ids, lengths = np.concatenate([x for x, _ in held]), np.cumsum([0, *(len(x) for x, _ in held)])
            firsts = np.concatenate([f + a for (_, f), a in zip(held, lengths, strict=False)])
            columns, counts = ngrams(ids, np.flatnonzero(_after(ids, firsts, k)), k)
            mix = np.zeros(len(counts), np.uint64)
            for c in columns[:-1]:
                mix = mixed(mix, c)
            return blobs(spread(mix, columns[-1], shards), columns, counts)

        held, n = [], 0
        for _, ids, firsts in streams(batches, BUFFER):
            held.append((ids, firsts))
            n += len(ids)
            if n >= BUFFER:
                yield out(held)
                held, n = [], 0
        if held:
            yield out(held)

    def level(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        columns = [gathered(group, f"c{i}", "<u4", i == 0) if i else np.concatenate([unpack(x, "<u4", True) for x in group["c0"]]) for i in range(k)]
        counts, ranks = gathered(group, "counts", "<u4").astype(np.int64), columns[0].astype(np.uint64)
        heads = [columns[0]]
        if k > 2:  # the distinct contexts, as columns, and the rank of each row's
            for c in columns[1:-1]:
                distinct, at, back = np.unique(ranks << np.uint64(32) | c.astype(np.uint64), return_index=True, return_inverse=True)
                ranks = back.astype(np.uint64)
            heads = [c[at] for c in columns[:-1]]
        else:
            heads[0], back = np.unique(columns[0], return_inverse=True)
            ranks = back.astype(np.uint64)
        keys, counts = summed(ranks << np.uint64(32) | columns[-1].astype(np.uint64), counts)
        ranks, words = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        walked = [trie.walk([h[i : i + SCORED] for h in heads]) for i in range(0, len(heads[0]), SCORED)]
        contexts, before = (np.concatenate([w[i] for w in walked]) for i in range(2))
        logs = np.log10(counts / (before + prior(before, k))[ranks])
        order = np.argsort(contexts)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        rows = np.argsort(place[ranks], kind="stable")
        Nodes.write(folder, f"level{k}-{int(key[0])}", contexts[order].astype(np.uint64), place[ranks][rows], words[rows], trie.low, logs[rows], counts[rows] if k < trie.order else None)
        return pd.DataFrame({"n": [len(words)]})

    if not shards:
        return
    found = map_arrow(training.select("ids"), count, blob_schema(k)).repartition(max(shards, 8), "shard")
    width = found.groupBy("shard").applyInPandas(level, "n long").agg(F.max("n")).first()[0]
    for s in range(shards):  # a shard that no n-gram falls into
        if not os.path.exists(os.path.join(folder, f"level{k}-{s}")):
            Nodes.write(folder, f"level{k}-{s}", np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), trie.low, np.zeros(1), np.zeros(0))
    trie.shards[k], trie.width[k] = shards, width


# Scoring ----------------------------------------------------------------------------------------------------------------


def log_probabilities(trie: Trie, ids: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """log10 P of every id in its text; 0 for the start marks."""
    node, known = ids.astype(np.int64), ids != UNKNOWN
    count = trie.counts_of(node).astype(np.float64)
    p = trie.unigram(count)
    node[~known] = -1
    mix = mixed(np.zeros(len(ids), np.uint64), ids)
    for k in range(2, trie.order + 1):
        at = np.flatnonzero(_after(ids, firsts, k))
        at = at[node[at - 1] >= 0]
        c = count[at - 1]
        weight = prior(c, k)
        p[at] *= weight / (c + weight)
        at = at[known[at]]
        new, more, n = trie.find(k, node[at - 1], mix[at - 1], ids[at])
        p[at] += more
        if k < trie.order:
            last, node, count = mix, np.full(len(ids), -1, np.int64), np.zeros(len(ids))
            node[at], count[at] = new, n
            mix = mixed(np.concatenate([last[:1], last[:-1]]), ids)
    p[firsts] = 1.0
    return np.log10(p)


RESULT = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()))])


def scores(docs: DataFrame, every: int = 10, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns from the rows not held out."""
    spark = docs.sparkSession
    folder = checkpoint_folder(spark, "ngram")
    trie = Trie(folder, order)

    def written(df: DataFrame, name: str, schema: T.StructType) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"file:{folder}/{name}")
        return spark.read.schema(schema).parquet(f"file:{folder}/{name}")

    with brief_shuffles(spark):
        read = written(blocks(texts(docs), every), "blocks", BLOCKS)
        build_words(read, trie)
        ids = written(encoded(read, trie), "ids", ENCODED)
        shutil.rmtree(f"{folder}/blocks", ignore_errors=True)
        for k in range(2, order + 1):
            build_level(ids.where("training"), trie, k)

    def run(batches):
        for part, stream, firsts in streams(batches, SCORED):
            score = np.add.reduceat(log_probabilities(trie, stream, firsts), firsts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.compute.invert(part.column("training")), *(part.column(c) for c in RESULT.names[2:-1]), pa.array(score)], RESULT.names)

    scored = map_arrow(ids, run, RESULT).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(trie.n).cast("long").alias("train_tokens"), "base_score", "score")
    out = checkpointed(scored)
    shutil.rmtree(folder, ignore_errors=True)
    return out
