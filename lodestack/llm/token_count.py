"""Operator 8: token counts from a compiled finite-state transducer.

The merge list is compiled, as far as the input needs it, into a deterministic transducer over bytes. A state holds the
ends at which a longer token could still begin (suffixes that are a prefix of some token), with the last token before
each and the count so far relative to the least of them; two prefixes with the same state continue alike. Every transition
is annotated with the tokens that became certain (the rise of that least count), every state with those still due if the
word ends there. Tables are numpy arrays and all chunks of a batch step through them together.

A chunk is a pre-token, so it sends any entry state s to (its exit state, due(s) + its count): such maps compose
associatively, and a prefix scan (cumulative sum) over all chunks of a batch gives every document's count as a difference.

Defined results: null and empty texts have 0 bytes and 0 tokens; rows are kept as often as they occur; an empty table gives
an empty result; other columns are ignored. Strings of special tokens count as one token. A very long text is cut where white space
follows something else, and its pieces are counted PIECES characters at a time; memory is in proportion to that, or to the longest
stretch without such a place.
"""

from __future__ import annotations

from struct import iter_unpack, pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import BytePairModel, load
from .bpe_stream import pieces
from .common import map_arrow, slices, texts

#: States after which the compiled part is dropped between batches and compiled anew as needed.
STATES = 400_000
#: Characters whose chunks step through the transducer together.
PIECES = 500_000
LETTER, NUMBER, OTHER, SPACE, END = range(5)
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Kind of every code point, as the pre-tokenizer's pattern sees it."""
    if not _kinds:
        out = np.full(0x110000, OTHER, np.uint8)
        every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(0x110000))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                out[m.start() : m.end()] = kind
        _kinds.append(out)
    return _kinds[0]


class Transitions:
    """Open-addressing table in numpy: state << 8 | byte -> next state << 8 | tokens emitted."""

    def __init__(self, bits: int = 16):
        self.bits, self.used = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none."""
        slot, mask = self._slot(keys), len(self.keys) - 1
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        rest = np.flatnonzero((there != keys) & (there != -1))
        while rest.size:
            slot[rest] = slot[rest] + 1 & mask
            there = self.keys[slot[rest]]
            hit = there == keys[rest]
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit & (there != -1)]
        return out

    def put(self, keys: list[int], values: list[int]) -> None:
        while 2 * (self.used + len(keys)) > len(self.keys):
            old = Transitions(self.bits + 1)
            full = self.keys != -1
            old._put(self.keys[full].tolist(), self.values[full].tolist())
            self.bits, self.keys, self.values = old.bits, old.keys, old.values
        self._put(keys, values)
        self.used += len(keys)

    def _put(self, keys: list[int], values: list[int]) -> None:
        mask, table = len(self.keys) - 1, self.keys
        for key, slot, value in zip(keys, self._slot(np.array(keys, np.int64)).tolist(), values, strict=True):
            while table[slot] != -1:
                slot = slot + 1 & mask
            table[slot], self.values[slot] = key, value


class Transducer:
    def __init__(self, model: BytePairModel):
        self.model = model
        self.prefixes = {b[:k] for b in model.ids for k in range(1, len(b))}
        self.reset()

    def reset(self) -> None:
        self.number: dict[bytes, int] = {}
        self.states: list[bytes] = []
        self.due: list[int] = []
        self.table = Transitions()
        self._state(b"", [(0, -1, 0)])

    def _state(self, suffix: bytes, ends: list[tuple[int, int, int]]) -> int:
        packed = bytes([len(ends)]) + pack(f"<{3 * len(ends)}i", *(x for end in ends for x in end)) + suffix
        n = self.number.setdefault(packed, len(self.states))
        if n == len(self.states):
            self.states.append(packed)
            self.due.append(ends[-1][2])
        return n

    def compile(self, state: int, byte: int) -> int:
        packed = self.states[state]
        ends, suffix = list(iter_unpack("<3i", packed[1 : 1 + 12 * packed[0]])), packed[1 + 12 * packed[0] :] + bytes([byte])
        n, ids, fits = len(suffix), self.model.ids, self.model.fits
        token, count = next((t, c + 1) for back, before, c in ends if (t := ids.get(suffix[n - back - 1 :])) is not None and (before < 0 or fits(before, t)))
        ends = [(back + 1, before, c) for back, before, c in ends if suffix[n - back - 1 :] in self.prefixes]
        ends.append((0, token, count))
        least = min(c for _, _, c in ends)
        return self._state(suffix[n - ends[0][0] :] if ends[0][0] else b"", [(back, before, c - least) for back, before, c in ends]) << 8 | least

    def run(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Token counts of the chunks raw[start : start + size]."""
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        state, count = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        live = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")  # chunks longer than t
        for t, n in enumerate(live.tolist()):
            key = state[:n] << 8 | raw[starts[:n] + t]
            step = self.table.get(key)
            if (missing := np.flatnonzero(step < 0)).size:
                new = np.unique(key[missing]).tolist()
                self.table.put(new, [self.compile(k >> 8, k & 255) for k in new])
                step[missing] = self.table.get(key[missing])
            state[:n] = step >> 8
            count[:n] += step & 255
        out = np.empty(len(order), np.int64)
        out[order] = count + np.array(self.due)[state]
        return out


def chunk_starts(code: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True where a pre-token begins. ends: where the mark after each text stands; marks begin one too.

    The pattern looks at most two characters ahead, so every flag depends on a window of a few characters.
    """
    kind = kinds()[code]
    kind[ends] = END
    n = len(kind)
    out = np.ones(n, bool)
    out[1:] = kind[1:] != kind[:-1]
    after = np.flatnonzero((kind[1:] < SPACE) & (kind[:-1] == SPACE)) + 1  # the last of some spaces stands alone or leads the next word
    out[after - 1] = True
    out[after] = code[after - 1] != 0x20
    at = np.flatnonzero((code == 0x27) & out & (kind == OTHER))
    at = at[at + 3 < n] if n else at
    a, b = code[at + 1], code[at + 2]
    ok1, ok2 = kind[at + 1] == LETTER, kind[at + 2] == LETTER
    one = ok1 & np.isin(a, [ord(c) for c in "stmd"])
    two = ok1 & ok2 & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
    out[at[one | two] + 1] = False
    out[at[one] + 2] = True
    out[at[two] + 2] = False
    out[at[two] + 3] = True
    out[ends] = True
    return out


class Counter:
    def __init__(self, path: str):
        self.model = load(path)
        self.machine = Transducer(self.model)

    def counts(self, values: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if len(self.machine.states) > STATES:
            self.machine.reset()
        extra, owner, parts, held = np.zeros(len(values), np.int64), [], [], 0
        for i, text in enumerate(values):
            split = self.model.specials.split(text) if self.model.specials and any(s in text for s in self.model.special) else [text]
            for part in split:
                if part in self.model.special:
                    extra[i] += 1
                else:
                    for piece in pieces(part):
                        if held + len(piece) > PIECES and parts:
                            self._count(extra, owner, parts)
                            owner, parts, held = [], [], 0
                        owner.append(i)
                        parts.append(piece)
                        held += len(piece)
        if parts:
            self._count(extra, owner, parts)
        return extra

    def _count(self, extra: np.ndarray, owner: list[int], parts: list[str]) -> None:
        """Adds the tokens of the parts to their owners'."""
        joined = "\0".join(parts) + "\0\0\0\0"
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        marks = np.concatenate([ends, np.arange(len(code) - 3, len(code))])
        first = np.flatnonzero(chunk_starts(code, marks))
        width = 1 + (code >= 0x80).astype(np.int8) + (code >= 0x800) + (code >= 0x10000)
        at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        raw = np.frombuffer(joined.encode(), np.uint8)
        starts, sizes = at[first], np.diff(np.append(at[first], at[-1]))
        sizes[np.searchsorted(first, marks)] = 0
        scan = np.concatenate([[0], np.cumsum(self.machine.run(raw, starts, sizes))])
        upto = scan[np.searchsorted(first, ends)]
        np.add.at(extra, owner, np.diff(np.concatenate([[0], upto])))


RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every text."""

    def run(batches):
        if path not in _counters:
            _counters[path] = Counter(path)
        counter = _counters[path]
        for part, values in slices(batches, 500_000):
            n = counter.counts(values)
            size = pa.compute.binary_length(part.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(n), pa.array(n > limit)], RESULT.names)

    return map_arrow(texts(docs), run, RESULT)
