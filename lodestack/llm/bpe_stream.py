"""Operator 4: BPE encoding and decoding by a bounded-lookahead streaming transducer.

Encoding reads a text piece by piece. Pre-token boundaries lie wherever white space follows something else, so a piece
that ends there is settled. Inside one unbroken pre-token the merge list's sufficient lookahead (``BytePairModel.
lookahead``) tells how far back more input can still move a boundary: tokens that end before it are emitted, the bytes
after the last of them are kept. Beside the text itself, memory is one piece, the lookahead and a word cache of fixed size, however
long the text, also where it has no white space at all: ids are handed out GIVEN at a time.

Decoding maps ids to bytes and feeds them to an incremental UTF-8 state machine that holds at most three bytes.

Defined results: null text is empty text (no ids, hash of nothing); repeated ids and rows are kept; an empty table gives
an empty result; other columns are ignored. Strings of special tokens inside texts become their special ids.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import BytePairModel, load
from .common import map_arrow, slices, texts

PIECE = 1 << 16
CACHE = 600_000
#: Ids handed out at a time where a piece is longer than PIECE twice.
GIVEN = 4096
_cut = regex.compile(r"(?<=\S)(?=\s)")  # white space as the pre-tokenizer knows it


class WordCache(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers; at most CACHE entries."""

    def __init__(self, model: BytePairModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        out = np.array(self.model.merge(raw) if len(raw) <= 4 * self.model.lookahead else list(stream_word(self.model, [raw])), "<u4").tobytes()
        if len(self) < CACHE and len(word) < 64:
            self[word] = out
        return out


def stream_word(model: BytePairModel, chunks: Iterable[bytes]) -> Iterator[int]:
    """Ids of one pre-token that comes in chunks, each as soon as it is stable."""
    step, kept = 4 * model.lookahead, b""
    for chunk in chunks:
        for i in range(0, len(chunk), step):
            kept += chunk[i : i + step]
            end = 0
            for token in model.merge(kept):
                if end + len(model.text[token]) > len(kept) - model.lookahead:
                    break
                end += len(model.text[token])
                yield token
            kept = kept[end:]
    yield from model.merge(kept)


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Parts of about ``size``, cut only where white space follows something else."""
    begin = 0
    while len(text) - begin > size:
        m = _cut.search(text, begin + size)
        if not m:
            break
        yield text[begin : m.start()]
        begin = m.start()
    yield text[begin:] if begin else text


_caches: dict[str, WordCache] = {}


class Encoder:
    def __init__(self, path: str):
        self.model = load(path)
        self.cache = _caches.setdefault(path, WordCache(self.model))
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in self.model.special.items()}

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as bytes, four each, piece by piece."""
        parts = self.model.specials.split(text) if any(s in text for s in self.special) else [text]
        for part in parts:
            if part in self.special:
                yield self.special[part]
            elif part:
                for piece in pieces(part):
                    if len(piece) <= 2 * PIECE:
                        yield b"".join(map(self.cache.__getitem__, self.model.words.findall(piece)))
                    else:
                        yield from self._unbroken(piece)

    def _unbroken(self, piece: str) -> Iterator[bytes]:
        """Ids of a piece without a place to cut: short pre-tokens some at a time, a long one as its tokens become stable."""
        held: list[bytes] = []
        for m in self.model.words.finditer(piece):
            if m.end() - m.start() > PIECE:
                yield b"".join(held)
                held = []
                parts = (piece[i : min(i + PIECE, m.end())].encode() for i in range(m.start(), m.end(), PIECE))
                for ids in batched(stream_word(self.model, parts), GIVEN):
                    yield np.array(ids, "<u4").tobytes()
            else:
                held.append(self.cache[m[0]])
                if len(held) >= GIVEN:
                    yield b"".join(held)
                    held = []
        yield b"".join(held)


class Decoder:
    """Incremental: ids in, text out as soon as its bytes are complete. Bytes that are no UTF-8 become U+FFFD."""

    def __init__(self, model: BytePairModel):
        self.table = [model.text.get(i, b"") for i in range(max(model.text) + 1)]
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        return self.machine.decode(b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())))

    def end(self) -> str:
        out = self.machine.decode(b"", True)
        self.machine.reset()
        return out


RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: token count, hash of the ids, hash of the text decoded from them."""

    def run(batches):
        encoder = Encoder(path)
        decoder = Decoder(encoder.model)
        for part, values in slices(batches):
            out = []
            for text in values:
                n, ids, back = 0, hashlib.sha256(), hashlib.sha256()
                for some in encoder.encode(text):
                    n += len(some) // 4
                    ids.update(some)
                    back.update(decoder.feed(some).encode())
                back.update(decoder.end().encode())
                out.append((n, ids.hexdigest(), back.hexdigest()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string())))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(texts(docs), run, RESULT)


def encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """All columns of ``docs`` and ``out_col`` array<int>; a column of that name is replaced."""
    docs = docs.drop(out_col)

    def run(batches):
        encoder = Encoder(path)
        for part, values in slices(batches, column=text_col):
            ids = [np.frombuffer(b"".join(encoder.encode(t)), "<u4").astype("i4") for t in values]
            ends = np.cumsum([0, *map(len, ids)])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))], [*part.schema.names, out_col])

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))]))


def decode(docs: DataFrame, path: str, ids_col: str = "token_ids", out_col: str = "text") -> DataFrame:
    """All other columns and ``out_col``, the text of the ids in ``ids_col`` (null: empty)."""
    docs = docs.drop(*({out_col} - {ids_col}))
    keep = [c for c in docs.columns if c != ids_col]

    def run(batches):
        decoder = Decoder(load(path))
        for batch in batches:
            at = batch.schema.names.index(ids_col)
            out = [decoder.feed(np.array(x or [], "<u4").tobytes()) + decoder.end() for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in keep), pa.array(out, pa.string())], [*keep, out_col])

    return map_arrow(docs, run, T.StructType([*(docs.schema[c] for c in keep), T.StructField(out_col, T.StringType())]))
