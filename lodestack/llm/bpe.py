"""Byte-level BPE read from a tokenizers .json file: merge list, lookahead bound, word encoder.

Nothing here is trained and no vocabulary is shipped: the file's path is a parameter.
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import regex


def byte_to_char() -> dict[int, str]:
    """The usual printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, spare = {b: chr(b) for b in keep}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return out


#: Fixed value: the pre-tokenizer pattern of byte-level BPE files with "use_regex".
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class BytePairModel:
    """Merges and vocabulary as bytes. ``lookahead`` is the number of bytes after which a boundary can't move."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path}: only byte-level BPE without normalizer and prefix space is supported")
        back = {c: b for b, c in byte_to_char().items()}
        as_bytes = lambda s: bytes(back[c] for c in s)
        self.ids = {as_bytes(s): i for s, i in model["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens must be plain strings")
        self.text = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        pairs = [tuple(map(as_bytes, m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        self.merges = pairs
        self.ranks = {(self.ids[a], self.ids[b]): (r, self.ids[a + b]) for r, (a, b) in enumerate(pairs)}
        self.parts = {new: (r, a, b) for (a, b), (r, new) in reversed(self.ranks.items())}  # how each token was made
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.longest = max(map(len, self.ids))
        self.words = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @property
    @lru_cache(maxsize=1)  # noqa: B019
    def lookahead(self) -> int:
        """Sufficient lookahead of the merge list, in bytes.

        Two texts that agree up to position n start with the same segmentation, and only boundaries near n can come to
        differ. Applying the rules in order, rule (a, b) takes away the last common boundary e only if a ends and b
        begins there; the next candidate is e - len(a). From then on the token that begins there has a on its left
        spine, so a later rule (c, d) can only move on if some such a is on the left spine of d. The longest chain,
        weighed by len(a), bounds how far a change reaches to the left.
        """
        left = {a + b: a for a, b in reversed(self.merges)}
        reach: dict[bytes, int] = {}
        most = 0
        for a, b in self.merges:
            t, before = b, 0
            while t is not None:
                before = max(before, reach.get(t, 0))
                t = left.get(t)
            far = len(a) + before
            if far > reach.get(a, 0):
                reach[a] = far
            most = max(most, far)
        return most

    def fits(self, u: int, t: int) -> bool:
        """Whether the joined bytes of two tokens are cut just between them.

        Their merges are undone latest first. If the two pieces that then meet could have merged before the last one
        undone was made, the merge order would have crossed the cut. Of equal rules the left one is applied first.
        """
        ranks, parts, limit, none = self.ranks, self.parts, 1 << 60, (-1, 0, 0)
        while True:
            pair = ranks.get((u, t))
            if pair is not None and pair[0] < limit:
                return False
            left, right = parts.get(u, none), parts.get(t, none)
            if left[0] > right[0]:
                limit, u = left[0], left[2]
            elif right[0] >= 0:
                limit, t = right[0] + 1, right[1]
            else:
                return True

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one pre-token, by merging the lowest-ranked pair first, leftmost on ties."""
        if len(raw) > 48:
            return self.merge_long(raw)
        ids, ranks = [self.byte_ids[b] for b in raw], self.ranks
        while len(ids) > 1:
            best = None
            for i, pair in enumerate(zip(ids, ids[1:], strict=False)):
                r = ranks.get(pair)
                if r is not None and (best is None or r[0] < best[0]):
                    best, at = r, i
            if best is None:
                break
            pair, new, out, i, n = (ids[at], ids[at + 1]), best[1], ids[:at], at, len(ids)
            while i < n:
                if i + 1 < n and (ids[i], ids[i + 1]) == pair:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids


    def merge_long(self, raw: bytes) -> list[int]:
        """The same with a heap of the pairs, in time about proportional to the length."""
        ids, ranks, n = [self.byte_ids[b] for b in raw], self.ranks, len(raw)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1]))) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            pair = ranks.get((ids[i], ids[j])) if j < n else None
            if pair is None or pair[0] != rank:
                continue  # one of the two has been merged since
            ids[i], ids[j], after[i] = pair[1], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get((ids[i], ids[after[i]]))) is not None:
                    heappush(heap, (r[0], i))
            if before[i] >= 0 and (r := ranks.get((ids[before[i]], ids[i]))) is not None:
                heappush(heap, (r[0], before[i]))
        return [x for x in ids if x >= 0]


@lru_cache(maxsize=2)
def load(path: str) -> BytePairModel:
    return BytePairModel(path)
