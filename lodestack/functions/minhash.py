"""MinHash tokens: one hash, dealt into buckets, least per bucket, empty buckets filled by rotation."""

from __future__ import annotations

from collections.abc import Callable

import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 512


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f uses it, also inside lambdas."""
    return F.get(F.transform(F.array(value), f), 0)


def minhash_column(tokens: Column, buckets: int = BUCKETS) -> Column:
    """array<string> of ``bucket:hash``, one for each bucket; empty if there are no tokens."""
    hashes = F.array_distinct(F.transform(F.filter(tokens, lambda t: t.isNotNull()), lambda t: F.xxhash64(t)))
    ordered = F.array_sort(F.transform(hashes, lambda h: F.struct(F.pmod(h, F.lit(buckets)).cast("int").alias("b"), h.alias("h"))))
    # Sorted by (bucket, hash), the first of a bucket is its least; a bucket without one takes the next bucket's, round the ring.
    firsts = bound(ordered, lambda o: F.filter(o, lambda x, i: (i == 0) | (F.get(o, i - 1)["b"] != x["b"])))

    def fill(least: Column) -> Column:
        before = lambda i: F.when(i == 0, F.element_at(least, -1)["b"] - buckets).otherwise(F.get(least, i - 1)["b"])
        one = lambda x, i: F.transform(F.sequence(before(i) + 1, x["b"]), lambda b: F.concat_ws(":", F.pmod(b, F.lit(buckets)).cast("string"), x["h"].cast("string")))
        return F.when(F.size(least) > 0, F.flatten(F.transform(least, one))).otherwise(F.array().cast("array<string>"))

    return bound(firsts, fill)


def minhash_tokens(tokens: list, buckets: int = BUCKETS) -> list:
    """The same for query text."""
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) ^ 1 << 63) - (1 << 63)
    least: dict[int, int] = {}
    for h in sorted({signed(t) for t in tokens if t is not None}):
        least.setdefault(h % buckets, h)
    if not least:
        return []
    out, held = [], least[min(least)]
    for b in range(buckets - 1, -1, -1):
        held = least.get(b, held)
        out.append(f"{b}:{held}")
    return sorted(out)
