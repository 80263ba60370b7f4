"""Sign bits of random directions (SuperBit) and cosine similarity."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=64)
def directions(dim: int, batches: int, seed: int) -> np.ndarray:
    """dim * batches directions, orthogonal within a batch."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0].T for _ in range(batches)])


def signature(vector: Sequence[float], p: Any) -> list[bool]:
    if len(vector) != p.input_dim:
        raise ValueError(f"{p.name}: the vector has {len(vector)} components instead of {p.input_dim}")
    return (directions(p.input_dim, p.batches, p.seed) @ np.array(vector, float) >= 0).tolist()


def signature_column(vectors: Column, p: Any) -> Column:
    """array<boolean>; null for null vectors, an error for vectors of another length."""
    dim, batches, seed = p.input_dim, p.batches, p.seed

    @F.pandas_udf("array<boolean>")
    def run(some: pd.Series) -> pd.Series:
        there = some.notna()
        out = pd.Series([None] * len(some), index=some.index, dtype=object)
        if there.any():
            bits = np.stack([np.asarray(v, float) for v in some[there]]) @ directions(dim, batches, seed).T >= 0
            out[there] = pd.Series(list(bits), index=some.index[there])
        return out

    return run(vectors.cast("array<double>"))


def agreement(bits: Column, asked: list[bool]) -> Column:
    """Number of equal bits."""
    other = F.lit(asked)
    return F.aggregate(F.zip_with(bits, other, lambda a, b: (a == b).cast("int")), F.lit(0), lambda acc, x: acc + x)


def least_agreement(similarity: float, p: Any) -> int:
    return int((1 - math.acos(similarity) / math.pi) * p.input_dim * p.batches)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
