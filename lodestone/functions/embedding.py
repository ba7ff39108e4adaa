"""Embedders: functions from a text column to a column of float arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.views import tokens

Embedder = Callable[[Column], Column]


def hashing(dim: int = 64) -> Embedder:
    """Counts of tokens by hash, signed by another bit of it, to length one; all zero for a text without tokens.

    Tokens are hashed as expressions and counted in Arrow batches: expressions would go over all tokens for each number.
    """

    @F.pandas_udf("array<float>")
    def counted(hashes: pd.Series) -> pd.Series:
        flat = np.concatenate([np.zeros(0, np.int64), *hashes])
        row = np.repeat(np.arange(len(hashes)), hashes.map(len).to_numpy(np.int64))
        raw = np.bincount(row * dim + flat % dim, np.where(flat < 0, -1.0, 1.0), len(hashes) * dim).reshape(-1, dim)
        norm = np.sqrt((raw * raw).sum(1, keepdims=True))
        return pd.Series(list((raw / np.where(norm > 0, norm, 1.0)).astype(np.float32)))

    return lambda text: counted(F.transform(tokens(F.coalesce(text, F.lit(""))), lambda t: F.xxhash64(t)))


def batched(model: Callable[[list[str]], list[list[float]]], size: int = 512) -> Embedder:
    """An embedder of a Python model that takes lists of at most ``size`` texts; null texts count as empty."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        plain = texts.fillna("").tolist()
        return pd.Series([v for i in range(0, len(plain), size) for v in model(plain[i : i + size])])

    return embed
