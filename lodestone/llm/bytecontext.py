"""Trees of preceding bytes: counts gathered in Spark, and vectorised walks.

A context of depth d is the d bytes before a position, the nearest first; before
a text stand zero bytes. A tree holds the most frequent contexts, ``nodes`` at
most; since a context is at least as frequent as its extensions, the tree is
closed. Each position belongs to the deepest node that matches it. All
statistics cover all texts given; only the number of nodes is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that are worked on at a time.
PIECE = 1 << 20
#: Distinct grams that a task gathers before it hands them over.
HELD = 2_000_000


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def pieces(texts: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes with ``depth`` bytes of context before each text, the places of real bytes, and their text.

    Texts are joined up to ``PIECE`` bytes; a longer one is cut, each part with its context.
    """
    parts: list[bytes] = []
    owners: list[int] = []
    size = 0
    for k, t in enumerate(texts):
        for at in range(0, len(t), PIECE):
            before = t[max(0, at - depth) : at]
            parts.append(bytes(depth - len(before)) + before + t[at : at + PIECE])
            owners.append(k)
            size += len(parts[-1])
            if size >= PIECE:
                yield _joined(parts, owners, depth)
                parts, owners, size = [], [], 0
    if parts:
        yield _joined(parts, owners, depth)


def _joined(parts: list[bytes], owners: list[int], depth: int):
    flat = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    real = np.ones(len(flat), bool)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for j in range(depth):
        real[starts + j] = False
    return flat, np.flatnonzero(real), np.repeat(np.array(owners), sizes - depth)


def grams(flat: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The byte at each place in the lowest eight bits, its context above, the nearest byte first."""
    code = flat[at].astype(np.int64)
    for j in range(1, depth + 1):
        code |= flat[at - j].astype(np.int64) << (8 * j)
    return code


class GramCounter:
    """Counts of grams; what is added is merged by one sort when it outgrows what is merged."""

    def __init__(self):
        self._codes, self._counts, self._new, self._size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

    def add(self, code: np.ndarray) -> None:
        self._new.append(np.unique(code, return_counts=True))
        self._size += len(self._new[-1][0])
        if self._size > max(HELD // 2, len(self._codes)):
            self._merge()

    def _merge(self) -> None:
        codes = np.concatenate([self._codes, *(c for c, _ in self._new)])
        counts = np.concatenate([self._counts, *(n for _, n in self._new)])
        order = np.argsort(codes, kind="stable")  # runs that are sorted already
        codes, counts = codes[order], counts[order]
        first = np.flatnonzero(np.r_[len(codes) > 0, codes[1:] != codes[:-1]][: len(codes)])
        self._codes, self._counts = codes[first], np.add.reduceat(counts, first) if len(first) else counts
        self._new, self._size = [], 0

    def __len__(self) -> int:
        """Grams held, those not merged yet counted each."""
        return len(self._codes) + self._size

    @property
    def codes(self) -> np.ndarray:
        self._merge()
        return self._codes

    @property
    def counts(self) -> np.ndarray:
        self._merge()
        return self._counts


def tree(counts: DataFrame, depth: int, nodes: int, by: list[str] = (), weight: str = "n") -> tuple[pd.DataFrame, pd.DataFrame]:
    """Contexts ``depth, ctx, n`` of the tree, and ``depth, ctx, sym, n`` (and ``by``) of its nodes, from ``code, n`` (and ``by``).

    weight: SQL by whose sum the contexts are chosen. Both are bounded by ``nodes``; they are what the driver gets.
    """
    deep = counts.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    mask = F.expr("case " + " ".join(f"when depth = {d} then {(1 << (8 * d)) - 1}L" for d in range(depth + 1)) + " end")
    deep = deep.select("depth", F.shiftright("code", 8).bitwiseAND(mask).alias("ctx"), F.col("code").bitwiseAND(F.lit(255)).cast("int").alias("sym"), "n", F.expr(weight).alias("w"), *by)
    chosen = deep.groupBy("depth", "ctx").agg(F.round(F.sum("w"), 12).alias("n")).orderBy(F.desc("n"), "depth", "ctx").limit(nodes).toArrow().to_pandas()
    own = counts.sparkSession.createDataFrame(chosen[["depth", "ctx"]]) if len(chosen) else None
    if own is None:
        return chosen, pd.DataFrame({"depth": [], "ctx": [], "sym": [], "n": []} | {b: [] for b in by})
    seen = deep.join(F.broadcast(own), ["depth", "ctx"]).groupBy("depth", "ctx", "sym", *by).agg(F.sum("n").alias("n")).toArrow().to_pandas()  # `nodes` bounds both
    return chosen, seen


class ContextTree:
    """Node numbers by (depth, context), in the order of depth; node 0 is the root."""

    def __init__(self, chosen: pd.DataFrame):
        rows = chosen.sort_values(["depth", "ctx"]) if len(chosen) else pd.DataFrame({"depth": [0], "ctx": [0]})
        self.depth = rows["depth"].to_numpy(np.int64)
        self.ctx = rows["ctx"].to_numpy(np.int64)
        self.number = {(int(d), int(c)): i for i, (d, c) in enumerate(zip(self.depth, self.ctx, strict=True))}
        self.most = int(self.depth.max())
        n = len(self.depth)
        self.parent = np.zeros(n, np.int64)
        # row i + n is a node past whose depth no context goes on: it leads to itself
        self.child = np.repeat(np.arange(n, 2 * n, dtype=np.int32), 256).reshape(n, 256)
        for i in range(1, n):
            d, c = int(self.depth[i]), int(self.ctx[i])
            p = self.number[d - 1, c & ((1 << (8 * (d - 1))) - 1)]
            self.parent[i] = p
            self.child[p, c >> (8 * (d - 1))] = i
        self.child = np.concatenate([self.child, np.repeat(np.arange(n, 2 * n, dtype=np.int32), 256).reshape(n, 256)]).ravel()
        self.n = n

    def cells(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """256 * deepest node + byte, for each place."""
        node = np.zeros(len(at), np.int32)
        for j in range(1, self.most + 1):
            node = self.child[(node << 8) + flat[at - j]]
        node = np.where(node >= self.n, node - self.n, node)
        return (node << 8) + flat[at]

    def dense(self, seen: pd.DataFrame) -> np.ndarray:
        """Counts of the next byte at each node."""
        out = np.zeros((self.n, 256))
        at = [self.number[d, c] for d, c in zip(seen["depth"].astype(int), seen["ctx"].astype(int), strict=True)]
        out[np.array(at, np.int64), seen["sym"].to_numpy(np.int64)] = seen["n"].to_numpy(np.float64)
        return out
