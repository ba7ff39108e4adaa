"""Cosine self-join of vectors, pruned by cells around pivots.

On the unit sphere a cosine of ``least`` or more is a distance of ``r`` or less. Each
vector belongs to the cell of its nearest pivot. A pair over two cells lies within ``r``
of the plane halfway between their pivots, so a vector is also a guest in those cells of
smaller number whose plane is that near, and nowhere else; each pair is met once. Inside a
cell, rings of width ``r`` around the pivot meet their neighbours only (triangle
inequality). A ring of a cell that is still large is cut into blocks, and its pairs of
blocks are tasks of their own, so no task holds more than two blocks. How many pivots pay is
estimated on a bounded sample (``worth``).

Equal vectors are joined as one: of each set of copies the least id stands for all.
``near_edges`` links copies to it and is linear in them; ``near_pairs`` gives every pair,
which for copies is quadratic by nature.

Pruning depends on the vectors: where they cluster, few cells are near each other; where
all distances are alike (random vectors of many dimensions and a small ``least``), no exact
method can leave out much, and the comparisons are products of matrices of two blocks.

Defined results: null, zero and not finite vectors, and those with a null inside, pair with
nothing; vectors of different lengths neither.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.views import dot, sized, stored

#: Vectors of one side in a task and their bytes, at most; rows of a tile of products; pivots, and their bytes, at most.
BLOCK, BLOCK_BYTES, TILE, PIVOTS, PIVOT_BYTES = 20_000, 16 << 20, 256, 1024, 8 << 20
#: Comparisons that cost as much as one more copy of a vector, about.
COPY = 120
#: Room for rounding in distances.
SLACK = 1e-6
#: Radius from which rings around a pivot are too wide to help.
WIDE = 0.5


@dataclass
class Cells:
    """``rows``: ``vec_id, embedding, cell, bin, home``, a row a cell that the vector is in; ``sizes``: ``cell, bin, h, o``, what meets there."""

    rows: DataFrame
    sizes: DataFrame
    rings: bool
    block: int


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding, norm`` of the vectors that can be near others."""
    v = vectors.select("vec_id", "embedding", F.sqrt(dot(F.col("embedding"), F.col("embedding"))).alias("norm"))
    return v.where((F.col("norm") > 0) & (F.col("norm") < float("inf")))


def classes(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding, n``: one of each set of equal vectors, the least id, and how many there are."""
    return stored(usable(vectors).groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")).select("vec_id", "embedding", "n"), "vector-classes")


def members(vectors: DataFrame, reps: DataFrame) -> DataFrame:
    """``rep, vec_id``: the vectors that have copies, with the one that stands for them, itself too."""
    many = reps.where("n > 1").select(F.col("vec_id").alias("rep"), "embedding")
    return usable(vectors).join(sized(stored(many, "vector-copies")), "embedding").select("rep", "vec_id")


def _matrix(column) -> np.ndarray:
    lists = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def radius(least: float) -> float:
    """The distance on the unit sphere at which a cosine rounds to ``least``, with room for rounding."""
    return math.sqrt(max(0.0, 2 - 2 * (least - SLACK))) + SLACK


def _inside(d2: np.ndarray, between: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Of squared distances to pivots: the cell of each vector, and in which cells it is, as a guest or at home."""
    own = d2.argmin(1)
    gap = d2 - d2[np.arange(len(own)), own][:, None]
    inside = (gap <= 2 * (r + SLACK) * between[own] + SLACK) & (np.arange(d2.shape[1]) < own[:, None])
    inside[np.arange(len(own)), own] = True
    return own, inside


def _distances(p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))


def worth(sample: np.ndarray, n: int, r: float, most: int) -> int:
    """How many of the first ``most`` of some unit vectors to take as pivots: what costs ``n`` vectors like these the least.

    More pivots compare less and copy more; where nothing is near its own kind only, one pivot is best.
    """
    best, most = (float("inf"), 1), max(1, min(most, len(sample)))
    for k in sorted({most, *(1 << b for b in range(most.bit_length()))}):
        p = sample[:k]
        own, inside = _inside(np.maximum(0, 2 - 2 * sample @ p.T), _distances(p), r)
        pairs = float(np.bincount(own, minlength=k) @ inside.sum(0)) / len(sample) ** 2
        cost = pairs * n * n * (1 + 2 * COPY / BLOCK) + COPY * n * inside.sum() / len(sample)
        best = min(best, (cost, k))
    return best[1]


def cells(reps: DataFrame, least: float, pivots: int | None = None) -> Cells:
    """Put ``vec_id, embedding`` (distinct vectors) into cells for a join at ``least``."""
    n, longest = reps.agg(F.count("*"), F.max(F.size("embedding"))).first()
    room = max(1, min(PIVOTS, PIVOT_BYTES // (8 * max(1, longest or 1))))
    most = min(pivots or math.ceil(2 * math.sqrt(n)), room)
    chosen = reps.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most if pivots else room).select("embedding").collect()  # PIVOTS rows at most
    by_size, r = {}, radius(least)
    for (e,) in chosen:
        by_size.setdefault(len(e), []).append(e)
    placed, first = {}, 0
    for size, some in by_size.items():  # numbers of cells go on from one length to the next
        p = _unit(np.array(some, np.float64))
        p = p if pivots else p[: worth(p, n, r, most)]
        placed[size] = (first, p, _distances(p))
        first += len(p)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = whole.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(lengths).tolist():
                b = whole.filter(pa.array(lengths == size))
                if size not in placed:
                    at, cell, near, home = np.arange(b.num_rows), np.full(b.num_rows, -size), np.zeros(b.num_rows), np.ones(b.num_rows, bool)
                else:
                    start, p, between = placed[size]
                    d2 = np.maximum(0, 2 - 2 * _unit(_matrix(b.column("embedding"))) @ p.T)
                    own, inside = _inside(d2, between, r)
                    at, local = np.nonzero(inside)
                    cell, near, home = local + start, np.sqrt(d2[at, local]), local == own[at]
                out = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, pa.array(cell, pa.int32()), pa.array(near), pa.array(home)], ["vec_id", "embedding", "cell", "d", "home"]
                )

    kinds = {f.name: f.dataType.simpleString() for f in reps.schema}
    rows = reps.select("vec_id", "embedding").mapInArrow(place, f"vec_id {kinds['vec_id']}, embedding {kinds['embedding']}, cell int, d double, home boolean")
    rings = r < WIDE
    rows = stored(rows.withColumn("bin", F.floor(F.col("d") / (r + SLACK)).cast("int") if rings else F.lit(0)).drop("d"), "vector-cells")
    here = rows.groupBy("cell", "bin").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("all"))
    met = here.select("cell", F.explode(_near(rings)).alias("bin"), "all").groupBy("cell", "bin").agg(F.sum("all").alias("o"))
    sizes = here.where("homes > 0").select("cell", "bin", F.col("homes").alias("h")).join(met, ["cell", "bin"])
    return Cells(rows, stored(sizes, "vector-cell-sizes"), rings, max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, longest or 1)))))


def _near(rings: bool) -> Column:
    """The rings that a vector of a ring may meet."""
    return F.sequence(F.col("bin") - 1, F.col("bin") + 1) if rings else F.array("bin")


def compared(c: Cells) -> int:
    """How many pairs are compared: both orders of two vectors at home in a cell, one of a guest."""
    return c.sizes.agg(F.sum(F.col("h") * F.col("o"))).first()[0] or 0


def rep_pairs(c: Cells, least: float) -> DataFrame:
    """``a, b, similarity`` of the vectors in cells, ``a < b``, whose rounded cosine is at least ``least``."""
    cut = lambda n: F.ceil(F.col(n) / c.block).cast("int")
    sizes = sized(c.sizes.select("cell", "bin", cut("h").alias("nh"), cut("o").alias("no")))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = c.rows.where("home").join(sizes, ["cell", "bin"]).select("cell", "bin", block("nh").alias("hb"), others("no").alias("ob"), F.lit(True).alias("asks"), "home", "vec_id", "embedding")
    meets = c.rows.withColumn("bin", F.explode(_near(c.rings))).join(sizes, ["cell", "bin"])
    meets = meets.select("cell", "bin", others("nh").alias("hb"), block("no").alias("ob"), F.lit(False).alias("asks"), "home", "vec_id", "embedding")

    def summed(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.cumsum(p * q, axis=1)[:, -1]  # from the left, as the sums of other engines

    def compare(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        own, other = (group.filter(pa.array(x)) for x in (asks, ~asks))
        ids, found = group.schema.field("vec_id").type, [[], [], [], []]
        if own.num_rows and other.num_rows:
            a, b = _matrix(own.column("embedding")), _matrix(other.column("embedding"))
            b_unit, homes = _unit(b), other.column("home").to_numpy()
            left, right = own.column("vec_id").combine_chunks(), other.column("vec_id").combine_chunks()
            for k in range(0, len(a), TILE):
                x = a[k : k + TILE]
                i, j = np.nonzero(_unit(x) @ b_unit.T >= least - SLACK)
                for cut in range(0, len(i), 100_000):
                    u, v = x[i[cut : cut + 100_000]], b[j[cut : cut + 100_000]]
                    s = summed(u, v) / (np.sqrt(summed(u, u)) * np.sqrt(summed(v, v)))
                    at = pa.array(j[cut : cut + 100_000])
                    for f, values in zip(found, (left.take(pa.array(k + i[cut : cut + 100_000])), right.take(at), pa.array(homes[j[cut : cut + 100_000]]), pa.array(s)), strict=True):
                        f.append(values)
        flat = [pa.concat_arrays([c for x in f for c in (x.chunks if isinstance(x, pa.ChunkedArray) else [x])]) if f else pa.array([], t) for f, t in zip(found, (ids, ids, pa.bool_(), pa.float64()), strict=True)]
        return pa.table(flat, ["x", "y", "home", "s"])

    kind = c.rows.schema["vec_id"].dataType.simpleString()
    met = asks.unionByName(meets).groupBy("cell", "bin", "hb", "ob").applyInArrow(compare, f"x {kind}, y {kind}, home boolean, s double")
    met = met.where(~F.col("home") | (F.col("x") < F.col("y")))  # two at home meet in both orders
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.round("s", 6).alias("similarity")).where(F.col("similarity") >= least)


def near_edges(vectors: DataFrame, least: float, pivots: int | None = None) -> DataFrame:
    """``a, b, similarity``: links that hold together all that ``near_pairs`` links; of copies only those to the one that stands for them."""
    reps = classes(vectors)
    pairs = rep_pairs(cells(reps, least, pivots), least)
    copies = members(vectors, reps).where("rep <> vec_id").select(F.col("rep").alias("a"), F.col("vec_id").alias("b"), F.lit(1.0).alias("similarity"))
    return pairs.unionByName(copies.where(F.lit(least) <= 1.0))


def near_pairs(vectors: DataFrame, least: float, pivots: int | None = None) -> DataFrame:
    """``a, b, similarity`` with ``a < b`` and cosine, to six places, at least ``least``; exact."""
    reps = classes(vectors)
    pairs = rep_pairs(cells(reps, least, pivots), least)
    if reps.where("n > 1").isEmpty():
        return pairs
    own = stored(members(vectors, reps), "vector-members")
    both = pairs.join(own.select(F.col("rep").alias("a"), F.col("vec_id").alias("m")), "a", "left").withColumn("a", F.coalesce("m", "a")).drop("m")
    both = both.join(own.select(F.col("rep").alias("b"), F.col("vec_id").alias("m")), "b", "left").withColumn("b", F.coalesce("m", "b")).drop("m")
    inner = own.select("rep", F.col("vec_id").alias("a")).join(own.select("rep", F.col("vec_id").alias("b")), "rep").where("a < b")
    inner = inner.select("a", "b", F.lit(1.0).alias("similarity")).where(F.lit(least) <= 1.0)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").unionByName(inner)
