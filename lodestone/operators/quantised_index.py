"""A vector index of product-quantised lists, with exact re-ranking.

Vectors are put into lists around centres, the square root of their number, and what is left
after the centre is cut into subspaces, each coded as one byte of a codebook. A search
takes the lists nearest to a query, sums distances to codes from a table for each
subspace (so a vector costs as many bytes as there are subspaces), and reads whole vectors
only of the best ``over`` times ``k``, whose exact scores rank the result.

Centres and codebooks are learnt from about ``SAMPLE`` vectors, chosen by a hash of the id;
every vector is coded. Lists are searched in blocks of ``LIST_BLOCK`` codes, several lists or a part of one, by as many
as ``QUERY_BLOCK`` queries, so no task holds a long list or all queries; a query is sent to a block once and gets
``over`` times ``k`` codes of it at most. Under ``LEAST`` vectors nothing is coded, and
a search is exact.

Metrics: "l2" scores 1 / (1 + distance), "cosine" the cosine, "dot" the product. Scores are rounded to
six places, equal ones ranked by id.

Defined results: vectors that are null, of another length than the first, or hold nulls or what is not
finite are left out, for "cosine" also zero ones; an empty table finds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.views import dot, sized, squared_distance, stored
from lodestone.operators.retrieval import top
from lodestone.operators.similarity import _matrix

SAMPLE, LEAST, CODES = 65_536, 256, 256
#: Lists at most, and bytes of their centres at most.
LISTS, CENTRE_BYTES = 16_384, 32 << 20
LIST_BLOCK, QUERY_BLOCK = 50_000, 2_000
#: Vectors compared with all centres, or with all codes of a book, at a time.
ROWS = 1_024


@dataclass
class QuantisedIndex:
    """vectors: ``vec_id, embedding, code, list`` by list; sizes: ``list, n``; centres and books are None where nothing is coded."""

    vectors: DataFrame
    sizes: DataFrame
    metric: str
    centres: np.ndarray | None
    books: np.ndarray | None


def score(metric: str, a: Column, b: Column) -> Column:
    if metric == "l2":
        return F.round(1 / (1 + squared_distance(a, b)), 6)
    return F.round(dot(a, b) if metric == "dot" else dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)), 6)


def _usable(vectors: DataFrame, metric: str, dims: int | None = None) -> tuple[DataFrame, int]:
    square = dot(F.col("embedding"), F.col("embedding"))
    v = vectors.select("vec_id", "embedding").where(square.isNotNull() & (square < float("inf")) & (square > 0 if metric == "cosine" else F.lit(True)))
    if dims is None:
        first = v.select(F.size("embedding")).first()
        dims = first[0] if first else 0
    return v.where(F.size("embedding") == dims), dims


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest of ``centres`` to each row of ``x``."""
    size = (centres * centres).sum(1)
    return np.concatenate([np.zeros(0, np.int64), *((size - 2 * x[a : a + ROWS] @ centres.T).argmin(1) for a in range(0, len(x), ROWS))])


def _lloyd(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centres of k-means over the rows of ``x``; rows of ``x`` if there are no more than k."""
    rnd = np.random.default_rng(seed)
    c = x[rnd.permutation(len(x))[:k]].copy()
    for _ in range(rounds if len(x) > k else 0):
        own = _closest(x, c)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rnd.integers(0, len(x), k)])
    return c


def _prepared(x: np.ndarray, metric: str) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True)) if metric == "cosine" else x


def _codebooks(some: DataFrame, centres: np.ndarray, subspaces: int, metric: str, seed: int) -> np.ndarray:
    """``subspaces`` books of ``CODES`` codes; each is learnt in a task of its own, from the sample."""
    width = centres.shape[1] // subspaces

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _prepared(_matrix(b.column("embedding")), metric)
            rest = x - centres[_closest(x, centres)]
            for s in range(subspaces):
                part = rest[:, s * width : (s + 1) * width]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), s), pa.int32()), b.column("vec_id").cast(pa.string()), lists], ["s", "id", "x"])

    def learn(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group.sort_values("id")["x"].to_numpy())  # the same for any order of arrival
        return pd.DataFrame({"s": [key[0]], "book": [_lloyd(x, CODES, seed).ravel().tolist()]})

    rows = some.select("vec_id", "embedding").mapInArrow(cut, "s int, id string, x array<double>").groupBy("s").applyInPandas(learn, "s int, book array<double>").collect()
    return np.stack([np.array(r["book"]).reshape(-1, width) for r in sorted(rows, key=lambda r: r["s"])])


def build(vectors: DataFrame, path: str, metric: str = "l2", subspaces: int | None = None, lists: int | None = None, seed: int = 7) -> QuantisedIndex:
    """Code ``vec_id, embedding`` below ``path``. subspaces: bytes a vector, a divisor of its length; by default a byte for four numbers, or for as few as divide it."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if metric not in ("l2", "cosine", "dot"):
        raise ValueError("metric must be l2, cosine or dot")
    spark = vectors.sparkSession
    v, dims = _usable(vectors, metric)
    n = v.count()
    if n < LEAST:
        v = stored(v.select("vec_id", "embedding", F.lit(None).cast("binary").alias("code"), F.lit(0).alias("list")), "few-vectors")
        return QuantisedIndex(v, v.groupBy("list").agg(F.count("*").alias("n")), metric, None, None)
    subspaces = subspaces or dims // next(w for w in (4, 2, 3, 1) if dims % w == 0)
    if dims % subspaces:
        raise ValueError(f"{subspaces} subspaces don't divide {dims} dimensions")
    share = min(1.0, SAMPLE / n)
    some = stored(v if share == 1.0 else v.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20))), "vector-sample")
    most = max(1, min(lists or math.isqrt(n), LISTS, CENTRE_BYTES // (8 * dims), some.count()))
    length = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    features = F.transform("embedding", lambda x: x.cast("double") / length) if metric == "cosine" else F.col("embedding").cast("array<double>")
    model = KMeans(k=most, seed=seed, maxIter=8, initMode="random").fit(some.select(array_to_vector(features).alias("features")))
    centres = np.array(model.clusterCenters())
    books = _codebooks(some, centres, subspaces, metric, seed)
    width = dims // subspaces

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _prepared(_matrix(b.column("embedding")), metric)
            own = _closest(x, centres)
            rest = x - centres[own]
            codes = np.stack([_closest(rest[:, s * width : (s + 1) * width], books[s]) for s in range(subspaces)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(own, pa.int32())], ["vec_id", "embedding", "code", "list"])

    kinds = {f.name: f.dataType.simpleString() for f in v.schema}
    coded = v.mapInArrow(code, f"vec_id {kinds['vec_id']}, embedding {kinds['embedding']}, code binary, list int")
    coded.write.partitionBy("list").parquet(f"{path}/vectors")
    put = spark.read.schema(coded.schema).parquet(f"{path}/vectors")
    put.groupBy("list").agg(F.count("*").alias("n")).write.parquet(f"{path}/sizes")
    return QuantisedIndex(put, spark.read.parquet(f"{path}/sizes"), metric, centres, books)


def _nearest_lists(index: QuantisedIndex, queries: DataFrame, probes: int, block_of: np.ndarray) -> DataFrame:
    """``query_id, q, block, lists``: the ``probes`` lists nearest to each query, a row for each block that has some."""
    centres, metric = index.centres, index.metric
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                b = batch.slice(a, ROWS)
                x = _prepared(_matrix(b.column("embedding")), metric)
                far = -x @ centres.T if metric == "dot" else (centres * centres).sum(1) - 2 * x @ centres.T
                lists = np.argsort(far, axis=1, kind="stable")[:, :probes].astype(np.int32)
                lists = np.take_along_axis(lists, np.argsort(block_of[lists], axis=1, kind="stable"), 1)
                block = block_of[lists]
                first = np.ones(block.shape, bool)
                first[:, 1:] = block[:, 1:] != block[:, :-1]
                begin = np.flatnonzero(first)
                out = b.take(pa.array(begin // lists.shape[1]))
                told = pa.ListArray.from_arrays(pa.array(np.append(begin, lists.size), pa.int32()), pa.array(lists.ravel()))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(block.ravel()[begin], pa.int32()), told], ["query_id", "q", "block", "lists"])

    return queries.select("vec_id", "embedding").mapInArrow(near, f"query_id {kinds['vec_id']}, q {kinds['embedding']}, block int, lists array<int>")


def _blocks(index: QuantisedIndex) -> tuple[np.ndarray, DataFrame]:
    """The block of each list, and ``list, block, parts`` of the lists with vectors: short lists share a block, a long one is cut."""
    size = np.zeros(len(index.centres), np.int64)
    for r in index.sizes.collect():  # LISTS rows at most
        size[r["list"]] = r["n"]
    block, at, room = np.zeros(len(size), np.int64), -1, 0
    for i, n in enumerate(size.tolist()):
        if at < 0 or n > room:
            at, room = at + 1, LIST_BLOCK
        block[i], room = at, room - n
    rows = pa.table({"list": np.arange(len(size), dtype=np.int32), "block": block.astype(np.int32), "parts": np.maximum(1, -(-size // LIST_BLOCK)).astype(np.int32)})
    return block, F.broadcast(index.vectors.sparkSession.createDataFrame(rows))


def search(index: QuantisedIndex, queries: DataFrame, k: int, probes: int | None = None, over: int = 10) -> DataFrame:
    """``query_id, vec_id, score, rank`` of about the ``k`` nearest; ``probes``: lists a query reads, a quarter by default."""
    order = [F.desc("score"), "vec_id"]
    dims = None if index.centres is None else index.centres.shape[1]
    asked = _usable(queries, index.metric, dims)[0]
    if index.centres is None:  # fewer than LEAST vectors
        q = sized(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.lit(0).alias("list")))
        return top(index.vectors.join(q, "list").select("query_id", "vec_id", score(index.metric, F.col("embedding"), F.col("q")).alias("score")), ["query_id"], order, k)
    probes = min(probes or -(-len(index.centres) // 4), len(index.centres))
    block_of, lists = _blocks(index)
    groups = max(1, -(-asked.count() // QUERY_BLOCK))
    pairs = stored(_nearest_lists(index, asked, probes, block_of), "query-lists")
    parts = F.broadcast(lists.groupBy("block").agg(F.max("parts").alias("parts")))
    asks = pairs.join(parts, "block").select("query_id", "q", "block", "lists", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("g"))
    codes = index.vectors.select("vec_id", "code", "list").join(lists, "list").select("vec_id", "code", "list", "block", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    centres, books, metric, most = index.centres, index.books, index.metric, over * k
    subspaces, _, width = books.shape

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, vecs, far = [left.column("query_id").type, right.column("vec_id").type], [], []
        picked = []
        if left.num_rows and right.num_rows:
            rank = np.empty(right.num_rows, np.int64)
            rank[pc.array_sort_indices(right.column("vec_id").combine_chunks()).to_numpy()] = np.arange(right.num_rows)
            own = right.column("list").to_numpy()
            order = np.argsort(own, kind="stable")
            known, start = np.unique(own[order], return_index=True)
            spans = dict(zip(known.tolist(), np.split(order, start[1:]), strict=True))
            flat, at = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(-1, subspaces), np.arange(subspaces)
            for row, (q, asked_of) in enumerate(zip(_prepared(_matrix(left.column("q")), metric), left.column("lists").to_pylist(), strict=True)):
                some, d = [], []
                for i in asked_of:
                    if i not in spans:
                        continue
                    rest = (q if metric == "dot" else q - centres[i]).reshape(subspaces, 1, width)
                    table = -(rest * books).sum(2) if metric == "dot" else ((rest - books) ** 2).sum(2)
                    some.append(spans[i])
                    d.append(table[at, flat[spans[i]]].sum(1) - (q @ centres[i] if metric == "dot" else 0))
                if not some:
                    continue
                some, d = np.concatenate(some), np.concatenate(d)
                best = np.flatnonzero(d <= np.partition(d, most - 1)[most - 1]) if len(d) > most else np.arange(len(d))
                best = best[np.lexsort((rank[some[best]], d[best]))[:most]]
                picked.append(np.full(len(best), row))
                vecs.append(some[best])
                far.append(d[best])
        take = lambda column, at: column.combine_chunks().take(pa.array(np.concatenate(at))) if at else None
        none = [pa.array([], t) for t in (*ids, pa.float64())]
        if not picked:
            return pa.table(none, ["query_id", "vec_id", "d"])
        return pa.table([take(left.column("query_id"), picked), take(right.column("vec_id"), vecs), pa.array(np.concatenate(far))], ["query_id", "vec_id", "d"])

    kinds = {"q": pairs.schema["query_id"].dataType.simpleString(), "v": index.vectors.schema["vec_id"].dataType.simpleString()}
    met = asks.groupBy("block", "part", "g").cogroup(codes.groupBy("block", "part", "g")).applyInArrow(scan, f"query_id {kinds['q']}, vec_id {kinds['v']}, d double")
    best = top(met, ["query_id"], ["d", "vec_id"], most).select("query_id", "vec_id")
    whole = index.vectors.select("vec_id", "embedding").join(sized(stored(best.join(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id"), "query-best")), "vec_id")
    return top(whole.select("query_id", "vec_id", score(metric, F.col("embedding"), F.col("q")).alias("score")), ["query_id"], order, k)


def bytes_read(index: QuantisedIndex, queries: DataFrame, k: int, probes: int | None = None, over: int = 10) -> dict:
    """Bytes of codes and of whole vectors that a search looks at, and those of an exact one."""
    asked = _usable(queries, index.metric, None if index.centres is None else index.centres.shape[1])[0]
    n, q = index.sizes.agg(F.sum("n")).first()[0] or 0, asked.count()
    dims = 0 if index.centres is None else index.centres.shape[1]
    if index.centres is None:
        return {"codes": 0, "vectors": n * q, "exact": n * q}
    probes = min(probes or -(-len(index.centres) // 4), len(index.centres))
    codes = _nearest_lists(index, asked, probes, np.zeros(len(index.centres), np.int64)).select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias("c")).join(index.sizes, "list").agg(F.sum(F.col("c") * F.col("n"))).first()[0]
    return {"codes": codes * index.books.shape[0], "vectors": min(n, over * k) * q * 4 * dims, "exact": n * q * 4 * dims}
