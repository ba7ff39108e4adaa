"""The best rows of each query, by blocks of rows that meet blocks of queries.

Rows and queries are dealt to blocks by hashes of their ids, and each pair of blocks is one group of bounded size. A group
gives ``k`` rows a query at most, so what is shuffled after it grows with the blocks and not with the pairs. Products of
matrices and sums over postings choose candidates; what is returned is computed as other engines do, and ties of rounded
scores go to the smaller id before a block is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors and documents of a block at most, about; small tables are cut finer, into ``SPREAD`` blocks of ``LEAST`` rows or more.
VECTORS, DOCUMENTS, SPREAD, LEAST = 32_768, 16_384, 32, 1_024
#: Queries of a block, about; those compared at a time; pairs whose scores are computed at a time.
QUERIES, TILE, PAIRS = 8_192, 128, 50_000


def blocks(n: int, most: int) -> int:
    return max(1, -(-n // most), min(SPREAD, -(-n // LEAST)))


def _met(rows: DataFrame, row_id: str, nr: int, queries: DataFrame, nq: int, by: list[str]):
    """Both sides dealt to pairs of blocks, grouped by them; there are as many partitions as pairs, so none holds more as the tables grow."""
    at = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("_rb", at(row_id, nr)).withColumn("_qb", every(nq))
    right = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # new columns, as both sides may come from one table
    right = right.withColumn("_qb", at("query_id", nq)).withColumn("_rb", every(nr))
    if not by and nr * nq > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        left, right = (x.repartition(nr * nq, "_rb", "_qb") for x in (left, right))
    return left.groupBy(*by, "_rb", "_qb").cogroup(right.groupBy(*by, "_rb", "_qb"))


def _whole(column) -> pa.Array:
    return column.combine_chunks() if not isinstance(column, pa.ChunkedArray) else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def rounded(s: np.ndarray, places: int) -> np.ndarray:
    """``s`` in units of the last place, halves up by the decimal digits of the double."""
    y = s * 10.0**places + 0.5
    out = np.floor(y)
    for i in np.flatnonzero(np.abs(y - np.rint(y)) < 1e-6 * np.maximum(1.0, np.abs(y) * 1e-6)):
        out[i] = float(Decimal(repr(float(s[i]))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP).scaleb(places))
    return out


def _first(i: np.ndarray, j: np.ndarray, s: np.ndarray, places: int, k: int) -> np.ndarray:
    """Places of the ``k`` best of each ``i`` by rounded score, then by ``j``; no number comes first, as it is the greatest."""
    key = -rounded(s, places)
    order = np.lexsort((j, np.where(np.isnan(key), -np.inf, key), i))
    own = i[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


def _by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and numbers of the arrays of each length, without those that are null or hold nulls."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).copy()
    flat = pc.list_flatten(column)
    if flat.null_count:
        lengths[pc.list_parent_indices(column).filter(flat.is_null()).to_numpy()] = -1
    out = {}
    for n in np.unique(lengths[lengths >= 0]).tolist():
        at = np.flatnonzero(lengths == n)
        out[n] = at, pc.list_flatten(column.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n)
    return out


def _close(x: np.ndarray, v: np.ndarray, vv: np.ndarray, k: int, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``x`` and ``v`` that may be among the ``k`` of the best rounded score."""
    xx = (x * x).sum(1)
    d2 = x @ v.T
    d2 *= -2
    d2 += xx[:, None]
    d2 += vv
    if len(v) <= k:
        return np.nonzero(np.ones(d2.shape, bool))
    error = 1e-15 * (x.shape[1] + 8) * (xx + vv.max())
    least = 1 / (1 + np.maximum(np.partition(d2, k - 1, axis=1)[:, k - 1], 0) + error) - 1.000001 * 10.0**-places
    far = np.where(least > 0, 1 / np.where(least > 0, least, 1.0) - 1 + error, np.inf)
    return np.nonzero((d2 <= far[:, None]) | ~np.isfinite(d2))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, n: int, asked: int, by: tuple[str, ...] = (), places: int = 6) -> DataFrame:
    """``query_id, vec_id, s``: of each pair of blocks the ``k`` vectors of the best 1 / (1 + squared distance), to ``places``, of each query.

    ``vectors`` has ``vec_id, embedding``, ``queries`` has ``query_id, q``, and both have the columns ``by``, which must agree. ``n``
    and ``asked`` are how many rows of each have one value of these, at most. Pairs without a distance have a null score and come last.
    """
    types = {f.name: f.dataType.simpleString() for f in vectors.schema} | {"query_id": queries.schema["query_id"].dataType.simpleString()}

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, asks, found = _whole(left.column("vec_id")), _whole(right.column("query_id")), ([], [], [])
        order = pc.array_sort_indices(ids, null_placement="at_start")
        ids = ids.take(order)
        held = _by_length(_whole(left.column("embedding")).take(order))
        wanted = _by_length(_whole(right.column("q")))

        def put(i, j, s):
            for f, x in zip(found, (i, j, s), strict=True):
                f.append(x)

        known = np.concatenate([np.zeros(0, np.int64), *(at for at, _ in wanted.values())])
        for at, size in [(np.setdiff1d(np.arange(len(asks)), known), -1), *((at, size) for size, (at, _) in wanted.items())]:
            here = held[size][0] if size in held else np.zeros(0, np.int64)
            other = np.setdiff1d(np.arange(len(ids)), here)[: max(0, k - len(here))]  # no distance, so last
            put(np.repeat(at, len(other)), np.tile(other, len(at)), np.full(len(at) * len(other), np.nan))
        lacking = sum(len(x) for x in found[0])
        with np.errstate(all="ignore"):
            for size, (at, q) in wanted.items():
                if size not in held:
                    continue
                here, v = held[size]
                vv = (v * v).sum(1)
                for a in range(0, len(q), TILE):
                    x = q[a : a + TILE]
                    i, j = _close(x, v, vv, k, places)
                    s = np.empty(len(i))
                    for c in range(0, len(i), PAIRS):
                        d = x[i[c : c + PAIRS]] - v[j[c : c + PAIRS]]
                        d *= d
                        s[c : c + PAIRS] = 1 / (1 + (np.cumsum(d, axis=1)[:, -1] if size else 0.0))  # from the left, as the sums of other engines
                    best = _first(i, j, s, places, k)
                    put(at[a + i[best]], here[j[best]], s[best])
        i, j, s = (np.concatenate([np.zeros(0, t), *f]) for f, t in zip(found, (np.int64, np.int64, np.float64), strict=True))
        return pa.table([asks.take(pa.array(i)), ids.take(pa.array(j)), pa.array(s, mask=np.arange(len(s)) < lacking)], ["query_id", "vec_id", "s"])

    met = _met(vectors.select(*by, "vec_id", "embedding"), "vec_id", blocks(n, VECTORS), queries.select(*by, "query_id", "q"), -(-max(1, asked) // QUERIES), list(by))
    return met.applyInArrow(compare, f"query_id {types['query_id']}, vec_id {types['vec_id']}, s double")


def summed(postings: DataFrame, terms: DataFrame, k: int, n: int, asked: int, places: int = 5) -> DataFrame:
    """``query_id, doc_id, s``: of each pair of blocks the ``k`` documents of the greatest sum, to ``places``, of each query.

    ``postings`` has ``doc_id, t, part`` with positive parts, ``terms`` has ``query_id, t``; ``t`` is a whole number. A document's sum is
    that of its parts of the query's terms; one without any is no result. ``n`` documents and ``asked`` queries there are, about.
    """
    doc_type, query_type = postings.schema["doc_id"].dataType.simpleString(), terms.schema["query_id"].dataType.simpleString()

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        docs, asks = (pc.dictionary_encode(_whole(x), null_encoding="encode") for x in (left.column("doc_id"), right.column("query_id")))
        order = pc.array_sort_indices(docs.dictionary, null_placement="at_start").to_numpy()
        ids, place = docs.dictionary.take(pa.array(order)), np.argsort(order)
        doc, part, t = place[docs.indices.to_numpy()], left.column("part").to_numpy(), left.column("t").to_numpy()
        by_term = np.argsort(t, kind="stable")
        doc, part = doc[by_term], part[by_term]
        known, start = np.unique(t[by_term], return_index=True)
        end = np.append(start[1:], len(t))
        query, term = asks.indices.to_numpy(), right.column("t").to_numpy()
        at = np.searchsorted(known, term)
        has = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == term) if len(known) else np.zeros(len(term), bool)
        query, at = query[has], at[has]
        by_query = np.lexsort((at, query))
        query, at = query[by_query], at[by_query]
        found = ([], [], [])
        for one, lists in _runs(query, at):
            spans = [slice(start[x], end[x]) for x in lists]
            s = np.bincount(np.concatenate([doc[x] for x in spans]), np.concatenate([part[x] for x in spans]), len(ids))
            j = np.flatnonzero(s)
            if len(j) > k:
                j = np.flatnonzero(s > max(0.0, np.partition(s, len(s) - k)[len(s) - k] - 1.000001 * 10.0**-places))
            best = _first(np.zeros(len(j), np.int64), j, s[j], places, k)
            for f, x in zip(found, (np.full(len(best), one), j[best], s[j[best]]), strict=True):
                f.append(x)
        i, j, s = (np.concatenate([np.zeros(0, kind), *f]) for f, kind in zip(found, (np.int64, np.int64, np.float64), strict=True))
        return pa.table([asks.dictionary.take(pa.array(i)), ids.take(pa.array(j)), pa.array(s)], ["query_id", "doc_id", "s"])

    met = _met(postings.select("doc_id", "t", "part"), "doc_id", blocks(n, DOCUMENTS), terms.select("query_id", "t"), -(-max(1, asked) // QUERIES), [])
    return met.applyInArrow(compare, f"query_id {query_type}, doc_id {doc_type}, s double")


def _runs(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The values of each key; ``keys`` are sorted."""
    known, start = np.unique(keys, return_index=True)
    yield from zip(known.tolist(), np.split(values, start[1:]) if len(known) else [], strict=True)
