"""Seams for code of the user: rerankers, converters of texts and providers of metadata."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.retrieval import top

#: Keys of a document's metadata that a provider must not set.
RESERVED = ("content_type", "md5", "source_revision")


def rerank_by(candidates: DataFrame, docs: DataFrame, queries: DataFrame, k: int, model: Callable[[list[str], list[str]], list[float]], squash: bool = False) -> DataFrame:
    """``query_id, doc_id, score, rank``: the ``k`` best candidates by a model that scores pairs of query and text.

    Pairs reach the model in Arrow batches on the executors. ``squash`` maps logits to 0 to 1. No candidates, no rows.
    """

    @F.pandas_udf("double")
    def scored(query: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series(model(query.fillna("").tolist(), text.fillna("").tolist()), dtype="float64")

    both = candidates.select("query_id", "doc_id").distinct().join(queries.select("query_id", "query"), "query_id").join(docs.select("doc_id", "text"), "doc_id")
    value = both.select("query_id", "doc_id", scored("query", "text").alias("score"))
    if squash:
        value = value.withColumn("score", 1 / (1 + F.exp(-F.col("score"))))
    return top(value, ["query_id"], [F.desc("score"), "doc_id"], k)


def overfetch(k: int, reranked: bool) -> int:
    """Candidates to fetch for ``k`` results: ten times as many when they are reranked."""
    return 10 * k if reranked else k


class Converters:
    """Functions from documents to items, by suffix; another suffix is an error, not a guess."""

    def __init__(self) -> None:
        self.known: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, suffix: str, convert: Callable[[DataFrame], DataFrame]) -> None:
        self.known[suffix.lower()] = convert

    def convert(self, docs: DataFrame, suffix: str) -> DataFrame:
        if suffix.lower() not in self.known:
            raise LookupError(f"no converter for {suffix}")
        return self.known[suffix.lower()](docs)


class Providers:
    """Expressions that give a map of metadata for a document, by name, and the name that each source is set to use."""

    def __init__(self, known: dict[str, Callable[[DataFrame], Column]], sources: dict[str, str | None]):
        unknown = sorted(n for n in sources.values() if n is not None and n not in known)
        if unknown:
            raise LookupError(f"unknown metadata provider {unknown[0]}")
        self.by_source = {s: known[n] for s, n in sources.items() if n is not None}

    def metadata(self, docs: DataFrame, source_col: str = "source") -> Column:
        """The map of each row's source without reserved keys; an empty map where the source has none."""
        empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        out = F.when(F.lit(False), empty)
        for source, provide in self.by_source.items():
            out = out.when(F.col(source_col) == source, provide(docs))
        return F.map_filter(F.coalesce(out, empty), lambda key, _: ~key.isin(*RESERVED))
