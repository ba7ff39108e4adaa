"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of variable order with the counts of
the byte that follows. A byte seen in the deepest context is coded with its
share of c / (n + u), u being the number of distinct bytes seen there; otherwise
an escape of u / (n + u) leads to the next shorter context, from which the bytes
of the longer one are excluded, down to equal shares of 256. The statistics are
frozen, so the code length of each byte in each language is a table, and a
text's code length is a sum of look-ups. The language of the shortest code wins.

Trees share their contexts, those of the greatest sum of shares in the languages, so
that a language of few or short documents counts as much as any other. They are
learned from about ``MAX_TRAINING`` documents of each language at most.

Defined results: ``und`` with score 0 for null texts and texts without a letter,
and for all when nothing could be learned; ties go to the first language in
order of name; null languages are not learned from; rows are judged one by one.
The score is the softmax of the code lengths, in bits over the square root of
the length, so that it does not jump to 1 on long texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bytecontext import HELD, ContextTree, GramCounter, encoded, grams, pieces, tree
from lodestone.llm.text import crc_mod
from lodestone.llm.workspace import bound_batches, fresh, hash_sample, materialise, table

#: Documents of a language that its tree is learned from, about, at most.
MAX_TRAINING = 4000
#: Longest context, and nodes of all trees together (shared out if there are many languages).
DEPTH, NODES = 4, 32_768
UNKNOWN = "und"


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, GramCounter] = {}
    for b in batches:
        for lang, rows in b.groupby("lang"):
            own = held.setdefault(lang, GramCounter())
            for flat, at, _ in pieces([encoded(t) for t in rows["text"]], DEPTH):
                own.add(grams(flat, at, DEPTH))
        if sum(map(len, held.values())) > HELD:
            yield from (pd.DataFrame({"lang": k, "code": c.codes, "n": c.counts}) for k, c in held.items())
            held = {}
    yield from (pd.DataFrame({"lang": k, "code": c.codes, "n": c.counts}) for k, c in held.items())


class Languages:
    """Code lengths in bits by (node, byte) and language."""

    def __init__(self, names: list[str], contexts: ContextTree, counts: list[np.ndarray]):
        self.names, self.contexts = names, contexts
        self.bits = np.zeros((contexts.n * 256, len(names)), np.float32)
        for k, c in enumerate(counts):
            self.bits[:, k] = -np.log2(self._probabilities(contexts, c)).ravel()

    @staticmethod
    def _probabilities(contexts: ContextTree, c: np.ndarray) -> np.ndarray:
        p = np.empty((contexts.n, 256), np.float64)
        for d in range(contexts.most + 1):
            at = np.flatnonzero(contexts.depth == d)
            short = np.full((len(at), 256), 1 / 256) if d == 0 else p[contexts.parent[at]]
            own, seen = c[at].astype(np.float64), c[at] > 0
            n, u = own.sum(1, keepdims=True), seen.sum(1, keepdims=True)
            left = np.maximum(1 - (short * seen).sum(1, keepdims=True), 1e-12)
            escape = np.where(u < 256, u / np.maximum(n + u, 1), 0)
            hit = own / np.maximum(np.where(u < 256, n + u, n), 1)
            p[at] = np.where(n == 0, short, np.where(seen, hit, escape * short / left))
        return np.maximum(p, 1e-12)

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text in each language."""
        out = np.zeros((len(texts), len(self.names)))
        for flat, at, owner in pieces(texts, DEPTH):
            bits = self.bits[self.contexts.cells(flat, at)]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            np.add.at(out, owner[first], np.add.reduceat(bits, first, axis=0, dtype=np.float64))
        return out


def train(labelled: DataFrame) -> Languages | None:
    """Trees from rows of ``doc_id, lang, text``; None without any."""
    bound_batches(labelled.sparkSession)
    rows = hash_sample(labelled.where("lang is not null and text is not null"), "lang", MAX_TRAINING)
    counts = rows.select("lang", "text").mapInPandas(_gathered, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all")).collect()
    names = sorted(r["lang"] for r in totals)
    if not names:
        return None
    shares = counts.sparkSession.createDataFrame([(r["lang"], r["all"]) for r in totals], "of string, all long")
    counts = counts.join(F.broadcast(shares), F.col("lang") == F.col("of")).drop("of")  # a row a language
    chosen, seen = tree(counts, DEPTH, max(1024, NODES // len(names)), ["lang", "all"], "n / all")
    contexts = ContextTree(chosen)
    return Languages(names, contexts, [contexts.dense(seen[seen["lang"] == x]) for x in names])


def identify(docs: DataFrame, languages: Languages | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, which replace columns of those names."""
    bound_batches(docs.sparkSession)
    if languages is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(languages)  # 34 MB up to 32 languages, a megabyte for each one more

    @F.pandas_udf("lang string, score double")
    def identified(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        names = np.array([*own.names, UNKNOWN], object)
        for texts in batches:
            raw = [encoded(t) for t in texts]
            bits = own.lengths(raw)
            best = bits.argmin(1)
            scaled = (bits - bits.min(1, keepdims=True)) / np.sqrt(np.maximum([len(t) for t in raw], 1))[:, None]
            sure = 1 / np.exp2(-np.minimum(scaled, 1000)).sum(1)
            known = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
            yield pd.DataFrame({"lang": names[np.where(known, best, len(own.names))], "score": np.where(known, sure, 0.0)})

    told = fresh(docs, "told")
    out = docs.withColumn(told, identified("text"))
    return out.withColumns({"lang_pred": F.col(f"{told}.lang"), "score": F.col(f"{told}.score")}).drop(told)


def op9_language_id(spark, sf_dir):
    """The language of every document, learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 4) == 2
    languages = train(docs.where(~held).select("doc_id", "lang", "text"))
    return identify(docs.select("doc_id", "text"), languages).select("doc_id", held.alias("held_out"), "lang_pred", "score")
