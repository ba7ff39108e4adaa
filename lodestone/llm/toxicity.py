"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: letters that look like Latin ones become those, digits
and signs that stand for a letter inside a word become that letter, case goes.
Words are joined by single spaces, so an entry is a whole word (`` idiot ``) or
the beginning of words (`` loweis``). Each match has a weight, the log ratio of the
entry's frequency in toxic and in clean words; of the entries that match one
word the heaviest counts. Matches inside an exception phrase do not count. A
document's features are the sum of its weights, that sum over its length, and
its heaviest match; a logistic curve over these gives the score.

Entries, exceptions and the curve are learned from labelled documents, about
``MAX_TRAINING`` of each label at most, taken by a hash of the id. Entries
come from two thirds of them, the curve from the rest, so that an entry that
separates the learning documents by chance does not look certain. Word counts
are pre-aggregated in each task.

Defined results: a null or empty text has no match and gets the score of such
texts; without labels of both kinds the lexicon is empty and every score is 0;
null labels are left out; rows that repeat an id are scored by themselves.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.text import crc_mod
from lodestone.llm.workspace import bound_batches, fresh, hash_sample, hinted, materialise, table

#: Labelled documents of each label that the lexicon and the curve are fitted on, about, at most.
MAX_TRAINING = 20_000
#: Shortest and longest beginning of words that may be an entry.
SHORTEST, LONGEST = 4, 10
#: Least weight, least number of toxic documents' words and least likelihood ratio statistic of an entry.
LEAST_WEIGHT, LEAST_COUNT, LEAST_G2 = 2.0, 3, 15.0

#: Characters that look like a Latin letter.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ο": "o", "ι": "i", "ν": "v", "ρ": "p", "τ": "t", "κ": "k", "ε": "e", "υ": "u", "ⅼ": "l", "ı": "i", "ɡ": "g", "ᴏ": "o",
}
#: Characters written for a letter inside a word.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_GLYPHS = str.maketrans(HOMOGLYPHS | {chr(0xFF21 + i): chr(97 + i) for i in range(26)} | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})
_SIGN = re.compile(r"(?<=[^\W\d_])[0134578@$!]+(?=[^\W\d_])|(?<![^\W_])[0134578@$]+(?=[^\W\d_]{2})")
_STAND = str.maketrans(DIGITS)
_BREAK = re.compile(r"[\W_]+")
_HAS_SIGN = re.compile(r"[0134578@$!]")


def fold(text: str | None) -> str:
    """Words of a text, folded, with one space around each."""
    t = (text or "").lower()
    if not t.isascii():
        t = t.translate(_GLYPHS)
    if _HAS_SIGN.search(t):
        t = _SIGN.sub(lambda m: m[0].translate(_STAND), t)
    return f" {_BREAK.sub(' ', t).strip()} "


class Lexicon:
    """Weighted entries, exception phrases and the curve; small, sent to the workers."""

    def __init__(self, entries: dict[str, float], exceptions: list[str] = (), curve: tuple[float, ...] = (-8.0, 1.0, 0.0, 0.0)):
        self.entries, self.exceptions, self.curve = dict(entries), list(exceptions), tuple(curve)
        self._automaton = None

    def __getstate__(self):
        return {"entries": self.entries, "exceptions": self.exceptions, "curve": self.curve, "_automaton": None}

    def _built(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for e, w in self.entries.items():
                a.add_word(e, (len(e), w))
            for e in self.exceptions:
                a.add_word(e, (len(e), None))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def matches(self, folded: str) -> dict[int, float]:
        """Weight of the heaviest entry at each matched word, by the place of the word."""
        a = self._built()
        if not len(a):
            return {}
        at: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in a.iter(folded):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            elif weight > at.get(start, 0.0):
                at[start] = weight
        if not spared:
            return at
        places, reach, gone = sorted(at), 0, set()
        for start, end in sorted(spared):  # each place is passed once, however many exceptions cover it
            first = bisect_left(places, start)
            last = bisect_left(places, end)
            gone.update(places[max(first, reach) : last])
            reach = max(reach, last)
        return {k: w for k, w in at.items() if k not in gone}

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Sum of weights (as a logarithm), sum for a hundred words, heaviest weight."""
        folded = fold(text)
        at = self.matches(folded)
        total = sum(at.values())
        return math.log1p(total), math.log1p(100 * total / max(1, folded.count(" ") - 1)), max(at.values(), default=0.0)

    def score(self, text: str | None) -> float:
        b, *w = self.curve
        z = b + sum(x * y for x, y in zip(w, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    toxic, clean = Counter(), Counter()
    for b in batches:
        for text, label in zip(b["text"], b["label"], strict=True):
            (toxic if label else clean).update(set(fold(text).split()))
        if len(toxic) + len(clean) > 500_000:  # hand over what is gathered; sums are made after the shuffle
            yield _frame(toxic, clean)
            toxic, clean = Counter(), Counter()
    if toxic or clean:
        yield _frame(toxic, clean)


def _frame(toxic: Counter, clean: Counter) -> pd.DataFrame:
    words = list(toxic.keys() | clean.keys())
    return pd.DataFrame({"word": words, "toxic": np.array([toxic[w] for w in words], np.int64), "clean": np.array([clean[w] for w in words], np.int64)})


def _context(lexicon):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            toxic, clean = Counter(), Counter()
            for text, label in zip(b["text"], b["label"], strict=True):
                folded = fold(text)
                found = set()
                for k in lexicon.matches(folded):
                    end = folded.index(" ", k + 1)
                    after, before = folded.find(" ", end + 1), folded.rfind(" ", 0, k) if k else -1
                    found |= {folded[k : after + 1]} if after > 0 else set()
                    found |= {folded[before : end + 1]} if before >= 0 else set()
                (toxic if label else clean).update(found)
            if toxic or clean:
                yield _frame(toxic, clean)

    return run


def _featured(lexicon):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array([lexicon.features(t) for t in b["text"]]).reshape(-1, 3)
            yield pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "label": b["label"].astype("int32")})

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; the intercept comes first."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * np.r_[0, w[1:]]
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)) + 1e-9
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return tuple(float(v) for v in w)


def _entries(counts: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Entries from ``word, toxic, clean``: words and beginnings that separate the labels best."""
    upto = F.least(F.lit(LONGEST), F.char_length("word") - 1)
    starts = F.when(upto >= SHORTEST, F.transform(F.sequence(F.lit(SHORTEST), F.greatest(F.lit(SHORTEST), upto)), lambda k: F.concat(F.lit(" "), F.substring(F.col("word"), F.lit(1), k))))
    whole = F.array(F.concat(F.lit(" "), F.col("word"), F.lit(" ")))
    e = counts.select(F.explode(F.concat(whole, F.coalesce(starts, F.array().cast("array<string>")))).alias("entry"), "toxic", "clean")
    e = e.groupBy("entry").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where(F.col("t") >= LEAST_COUNT)
    share = n_toxic / (n_toxic + n_clean)
    expected = (F.col("t") + F.col("c")) * share
    g2 = 2 * (F.col("t") * F.log(F.col("t") / expected) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / ((F.col("t") + F.col("c")) * (1 - share)))).otherwise(0.0))
    weight = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    best = e.withColumns({"g2": g2, "weight": weight}).where((F.col("g2") >= LEAST_G2) & (F.col("weight") >= LEAST_WEIGHT))
    return {r["entry"]: r["weight"] for r in best.collect()}  # words of a sample that MAX_TRAINING bounds


def train(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """A lexicon from the texts of ``docs`` and rows of ``doc_id, label`` (0 or 1).

    Labels are matched and sampled by id alone; only the texts of the sample move.
    """
    bound_batches(docs.sparkSession)
    marks = labels.where("label is not null").select(F.col("doc_id").alias("_label_id"), F.when(F.col("label") > 0, 1).otherwise(0).alias("label"))
    known = docs.select("doc_id").join(marks, F.col("doc_id") == F.col("_label_id")).select("doc_id", "label").distinct()
    chosen = materialise(hash_sample(known, "label", MAX_TRAINING).withColumnRenamed("doc_id", "_chosen"), "chosen")
    key = F.xxhash64(F.col("doc_id").cast("string"), F.lit("fold"))
    texts = docs.select("doc_id", "text").join(hinted(chosen, 32), F.col("doc_id") == F.col("_chosen"))
    sample = materialise(texts.select("text", "label", F.pmod(key, F.lit(3)).alias("fold")).repartition(24, key), "labelled")
    fit, tune = sample.where("fold < 2"), sample.where("fold = 2")
    n = defaultdict(int, {r["label"]: r["count"] for r in fit.groupBy("label").count().collect()})
    if not n[0] or not n[1]:
        return Lexicon({}, (), (-50.0, 0.0, 0.0, 0.0))
    schema = "word string, toxic long, clean long"
    counts = fit.select("text", "label").mapInPandas(_counted, schema).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    draft = Lexicon(_entries(counts, n[1], n[0]))
    phrases = fit.select("text", "label").mapInPandas(_context(draft), schema).groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    spared = phrases.where("t = 0 and c >= 3").collect()  # of the same sample
    draft = Lexicon(draft.entries, sorted(r["word"] for r in spared))
    basis = tune if tune.where("label = 1").limit(1).count() else fit
    points = basis.select("text", "label").mapInPandas(_featured(draft), "a double, b double, c double, label int").toArrow().to_pandas()  # MAX_TRAINING bounds these rows
    points = points.sort_values(["a", "b", "c", "label"])
    return Lexicon(draft.entries, draft.exceptions, logistic(points[["a", "b", "c"]].to_numpy(), points["label"].to_numpy(float)))


def score(docs: DataFrame, lexicon: Lexicon, column: str = "score") -> DataFrame:
    """``docs`` with the score in ``column``, which replaces one of that name."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # as large as the lexicon of a bounded sample

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in batches:
            yield pd.Series([own.score(t) for t in texts], dtype="float64")

    return docs.withColumn(column, scored("text"))


def learned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Lexicon:
    """A lexicon from the labels of those ``docs`` that are not held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return train(docs.where(crc_mod(F.col("doc_id"), 4) != 2), labels)


#: Score from which a document counts as toxic.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` whose score stays under the limit."""
    column = fresh(docs, "toxicity")
    return score(docs, learned(spark, docs, sf_dir), column).where(F.col(column) < TOXIC).drop(column)


def op1_toxicity(spark, sf_dir):
    """Score of every document, held-out or not."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, learned(spark, docs, sf_dir))
    held = crc_mod(F.col("doc_id"), 4) == 2
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
