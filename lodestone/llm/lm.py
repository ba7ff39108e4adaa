"""Language-model scores by context-tree weighting over bytes.

A byte is decided bit by bit. At each node of a tree of byte contexts, each of
the 255 binary decisions has a Krichevsky-Trofimov estimate from the zeros and
ones that followed this context in training. The block probabilities of the
estimates, weighted half against the product of the probabilities of the longer
contexts, give every node its weight against its continuations, so a prediction
mixes the estimates of all depths along the context. With the statistics frozen
after training, the mixture of each (deepest node, byte) is a table, and a text's
log probability is a sum of look-ups.

Every context of the training texts up to ``DEPTH`` bytes is a node. Weights and
mixtures of all nodes are tables of Spark, made level by level. The most frequent
contexts, ``NODES`` at most, are sent to the workers with their mixtures, and of
the grams (a byte and its context) after other contexts the most frequent,
``GRAMS`` at most, with their bits. The remaining bytes are counted by document
and joined with the mixtures after a shuffle, as rare words are, so ``NODES`` and
``GRAMS`` change the cost and not the score.

The base score is a smoothed unigram of words over exact counts of all training
tokens. Words are counted in each task, then by a 64-bit hash of the word. The
most frequent words, ``HEAD`` at most, are sent to the workers; the others are
joined with the counts after a shuffle, pre-aggregated by document. A document is
identified there by a hash of id and text; equal rows share their sums evenly.

Defined results: a null or empty text is one end token; without training
documents N and V are 0 and every byte costs 8 bits.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Collection, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bytecontext import HELD, PIECE, ContextTree, GramCounter, encoded, grams, pieces, tree
from lodestone.llm.text import crc_mod
from lodestone.llm.workspace import bound_batches, hinted, join_classes, least_count, materialise, settled, table

#: Longest context, and contexts whose mixtures are sent to the workers, at most.
DEPTH, NODES = 4, 16_384
#: Grams after other contexts whose bits are sent to the workers, at most.
GRAMS = 1 << 20
#: Binary decisions that the driver computes at a time, to hold little.
SLICE = 16
#: Words whose counts are sent to the workers, at most.
HEAD = 1 << 20
#: Kinds of counts that the one pass over the training texts gives.
GRAM, WORD, TEXT = 0, 1, 2


def words_of(text: str | None) -> list[bytes]:
    """Words with A to Z in lower case; both methods of bytes know ASCII only."""
    return encoded(text).lower().split()


def hashes(words: Collection[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counter, held, n_texts = GramCounter(), Counter(), 0

    def handed():
        yield pd.DataFrame({"kind": GRAM, "key": counter.codes, "n": counter.counts})
        yield pd.DataFrame({"kind": WORD, "key": hashes(held), "n": np.array(list(held.values()), np.int64)})
        yield pd.DataFrame({"kind": [TEXT], "key": [0], "n": [n_texts]})

    for b in batches:
        n_texts += len(b)
        for t in b["text"]:
            held.update(words_of(t))
        for flat, at, _ in pieces([encoded(t) for t in b["text"]], DEPTH):
            counter.add(grams(flat, at, DEPTH))
        if len(counter) > HELD and len(counter.codes) > HELD or len(held) > HELD // 2:
            yield from handed()
            counter, held, n_texts = GramCounter(), Counter(), 0
    yield from handed()


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after a shift by six."""
    shift = np.log(x) + np.log(x + 1) + np.log(x + 2) + np.log(x + 3) + np.log(x + 4) + np.log(x + 5)
    y = x + 6
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


def _log_gamma(x: Column) -> Column:
    """``log_gamma`` as an expression."""
    y = x + 6
    shift = F.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) - shift


def _shorter(depth: int) -> Column:
    """The last ``depth`` bytes of a context."""
    return F.col("ctx").bitwiseAND(F.lit((1 << (8 * depth)) - 1))


def _decisions(codes: DataFrame, *kept: str) -> DataFrame:
    """``ctx, dec, one`` (and ``kept``): the eight binary decisions of each gram; ``dec`` is a one and the bits known before."""
    bits = codes.select(F.shiftright("code", 8).alias("ctx"), F.col("code").bitwiseAND(F.lit(255)).cast("int").alias("sym"), *kept, F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    return bits.select("ctx", F.expr("shiftleft(1, bit) | shiftright(sym, 8 - bit)").alias("dec"), F.expr("shiftright(sym, 7 - bit) & 1").alias("one"), *kept)


def context_weights(codes: DataFrame) -> list[DataFrame]:
    """By depth, ``ctx, dec, n0, n1, longer, kt, total`` of every context and every decision after it, from ``code, n``."""
    at = _decisions(codes, "n").groupBy("ctx", "dec").agg(F.sum(F.col("n") * (1 - F.col("one"))).alias("n0"), F.sum(F.col("n") * F.col("one")).alias("n1"), F.lit(0.0).alias("longer"))
    out = []
    for depth in range(DEPTH, -1, -1):
        kt, longer = F.col("kt"), F.col("longer")
        at = at.withColumn("kt", _log_gamma(F.col("n0") + 0.5) + _log_gamma(F.col("n1") + 0.5) - _log_gamma(F.col("n0") + F.col("n1") + 1.0) - math.log(math.pi))
        mixed = F.greatest(kt, longer) + F.log1p(F.exp(-F.abs(kt - longer))) - math.log(2)
        at = materialise(at.withColumn("total", kt if depth == DEPTH else mixed), "weights")
        out.insert(0, at)
        if depth:
            at = at.groupBy(_shorter(depth - 1).alias("ctx"), "dec").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("total").alias("longer"))
    return out


def context_mixtures(weights: list[DataFrame]) -> list[DataFrame]:
    """By depth, ``ctx, dec, p``: the mixture's probability of a one where no longer context is known."""
    out, above = [], None
    for depth, at in enumerate(weights):
        stop = F.lit(1.0) if depth == DEPTH else 1 / (1 + F.exp(F.least(F.lit(60.0), F.greatest(F.lit(-60.0), F.col("longer") - F.col("kt")))))
        at = at.select("ctx", "dec", stop.alias("stop"), ((F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)).alias("own"))
        if above is None:
            at = at.withColumns({"gathered_": F.lit(0.0), "reach_": F.lit(1.0)})
        else:
            up = above.select(F.col("ctx").alias("up"), "dec", F.col("gathered").alias("gathered_"), F.col("reach").alias("reach_"))
            at = at.withColumn("up", _shorter(depth - 1)).join(up, ["up", "dec"])
        gathered = F.col("gathered_") + F.col("reach_") * F.col("stop") * F.col("own")
        above = materialise(at.select("ctx", "dec", gathered.alias("gathered"), (F.col("reach_") * (1 - F.col("stop"))).alias("reach")), "mixtures")
        out.append(above.select("ctx", "dec", (F.col("gathered") + 0.5 * F.col("reach")).alias("p")))
    return out


def gram_bits(codes: DataFrame, mixtures: list[DataFrame]) -> DataFrame:
    """``code, bits``: log2 of the mixture's probability of each gram, from its deepest known context."""
    d = _decisions(codes, "code")
    for depth, m in enumerate(mixtures):
        m = m.select(F.col("ctx").alias("c"), F.col("dec").alias("d"), F.col("p").alias(f"p_{depth}"))
        d = d.join(hinted(m, 48), (_shorter(depth) == F.col("c")) & (F.col("dec") == F.col("d")), "left").drop("c", "d")
    p = F.coalesce(*[F.col(f"p_{depth}") for depth in range(DEPTH, -1, -1)], F.lit(0.5))
    p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), p))
    return d.groupBy("code").agg(F.sum(F.log2(F.when(F.col("one") == 1, p).otherwise(1 - p))).alias("bits"))


def sent_grams(codes: DataFrame, contexts: ContextTree, mixtures: list[DataFrame]) -> pd.DataFrame:
    """``code, bits`` of the most frequent grams of training whose whole context is not a node, by code."""
    whole = codes.sparkSession.createDataFrame(pd.DataFrame({"ctx": contexts.ctx[contexts.depth == DEPTH]}), "ctx long")
    rest = materialise(codes.join(F.broadcast(whole), F.shiftright("code", 8) == F.col("ctx"), "left_anti"), "grams")
    often = rest.where(F.col("n") >= least_count(rest, "n", GRAMS)).select("code")
    return gram_bits(often, mixtures).toArrow().to_pandas().sort_values("code")  # GRAMS bounds these rows


def unsent(contexts: ContextTree, weights: list[DataFrame]) -> np.ndarray:
    """By node and decision, the weights of the next longer contexts that are not nodes."""
    out = np.zeros((contexts.n, 256))
    nodes = weights[0].sparkSession.createDataFrame(pd.DataFrame({"depth": contexts.depth, "ctx": contexts.ctx}))
    for depth in range(1, DEPTH + 1):
        own, up = (F.broadcast(nodes.where(F.col("depth") == d).select("ctx")) for d in (depth, depth - 1))
        rest = weights[depth].select("ctx", "dec", "total").join(own, "ctx", "left_anti").select(_shorter(depth - 1).alias("ctx"), "dec", "total").join(up, "ctx")
        r = rest.groupBy("ctx", "dec").agg(F.sum("total").alias("w")).toArrow().to_pandas()  # the nodes bound these rows
        at = np.array([contexts.number[depth - 1, c] for c in r["ctx"].astype(int)], np.int64)
        out[at, r["dec"].to_numpy(np.int64)] = r["w"].to_numpy(np.float64)
    return out


def weighted_log2(contexts: ContextTree, counts: np.ndarray, others: np.ndarray) -> np.ndarray:
    """log2 of the mixture's probability of each byte, by deepest node; ``others`` are the weights of contexts that are not nodes."""
    n, out = contexts.n, np.zeros((contexts.n, 256), np.float32)
    inner = contexts.depth < DEPTH
    levels = [np.flatnonzero(contexts.depth == d) for d in range(contexts.most + 1)]
    block = lambda c: log_gamma(c[..., 0] + 0.5) + log_gamma(c[..., 1] + 0.5) - log_gamma(c.sum(-1) + 1) - math.log(math.pi)
    one = lambda c: (c[..., 1] + 0.5) / (c.sum(-1) + 1)
    for bit in range(8):  # the decisions after `bit` known bits: 2 ** bit of them, some at a time
        wide = 256 >> bit
        for low in range(0, 2**bit, SLICE):
            cut = slice(low * wide, min(2**bit, low + SLICE) * wide)
            own = counts[:, cut].reshape(n, -1, 2, wide // 2).sum(3, dtype=np.float64)
            kt, p_own = block(own), one(own)
            longer = others[:, 2**bit + low : 2**bit + min(2**bit, low + SLICE)].astype(np.float64)
            total = kt.copy()
            for at in reversed(levels):
                here = at[inner[at]]
                total[here] = np.logaddexp(kt[here], longer[here]) - math.log(2)
                if len(at) and at[0]:
                    np.add.at(longer, contexts.parent[at], total[at])
            stop = np.where(inner[:, None], 1 / (1 + np.exp(np.clip(longer - kt, -60, 60))), 1.0)
            reach, gathered = np.ones_like(kt), np.zeros_like(kt)
            for at in levels[1:]:
                p = contexts.parent[at]
                gathered[at] = gathered[p] + reach[p] * stop[p] * p_own[p]
                reach[at] = reach[p] * (1 - stop[p])
            bit_one = np.clip(gathered + reach * (stop * p_own + (1 - stop) * 0.5), 1e-9, 1 - 1e-9)
            both = np.log2(np.stack([1 - bit_one, bit_one], -1)).astype(np.float32)
            out[:, cut] += np.repeat(both.reshape(n, -1), wide // 2, axis=1)
    return out


class _Numbers(dict):
    """A number for each word asked for, in the order of their first."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = len(self)
        return out


class Model:
    """What the workers need: the tree with its table, the bits of ``often`` met grams beside it, and the head of the vocabulary."""

    def __init__(
        self, contexts: ContextTree | None, log2: np.ndarray | None, mixtures: list[DataFrame], often: pd.DataFrame, keys: np.ndarray, counts: np.ndarray, texts: int, tokens: int, types: int
    ):
        if mixtures:  # there are other contexts: only after a whole one is the mixture sure to be that of the node
            log2[contexts.depth < DEPTH] = math.nan
        self.contexts, self.log2, self.mixtures = contexts, None if log2 is None else log2.ravel(), mixtures
        # the last code is above all grams, so that each finds a place
        self.codes, self.bits = np.append(often["code"].to_numpy(np.int64), 1 << 62), np.append(often["bits"].to_numpy(np.float64), 0.0)
        self.tokens, self.types, self.texts = tokens, types, texts
        self.keys, self.logs = keys, np.log10((counts + 0.5) / self.scale())

    def scale(self) -> float:
        return self.tokens + 0.5 * (self.types + 1)

    def __getstate__(self):
        return self.__dict__ | {"mixtures": []}

    def log10(self, texts: list[bytes]) -> np.ndarray:
        """log10 of the probability of each text, without the bytes of grams that were not sent."""
        return self.scored(texts)[0]

    def scored(self, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """``log10`` of the texts; and text, gram and count of the bytes whose grams were not sent, by node or alone."""
        if self.contexts is None:
            return np.array([-8.0 * len(t) for t in texts]) * math.log10(2), []
        out, rare = np.zeros(len(texts)), []
        width = 8 * (DEPTH + 1)
        for flat, at, owner in pieces(texts, DEPTH):
            bits = self.log2[self.contexts.cells(flat, at)]
            lost = np.flatnonzero(np.isnan(bits))
            if len(lost):
                bits[lost] = 0
                code = grams(flat, at[lost], DEPTH)
                place = np.searchsorted(self.codes, code)
                sent = self.codes[place] == code
                out += np.bincount(owner[lost[sent]], self.bits[place[sent]], len(texts))
                if not sent.all():
                    # texts of a batch are fewer than the bits left
                    key, n = np.unique(owner[lost[~sent]].astype(np.int64) << width | code[~sent], return_counts=True)
                    rare.append((key >> width, key & ((1 << width) - 1), n))
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            np.add.at(out, owner[first], np.add.reduceat(bits, first, dtype=np.float64))
        return out * math.log10(2), rare

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """By text tokens, tokens known from the head and their base score, the end token included; and text, hash and count of the other words."""
        n_tokens, n_known, base, rest = np.ones(len(texts), np.int64), np.full(len(texts), int(self.texts > 0)), np.full(len(texts), math.log10((self.texts + 0.5) / self.scale())), []
        ends = np.cumsum([len(t) for t in texts])
        low = 0
        while low < len(texts):  # texts of PIECE bytes at a time, or a longer one
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PIECE, "right")))
            found = [t.lower().split() for t in texts[low:high]]
            sizes, numbers = np.array([len(f) for f in found]), _Numbers()
            number = np.fromiter(map(numbers.__getitem__, chain.from_iterable(found)), np.int64, sizes.sum())
            owner = np.repeat(np.arange(low, high), sizes)
            keys = hashes(numbers)
            place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
            in_head = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)
            known = in_head[number]
            n_tokens[low:high] += sizes
            n_known += np.bincount(owner[known], minlength=len(texts))
            base += np.bincount(owner[known], self.logs[place[number[known]]], len(texts))
            if self.types and not known.all():  # without any type no word is known
                pair, n = np.unique(owner[~known] * len(numbers) + number[~known], return_counts=True)
                rest.append((pair // len(numbers), keys[pair % len(numbers)], n))
            low = high
        return n_tokens, n_known, base, rest


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """A model of the texts of ``docs``, and the table ``key, n`` of its word counts."""
    bound_batches(docs.sparkSession)
    counts = docs.select("text").mapInPandas(_counted, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "counts")
    words = counts.where(F.col("kind") == WORD).select("key", "n")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    texts = counts.where(F.col("kind") == TEXT).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    head = words.where(F.col("n") >= least_count(words, "n", HEAD)).toArrow().to_pandas().sort_values("key")  # HEAD bounds these rows
    codes = counts.where(F.col("kind") == GRAM).select(F.col("key").alias("code"), "n")
    chosen, seen = tree(codes, DEPTH, NODES)
    contexts = ContextTree(chosen) if len(chosen) else None
    weights = context_weights(codes) if len(chosen) == NODES else []  # with fewer, the nodes are all contexts
    others = unsent(contexts, weights) if weights else np.zeros((len(chosen), 256))
    log2 = weighted_log2(contexts, contexts.dense(seen), others) if contexts else None
    mixtures = context_mixtures(weights)
    often = sent_grams(codes, contexts, mixtures) if mixtures else pd.DataFrame({"code": [], "bits": []})
    tokens, types = int(sums["n"]) + int(texts), int(sums["v"]) + (texts > 0)
    return Model(contexts, log2, mixtures, often, head["key"].to_numpy(np.int64), head["n"].to_numpy(np.float64), int(texts), tokens, types), words


def score(docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score, bits_per_byte`` for every row of ``docs``."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # NODES, GRAMS and HEAD bound it; the other mixtures stay tables
    plain = [F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("named")]  # a null would make floats of a batch of ids
    rows = docs.select(*plain, "text", F.xxhash64("doc_id", "text").alias("row_key"))
    joins_grams = bool(model.mixtures)

    def passed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row for a text, and one for each word and gram of it that the model doesn't have."""
        own = shared.value
        for b in batches:
            raw = [encoded(t) for t in b["text"]]
            n_tokens, n_known, base, rest = own.words(raw)
            scores, rare = own.scored(raw)
            yield pd.DataFrame(
                {
                    "kind": TEXT, "row_key": b["row_key"], "key": 0, "tf": 0, "doc_id": b["doc_id"], "named": b["named"], "n_tokens": n_tokens, "n_known": n_known,
                    "base": base, "score": scores, "n_bytes": [len(r) for r in raw],
                }
            )
            row_keys = b["row_key"].to_numpy(np.int64)
            tails = [(WORD, *r) for r in rest] + [(GRAM, *r) for r in rare if joins_grams]
            for kind, at, key, n in tails:
                yield pd.DataFrame({"kind": kind, "row_key": row_keys[at], "key": key, "tf": n, "doc_id": 0, "named": False, "n_tokens": 0, "n_known": 0, "base": 0.0, "score": 0.0, "n_bytes": 0})

    scale = model.scale()
    both = "kind int, row_key long, key long, tf long, doc_id long, named boolean, n_tokens long, n_known long, base double, score double, n_bytes long"
    both = materialise(rows.select("doc_id", "named", "row_key", "text").mapInPandas(passed, both), "passed")
    tail = both.where(F.col("kind") != TEXT).select("kind", "row_key", "key", "tf")
    word = F.col("kind") == WORD
    wanted = materialise(tail.groupBy("kind", "key").agg(F.count("*").alias("c")), "wanted")
    known = wanted.where(word).join(words, "key", "left").select("kind", "key", "n", F.lit(None).cast("double").alias("bits"), "c")
    if joins_grams:
        bits = gram_bits(wanted.where(~word).select(F.col("key").alias("code")), model.mixtures)
        known = known.unionByName(wanted.where(~word).join(bits, F.col("key") == F.col("code")).select("kind", "key", F.lit(None).cast("long").alias("n"), "bits", "c"))
    tail = join_classes(tail, materialise(known, "known"), ["kind", "key"]).groupBy("row_key").agg(
        F.sum(F.when(word, F.col("tf") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / scale))).alias("tail_base"),
        F.sum(F.when(word & F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("tf") * F.col("bits")).alias("tail_bits"),
    )
    out = both.where(F.col("kind") == TEXT).select(F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), "row_key", "n_tokens", "n_known", "base", "score", "n_bytes")
    equal = out.groupBy("row_key").agg(F.count("*").alias("equal")).where("equal > 1")
    joined = out.join(tail, "row_key", "left").join(equal, "row_key", "left")
    share = F.coalesce("equal", F.lit(1))
    total = F.col("score") + F.coalesce(F.col("tail_bits") / share, F.lit(0.0)) * math.log10(2)
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce(F.col("tail_known") / share, F.lit(0)).cast("long")).alias("n_known"),
        (F.col("base") + F.coalesce(F.col("tail_base") / share, F.lit(0.0))).alias("base_score"),
        total.alias("score"),
        (-total / math.log10(2) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )


def op10_lm_score(spark, sf_dir):
    """Base and model score of every document, learned from those not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return settled(spark, "lm", lambda: _scored(docs))


def _scored(docs: DataFrame) -> DataFrame:
    held = crc_mod(F.col("doc_id"), 5) == 1
    model, words = train(docs.where(~held))
    return score(docs, model, words).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte"
    )
