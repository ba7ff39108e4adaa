"""Phrases whose words stand together far more often than their parts do.

A pass over the texts for each length, after Park, Chen and Yu: while phrases of k
words are counted exactly, those of k + 1 words are counted by hash bucket. A phrase can
only be frequent if its bucket is, and (Apriori) if the phrases without its last and
without its first word are. Both are bitmaps of ``buckets`` bits at most, sent to all
tasks; a set bit may stand for another phrase too, which costs an exact count and no more.
As in direct hashing and pruning, only phrases both of whose parts passed are put into
buckets.

Buckets are counted in a byte each, up to the least count, which is all a bit needs: sums
of such counts reach that count if and only if the true sums do. A task gives its buckets
in blocks, whose sums are made in groups of ``FAN_IN`` tasks, so no task reads those of all.
Phrases are counted by block of texts with exact keys (places in the block's own list of
words), then by task and overall as strings, so no hash decides a count.

Texts are read as bytes: separators are ASCII, so classes of bytes part pieces and words.

Defined results: a null text is empty; null and "und" are one language; rows that repeat
count each; a text without words counts nothing; an empty table has no phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.tokenfiles import plain
from lodestone.llm.workspace import bound_batches, discard, join_classes, materialise, settled, table

LEAST, LONGEST, TOP = 30, 4, 2000
#: A bucket for so many bytes of text, between the two numbers of buckets.
BUCKET_BYTES, BUCKETS = 48, (1 << 16, 1 << 26)
#: Buckets in a block of counts, and tasks whose blocks are summed together.
BLOCK, FAN_IN = 1 << 16, 256
#: Bytes of text that are counted together, about; only a longer text is more. A worker holds some thirty times as much.
TEXT_BYTES = 1 << 20
#: Shares of a language's phrases that are ranked by themselves first.
SHARES = 64
#: Rows of counts that a task holds before they are summed.
HELD_ROWS, COUNTED = 400_000, ["lang", "phrase", "h", "n"]
#: Classes of bytes: 1 parts words, 2 parts pieces.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two 64-bit hashes, in their order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _hashed(texts: pa.Array) -> np.ndarray:
    """A 64-bit hash of each text: a sum of its bytes times powers of an odd number, and its length."""
    texts = texts.cast(pa.large_string())
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].astype(np.uint64)
    place = np.arange(len(raw)) - np.repeat(at[:-1] - at[0], size)
    powers = np.cumprod(np.full(int(size.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((raw + np.uint64(1)) * powers[place])])  # they wrap, and so do their differences
    return _mixed(sums[at[1:] - at[0]] - sums[at[:-1] - at[0]], size.astype(np.uint64))


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and the place among them of each value."""
    coded = pa.array(values).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)


class _Block:
    """The words of some texts: for each its place in a list of distinct (language, word), and whether the next is in its piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        texts = pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string())
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[len(texts)]] if len(texts) else np.empty(0, np.uint8)
        kind = _CLASS[raw]
        doc_starts = np.cumsum(sizes) - sizes
        inside = kind == 0
        begin, over = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        over[:-1] &= ~inside[1:]
        edges = doc_starts[(doc_starts > 0) & (doc_starts < len(raw))]
        begin[edges] = inside[edges]
        over[edges - 1] = inside[edges - 1]
        first, last = np.flatnonzero(begin), np.flatnonzero(over)
        breaks = kind == 2  # places that part pieces, themselves or before them
        breaks[edges] = True
        piece = np.cumsum(breaks, dtype=np.int32)[first]
        lengths = np.concatenate([[0], np.cumsum(last - first + 1)])
        words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(lengths), pa.py_buffer(raw[inside]))
        coded = words.dictionary_encode()
        doc = np.searchsorted(doc_starts, first, side="right") - 1  # of equal starts the last, which has the text
        lang = pc.fill_null(langs, "und").dictionary_encode()
        lang_of = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]
        keys, self.id = _distinct(lang_of << 32 | coded.indices.to_numpy(zero_copy_only=False))
        self.joined = piece[1:] == piece[:-1]
        self.langs = lang.dictionary.take(pa.array(keys >> 32))
        self.words = coded.dictionary.take(pa.array(keys & 0xFFFFFFFF))
        hashes = [_hashed(d) for d in (lang.dictionary, coded.dictionary)]
        self.hash = _mixed(hashes[0][keys >> 32], hashes[1][keys & 0xFFFFFFFF])[self.id] if len(keys) else np.empty(0, np.uint64)

    def hashes(self, n: int) -> np.ndarray:
        """Hashes of the n words from each place on; without meaning where the piece ends before."""
        out = self.hash[: max(0, len(self.hash) - n + 1)]
        for k in range(1, n):
            out = _mixed(out, self.hash[k : k + len(out)])
        return out

    def within(self, n: int) -> np.ndarray:
        """At which places n words of one piece begin."""
        out = np.ones(max(0, len(self.id) - n + 1), bool)
        for k in range(n - 1):
            out &= self.joined[k : k + len(out)]
        return out

    def counted(self, at: np.ndarray, n: int) -> tuple[list, np.ndarray, np.ndarray]:
        """Languages and phrases of the n words at some places, each once, with the first of its places and their number."""
        ids = self.id
        if n == 1:
            own = ids[at]
        else:  # pairs at the beginning and at the end hold all words
            ends = np.concatenate([at, at + n - 2]) if n > 2 else at
            _, own = _distinct(ids[ends] << 32 | ids[ends + 1])
            if n > 2:
                _, own = _distinct(own[: len(at)] << 32 | own[len(at) :])
        count = np.bincount(own)
        first = np.empty(len(count), np.int64)
        first[own[::-1]] = np.arange(len(own) - 1, -1, -1)
        place = at[first]
        texts = [self.words.take(pa.array(self.id[place + k])) for k in range(n)]
        phrase = pc.binary_join_element_wise(*texts, pa.scalar(" ", pa.large_string())) if n > 1 else texts[0]
        return [self.langs.take(pa.array(self.id[place])), phrase], place, count


class _Tally:
    """Counts of a task's phrases, summed again whenever ``HELD_ROWS`` are held."""

    def __init__(self):
        self.held, self.rows = [], 0

    def add(self, counts: pa.Table) -> Iterator[pa.RecordBatch]:
        self.held.append(counts)
        self.rows += counts.num_rows
        if self.rows > HELD_ROWS and len(self.held) > 1:
            self.held = [pa.concat_tables(self.held).group_by(COUNTED[:3], use_threads=False).aggregate([("n", "sum")]).rename_columns(COUNTED)]
            self.rows = self.held[0].num_rows
            if self.rows > HELD_ROWS // 2:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        for t in self.held:
            t = t.set_column(1, "phrase", t.column("phrase").cast(pa.string()))
            for k, kind in (("block", pa.int32()), ("task", pa.int32()), ("counts", pa.binary())):
                t = t.append_column(k, pa.nulls(t.num_rows, kind))
            yield from t.to_batches(max_chunksize=100_000)
        self.held, self.rows = [], 0


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _pass(docs: DataFrame, n: int, buckets: int, least: int, full: Broadcast | None, parts: Broadcast | None, ahead: bool) -> DataFrame:
    """Counts of phrases of n words by task (``lang, phrase, h, n``) and, if ``ahead``, blocks of the buckets of longer ones (``block, task, counts``)."""
    own, masked = np.uint64(buckets - 1), min(255, least)
    if least > 255:
        raise ValueError("a bucket counts up to 255")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen, told = np.zeros(buckets if ahead else 0, np.uint8), _Tally()
        for texts, langs in _gathered_texts(batches):
            block = _Block(texts, langs)
            good = block.within(n)
            if full is not None:
                h = block.hashes(n)
                at = np.flatnonzero(good)
                at = at[_has(full.value, h[at])]
                shorter = block.hashes(n - 1)
                at = at[_has(parts.value, shorter[at]) & _has(parts.value, shorter[at + 1])]
                good = np.zeros(len(good), bool)
                good[at] = True
            at = np.flatnonzero(good)
            names, place, count = block.counted(at, n)
            h = np.ascontiguousarray(block.hashes(n)[place]).view(np.int64)
            yield from told.add(pa.table([names[0].cast(pa.string()), names[1], pa.array(h), pa.array(count.astype(np.int64))], COUNTED))
            if ahead:
                longer = np.flatnonzero(block.within(n + 1) & good[:-1] & good[1:]) if len(good) else np.empty(0, np.int64)
                bucket, count = np.unique(block.hashes(n + 1)[longer] & own, return_counts=True)
                seen[bucket] = np.minimum(seen[bucket] + np.minimum(count, masked), masked)
        yield from told.rest()
        if ahead:
            size, task = min(BLOCK, buckets), TaskContext.get().partitionId()
            for k in np.flatnonzero(seen.reshape(-1, size).any(1)).tolist():
                values = [*(pa.nulls(1, t) for t in (pa.string(), pa.string(), pa.int64(), pa.int64())), pa.array([k], pa.int32()), pa.array([task], pa.int32()), pa.array([seen[k * size : (k + 1) * size].tobytes()])]
                yield pa.RecordBatch.from_arrays(values, [*COUNTED, "block", "task", "counts"])
        pa.default_memory_pool().release_unused()  # workers live on

    return docs.mapInArrow(run, "lang string, phrase string, h long, n long, block int, task int, counts binary")


def _gathered_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Texts and languages, ``TEXT_BYTES`` together about; batches of more are cut between texts."""
    held, size = [], 0

    def joined() -> tuple[pa.Array, pa.Array]:
        whole = pa.Table.from_batches(held).combine_chunks()
        return plain(whole.column("text")), plain(whole.column("lang"))

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + TEXT_BYTES - size, side="right")))
            held.append(batch.slice(at, end - at))
            size += int(ends[end - 1]) - before
            at = end
            if size >= TEXT_BYTES or at < batch.num_rows:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def _bucket_bits(counts: DataFrame, buckets: int, least: int) -> np.ndarray:
    """The bitmap of the buckets that reach ``least``, from blocks of counts by task."""
    size = min(BLOCK, buckets)

    def summed(table: pa.Table) -> np.ndarray:
        total = np.zeros(size, np.int64)
        for c in table.column("counts"):
            total += np.frombuffer(c.as_buffer(), np.uint8)
        return np.minimum(total, least)

    def partial(table: pa.Table) -> pa.Table:
        return pa.table({"block": table.column("block")[:1], "task": pc.divide(table.column("task")[:1], pa.scalar(FAN_IN, pa.int32())), "counts": pa.array([summed(table).astype(np.uint8).tobytes()])})

    def final(table: pa.Table) -> pa.Table:
        return pa.table({"block": table.column("block")[:1], "bits": pa.array([np.packbits(summed(table) >= least, bitorder="little").tobytes()])})

    tasks = counts.agg(F.max("task")).first()[0] or 0
    while tasks >= FAN_IN:
        counts = counts.groupBy("block", F.floor(F.col("task") / FAN_IN)).applyInArrow(partial, "block int, task int, counts binary")
        tasks //= FAN_IN
    bits = np.zeros((max(1, buckets // size), size // 8), np.uint8)
    for row in counts.groupBy("block").applyInArrow(final, "block int, bits binary").collect():  # a bit a bucket
        bits[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return bits.ravel()


def _phrase_bits(frequent: DataFrame, buckets: int) -> np.ndarray:
    """The bitmap of the hashes of exactly counted phrases."""
    at = F.col("h").bitwiseAND(F.lit(buckets - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    sets = frequent.groupBy(F.shiftright(at, 6).cast("int").alias("place")).agg(F.bit_or(bit).alias("bits"))
    got = sets.toArrow()  # a bit a bucket
    bits = np.zeros(buckets // 64, np.int64)
    bits[got.column("place").to_numpy()] = got.column("bits").to_numpy()
    return bits.view(np.uint8)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, f`` of phrases of up to ``longest`` words that occur ``least`` times in their language; ``lang, n`` of words.

    buckets: a power of two; None for one by the bytes of all texts, within ``BUCKETS``.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select("lang", "text")
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = min(max(BUCKETS[0], 1 << (size // BUCKET_BYTES).bit_length()), BUCKETS[1])
    tables, totals, full, parts = [], None, None, None
    for n in range(1, longest + 1):
        told = materialise(_pass(docs, n, buckets, least, full, parts, n < longest), "counts")
        counts = told.where("block is null").groupBy("lang", "phrase", "h").agg(F.sum("n").alias("f"))
        if n == 1:
            counts = materialise(counts, "words")
            totals = materialise(counts.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
        frequent = materialise(counts.where(F.col("f") >= least), "frequent")
        tables.append(frequent.select("lang", "phrase", F.lit(n).alias("words"), "f"))
        for sent in (full, parts):
            if sent is not None:
                sent.destroy()
        if n < longest:
            full = spark.sparkContext.broadcast(_bucket_bits(told.where("block is not null").select("block", "task", "counts"), buckets, least))
            parts = spark.sparkContext.broadcast(_phrase_bits(frequent, buckets))
        discard(told)
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out, totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = 80, buckets: int | None = None) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of 2 to ``longest`` words.

    Phrases inside a longer frequent one that makes up ``share`` hundredths of theirs are left out.
    """
    return settled(docs.sparkSession, "collocations", lambda: _collocations(docs, least, longest, top, share, buckets))


def _collocations(docs: DataFrame, least: int, longest: int, top: int, share: int, buckets: int | None) -> DataFrame:
    counts, totals = frequent_phrases(docs, least, longest, buckets)
    counts = materialise(counts, "phrases")
    candidates = counts.where("words > 1").withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " "))
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    left, right = F.array_join(F.slice("w", F.lit(1), F.col("k")), " "), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ")
    cuts = materialise(cuts.select("lang", "phrase", "a", "k", left.alias("left"), right.alias("right")), "cuts")
    for side, name in (("left", "l"), ("right", "r")):  # both parts of a frequent phrase are frequent
        wanted = cuts.groupBy("lang", side).agg(F.count("*").alias("c"))
        known = materialise(wanted.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side]), "parts")
        cuts = join_classes(cuts, known, ["lang", side])
    whole = "cast(2000000 as decimal(7,0)) * cast(a as decimal(24,0)) div (cast(l as decimal(24,0)) + cast(r as decimal(24,0)))"
    best = cuts.withColumn("score", F.expr(whole).cast("long")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spans = F.expr("flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    inner = candidates.where("words > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("a").alias("longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(f"longer is null or cast(100 as decimal(3,0)) * cast(longer as decimal(24,0)) < cast({share} as decimal(3,0)) * cast(a as decimal(24,0))")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share_of = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))  # the first of each share of a language, then of these
    flat = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(Window.partitionBy("lang", share_of).orderBy(*order))).where(F.col("rank") <= top)
    flat = flat.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return flat.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir):
    """The first 2000 phrases of each language over all documents."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, p FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), listed AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (
    SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM listed, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)
), counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
), totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM listed GROUP BY lang
), candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1
), cuts AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ') JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_spans AS (
  SELECT lang, a, array_to_string(w[i:i + s - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM candidates WHERE m > 2))
), longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_spans GROUP BY ALL
), kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.longer IS NULL OR CAST(100 AS HUGEINT) * o.longer < CAST(80 AS HUGEINT) * b.a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
