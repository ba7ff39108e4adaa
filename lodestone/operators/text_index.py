"""A stored full-text index: postings in blocks with their greatest impact, updated for changed documents only.

Documents are dealt to slices of documents of about the same length. All postings of a
term in a slice are one block: its ids, counts and lengths, and beside them its size, its
greatest count and its least length. These bound what the term adds to any score in that
slice, whatever the averages of the corpus are by then, so they stay valid after updates.

A search sums these bounds by query and slice from the narrow columns alone. The slices with
the greatest sums are scored first; their k-th score is a floor, and of the other slices only
those follow whose sum reaches it. A document is in one slice, so slices are scored each by
themselves, and the result is exact.

An update writes one more segment for the changed documents, and the places of their old
postings to a table of dead ones; it reads the new texts and the list of documents, not the
corpus. Sizes and averages leave the dead ones out. ``compact`` is a build anew.

Layout below a path: ``postings`` (``segment, bucket, term, slice, n, total, max_tf, min_len, docs, tfs,
lens``, partitioned by segment and by a hash of the term) and ``dead`` (``segment, slice, doc_id, len``).
The empty term has every document once.

Defined results: a null text has no words but counts as a document; ids must not repeat, null ids
are left out; a query without words finds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import words
from lodestone.functions.views import sized, stored, tokens
from lodestone.operators.retrieval import top

#: Documents of one class of lengths in a slice, at most about; folders by a hash of the term; slices scored first.
SLICE, BUCKETS, FIRST = 1024, 16, 16
#: Room for the rounding of scores.
SLACK = 2e-5


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _blocks(docs: DataFrame, segment: int) -> DataFrame:
    """The blocks of ``doc_id, text``: texts meet by slice, and a slice is inverted in one Arrow group."""
    parts = max(1, -(-docs.count() // SLICE))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kind = F.floor(2 * F.log2(F.coalesce(F.octet_length("text"), F.lit(0)) / 6 + 1)).cast("long")  # classes of lengths, so that the least length of a block says much
    at = F.lit(segment).cast("long") * (1 << 44) + kind * (1 << 32) + F.pmod(F.xxhash64("doc_id"), F.lit(parts))
    dealt = docs.where("doc_id is not null").select("doc_id", F.lower("text").alias("text"), at.alias("slice"))

    def invert(group: pa.Table) -> pa.Table:
        group = group.take(pc.array_sort_indices(group.column("doc_id").combine_chunks()))
        texts, ids = group.column("text").combine_chunks(), group.column("doc_id").combine_chunks()
        lens, held, known, at = np.zeros(len(ids), np.int32), [], [pa.array([""], pa.large_string())], 1
        for begin, end in words.cut(texts):  # the words of some texts at a time
            lens[begin:end], distinct, doc, word, tf = words.counts(texts.slice(begin, end - begin))
            held.append((doc + begin, word + at, tf))
            known.append(distinct)
            at += len(distinct)
        held.append((np.arange(len(ids)), np.zeros(len(ids), np.int64), np.ones(len(ids), np.int64)))  # every document has the empty term
        coded = pa.concat_arrays(known).dictionary_encode()
        doc, word, tf = (np.concatenate(x) for x in zip(*held, strict=True))
        word = coded.indices.to_numpy()[word]
        order = np.lexsort((doc, word))
        doc, word, tf = doc[order], word[order], tf[order].astype(np.int32)
        term, start, n = np.unique(word, return_index=True, return_counts=True)
        size, offsets = lens[doc], pa.array(np.append(start, len(doc)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (ids.take(pa.array(doc)), pa.array(tf), pa.array(size))]
        values = [pa.array(n), pa.array(np.add.reduceat(size.astype(np.int64), start)), pa.array(np.maximum.reduceat(tf, start)), pa.array(np.minimum.reduceat(size, start)), *lists]
        names = ["term", "slice", "n", "total", "max_tf", "min_len", "docs", "tfs", "lens"]
        return pa.table([coded.dictionary.take(pa.array(term)).cast(pa.string()), pa.array(np.full(len(term), group.column("slice")[0].as_py())), *values], names)

    kinds = f"term string, slice long, n long, total long, max_tf int, min_len int, docs array<{id_type}>, tfs array<int>, lens array<int>"
    g = dealt.groupBy("slice").applyInArrow(invert, kinds)
    return g.select(F.lit(segment).alias("segment"), _bucket(F.col("term")).alias("bucket"), "term", "slice", "n", "total", "max_tf", "min_len", "docs", "tfs", "lens")


@dataclass
class TextIndex:
    spark: SparkSession
    path: str
    id_type: str
    segments: int

    def postings(self) -> DataFrame:
        kinds = f"term string, slice long, n long, total long, max_tf int, min_len int, docs array<{self.id_type}>, tfs array<int>, lens array<int>, segment int, bucket int"
        return self.spark.read.schema(kinds).parquet(f"{self.path}/postings").where(F.col("segment") < self.segments)

    def dead(self) -> DataFrame:
        """Places of postings that no longer count."""
        kinds = f"slice long, doc_id {self.id_type}, len int, segment int"
        if self.segments < 2:
            return self.spark.createDataFrame([], kinds)
        return self.spark.read.schema(kinds).parquet(f"{self.path}/dead").where(F.col("segment") < self.segments)

    def documents(self) -> DataFrame:
        """``doc_id, slice, len`` of the documents that count."""
        every = self.postings().where((F.col("bucket") == F.expr(f"pmod(xxhash64(''), {BUCKETS})")) & (F.col("term") == ""))
        rows = every.select("slice", F.explode(F.arrays_zip("docs", "lens")).alias("p")).select(F.col("p.docs").alias("doc_id"), "slice", F.col("p.lens").alias("len"))
        return rows.join(self.dead().select("slice", "doc_id"), ["slice", "doc_id"], "left_anti") if self.segments > 1 else rows

    def _write(self, blocks: DataFrame) -> None:
        blocks.repartition("bucket", F.pmod(F.xxhash64("term"), F.lit(256))).sortWithinPartitions("bucket", "term", "slice").write.mode("append").partitionBy("segment", "bucket").parquet(f"{self.path}/postings")

    def update(self, changed: DataFrame, gone: DataFrame | None = None) -> TextIndex:
        """The index after new texts of ``changed`` (``doc_id, text``), known or not, and without the ids of ``gone``."""
        ids = changed.select("doc_id") if gone is None else changed.select("doc_id").unionByName(gone.select("doc_id"))
        old = self.documents().join(ids.distinct(), "doc_id", "left_semi")
        old.select("slice", "doc_id", "len", F.lit(self.segments).alias("segment")).write.mode("append").partitionBy("segment").parquet(f"{self.path}/dead")
        self._write(_blocks(changed.select("doc_id", "text"), self.segments))
        return TextIndex(self.spark, self.path, self.id_type, self.segments + 1)


def build(docs: DataFrame, path: str) -> TextIndex:
    """Index ``doc_id, text`` below ``path``."""
    index = TextIndex(docs.sparkSession, path, docs.schema["doc_id"].dataType.simpleString(), 1)
    index._write(_blocks(docs.select("doc_id", "text"), 0))
    return index


@dataclass
class Search:
    """hits: ``query_id, doc_id, score, rank``; bounds: ``query_id, slice, bound, blocks, nth, floor, read``."""

    hits: DataFrame
    bounds: DataFrame


def search(index: TextIndex, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, first: int = FIRST) -> Search:
    """The ``k`` best documents of each query (``query_id, query``) by BM25, as ``retrieval.bm25`` gives them."""
    spark = index.spark
    terms = stored(queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term")), "index-terms")
    wanted = terms.select("term").distinct().unionByName(spark.range(1).select(F.lit("").alias("term")))
    narrow = index.postings().select("bucket", "term", "slice", "n", "total", "max_tf", "min_len")
    blocks = stored(narrow.join(sized(stored(wanted.withColumn("bucket", _bucket(F.col("term"))), "index-wanted")), ["bucket", "term"]).drop("bucket"), "index-blocks")
    dead = index.dead()
    lost = dead.agg(F.count("*").alias("lost_n"), F.coalesce(F.sum("len"), F.lit(0)).alias("lost_len"))
    whole = blocks.where("term = ''").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    (n, total), (lost_n, lost_len) = whole.first(), lost.first()
    docs, mean = n - lost_n, (total - lost_len) / max(1, n - lost_n)
    df = blocks.where("term <> ''").groupBy("term").agg(F.sum("n").alias("df"))
    if index.segments > 1:  # dead postings of the wanted terms, in the slices that have some
        met = _wide(index, sized(stored(terms.select("term").distinct().join(blocks, "term").select("term", "slice").join(dead.select("slice").distinct(), "slice", "left_semi"), "index-affected")))
        less = met.join(dead.select("slice", "doc_id"), ["slice", "doc_id"], "left_semi").groupBy("term").agg(F.count("*").alias("less"))
        df = df.join(less, "term", "left").select("term", (F.col("df") - F.coalesce("less", F.lit(0))).alias("df"))
    df = df.where("df > 0").select("term", F.log(1 + (F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    asked = stored(terms.join(df, "term"), "index-asked")
    part = lambda tf, size: F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / F.lit(float(mean) or 1.0)))
    bounds = asked.join(blocks.where("term <> ''"), "term").groupBy("query_id", "slice").agg(F.sum(part(F.col("max_tf"), F.col("min_len"))).alias("bound"), F.count("*").alias("blocks"))
    bounds = stored(bounds, "index-bounds")
    order = [F.desc("score"), "doc_id"]

    def scored(slices: DataFrame) -> DataFrame:
        wide = _wide(index, sized(stored(asked.join(slices.select("query_id", "slice"), "query_id").join(blocks.select("term", "slice"), ["term", "slice"], "left_semi"), "index-read")))
        if index.segments > 1:
            wide = wide.join(dead.select("slice", "doc_id"), ["slice", "doc_id"], "left_anti")
        return wide.groupBy("query_id", "doc_id").agg(F.round(F.sum(part(F.col("tf"), F.col("len"))), 5).alias("score"))

    lead = top(bounds, ["query_id"], [F.desc("bound"), "slice"], first)
    best = stored(top(scored(lead), ["query_id"], order, k), "index-first")
    floor = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    judged = bounds.join(lead.select("query_id", "slice", F.col("rank").alias("nth")), ["query_id", "slice"], "left").join(floor, "query_id", "left")
    judged = stored(judged.withColumn("read", F.col("nth").isNotNull() | F.col("floor").isNull() | (F.col("bound") + SLACK >= F.col("floor"))), "index-judged")
    rest = scored(judged.where("read and nth is null"))
    return Search(top(best.drop("rank").unionByName(rest), ["query_id"], order, k), judged)


def _wide(index: TextIndex, pairs: DataFrame) -> DataFrame:
    """The postings of some ``term, slice`` (and other columns), a row each with ``doc_id, tf, len``."""
    kept = [c for c in pairs.columns if c not in ("term", "slice")]
    read = index.postings().select("term", "slice", "docs", "tfs", "lens").join(pairs, ["term", "slice"])
    rows = read.select("term", "slice", *kept, F.explode(F.arrays_zip("docs", "tfs", "lens")).alias("p"))
    return rows.select("term", "slice", *kept, F.col("p.docs").alias("doc_id"), F.col("p.tfs").alias("tf"), F.col("p.lens").alias("len"))
