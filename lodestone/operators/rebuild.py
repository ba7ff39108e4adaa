"""Rebuilds of chunks that embed only what changed.

A vector depends on nothing but the model and the text that is embedded, so chunks are known by a hash of these two. A
rebuild cuts all chunks anew, which is cheap, takes the vectors of known hashes from the chunks of before, and embeds each
hash that is new once, however many chunks share it. Chunks that are no longer cut are gone with the old table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import views as V
from lodestone.functions.embedding import Embedder

#: Chunks of one hash from which it is joined apart from the others, by broadcast if such hashes are few.
HOT = 50_000


def chunk_key(model: str, told: Column) -> Column:
    """Hash (128 bits) of a model's name and the text that it embeds; a null text counts as empty."""
    return F.md5(F.concat(F.lit(model), F.lit("\0"), F.coalesce(told, F.lit(""))))


def _looked_up(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """``rows`` left-joined with ``vectors`` (one row a ``key``); keys on many rows are joined apart."""
    hot = V.stored(rows.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") >= HOT).select("key"), "hot")
    if hot.isEmpty():
        return rows.join(vectors, "key", "left")
    few = V.sized(hot)
    own = V.sized(V.stored(vectors.join(few, "key", "left_semi"), "hot-vectors"))
    return rows.join(few, "key", "left_anti").join(vectors, "key", "left").unionByName(rows.join(few, "key", "left_semi").join(own, "key", "left"))


def delta_embedded(cut: DataFrame, known: DataFrame | None, told: Column, embed: Embedder, model: str) -> DataFrame:
    """``cut`` with ``key``, ``vector`` and ``reused``, true where the vector comes from ``known`` (``key, vector``).

    Columns of those names in ``cut`` are replaced. Rows that are repeated stay repeated; a null text is embedded as an
    empty one; of several vectors of one key any counts, as they are equal. Without ``known``, or with an empty one,
    all keys are embedded, each once.
    """
    rows = cut.drop("key", "vector", "reused").withColumns({"key": chunk_key(model, told), "_told": F.coalesce(told, F.lit(""))})
    rows = V.stored(rows, "cut")
    made = lambda texts: texts.select("_told").distinct().select(chunk_key(model, F.col("_told")).alias("key"), embed(F.col("_told")).alias("vector"), F.lit(False).alias("reused"))
    if known is None:
        return _looked_up(rows.drop("_told"), V.stored(made(rows), "vectors"))
    # only keys are compared; of the texts, those of new keys are shuffled
    keys, known = V.stored(rows.select("key").distinct(), "keys"), known.where("vector is not null")
    lacking = V.stored(keys.join(known.select("key").distinct(), "key", "left_anti"), "lacking")
    kept = known.join(keys, "key", "left_semi").groupBy("key").agg(F.first("vector").alias("vector")).withColumn("reused", F.lit(True))
    return _looked_up(rows.drop("_told"), V.stored(kept.unionByName(made(rows.join(V.sized(lacking), "key", "left_semi"))), "vectors"))


def delta_counts(cut: DataFrame, known: DataFrame, id_col: str) -> DataFrame:
    """``id_col, n_chunks, n_reused, n_new, n_gone`` of an embedded cut against the chunks of before, by document.

    A chunk is gone if its document no longer has one of its key; of a document that is gone, all chunks are. ``n_new``
    counts chunks, so a text that two chunks share is counted twice, though it is embedded once. A null id is an id.
    """
    a = cut.select(F.col(id_col).alias("_id"), "key", "reused", F.lit(False).alias("_old"))
    b = known.select(F.col(id_col).alias("_id"), "key", F.lit(None).cast("boolean").alias("reused"), F.lit(True).alias("_old"))
    by_key = a.unionByName(b).groupBy("_id", "key").agg(F.count_if(~F.col("_old")).alias("_now"), F.count_if("reused").alias("_r"), F.count_if("_old").alias("_was"))
    out = by_key.groupBy("_id").agg(
        F.sum("_now").alias("n_chunks"), F.sum("_r").alias("n_reused"), F.sum(F.col("_now") - F.col("_r")).alias("n_new"),
        F.sum(F.when(F.col("_now") == 0, F.col("_was")).otherwise(0)).alias("n_gone"),
    )
    return out.withColumnRenamed("_id", id_col)
