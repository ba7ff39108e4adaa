"""Retrieval and conversation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranked_metrics(run: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """``query_id, ap, recall, ndcg`` of rows ``query_id, doc_id, rank`` against ``query_id, doc_id``."""
    from pyspark.sql import Window

    n = relevant.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    hit = run.join(relevant, ["query_id", "doc_id"]).withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    per = hit.groupBy("query_id").agg(
        F.sum(F.col("nth") / F.col("rank")).alias("s"), F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias("h"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("g")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return n.join(per, "query_id", "left").select(
        "query_id", F.round(zero(F.col("s") / F.col("n_rel")), 6).alias("ap"), F.round(zero(F.col("h") / F.col("n_rel")), 6).alias("recall"), F.round(zero(F.col("g") / ideal), 6).alias("ndcg")
    )


def micro_macro(turns: DataFrame) -> DataFrame:
    """``micro, macro`` rates of passed among judged turns ``conv_id, passed``: over all turns, and the mean over conversations.

    A null verdict is not judged; without any judged turn both are 0.
    """
    per = turns.groupBy("conv_id").agg(F.count("passed").alias("judged"), F.count_if("passed").alias("ok")).where("judged > 0")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return per.agg(F.round(zero(F.try_divide(F.sum("ok"), F.sum("judged"))), 6).alias("micro"), F.round(zero(F.avg(F.col("ok") / F.col("judged"))), 6).alias("macro"))


def refusals(answers: DataFrame) -> DataFrame:
    """``precision, recall`` of refusals from ``refused, answerable``; 0 where nothing was refused or unanswerable."""
    right = F.count_if(F.col("refused") & ~F.col("answerable"))
    zero = lambda n, d: F.round(F.coalesce(F.try_divide(n, d), F.lit(0.0)), 6)
    return answers.agg(zero(right, F.count_if("refused")).alias("precision"), zero(right, F.count_if(~F.col("answerable"))).alias("recall"))


def unresolved(qrels: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """``kind, id``: documents of the judgements that the corpus lacks, and queries without a judgement."""
    gone = qrels.select("doc_id").distinct().join(corpus.select("doc_id"), "doc_id", "left_anti").select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"))
    bare = queries.select("query_id").join(qrels.select("query_id"), "query_id", "left_anti").select(F.lit("query").alias("kind"), F.col("query_id").cast("string").alias("id"))
    return gone.unionByName(bare)
