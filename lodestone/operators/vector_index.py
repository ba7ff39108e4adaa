"""A vector index of lists around centres, which searches exactly or in a few lists only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.views import squared_distance
from lodestone.operators import tiles
from lodestone.operators.retrieval import top

#: Vectors that the centres are learnt from, about; every vector is put into a list.
SAMPLE = 100_000


@dataclass
class VectorIndex:
    """``lists``: vectors with their ``list``, stored by list; ``centres``: ``list, centre, radius, n``, at most as many rows as lists."""

    lists: DataFrame
    centres: DataFrame


def build(vectors: DataFrame, path: str, lists: int = 16, seed: int = 7) -> VectorIndex:
    """Put ``vec_id, embedding`` into lists below ``path``, partitioned by list.

    The centres come from a sample of about ``SAMPLE`` vectors chosen by a hash of the id. An empty table gives an empty index.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    spark = vectors.sparkSession
    v = vectors.where("embedding is not null").withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    n = v.count()
    if n == 0:
        none = v.select("vec_id", "embedding", F.lit(0).alias("list"))
        return VectorIndex(none, none.select("list", F.col("embedding").cast("array<double>").alias("centre"), F.lit(0.0).alias("radius"), F.lit(0).cast("long").alias("n")))
    share = min(1.0, SAMPLE / n)
    some = v if share == 1.0 else v.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    model = KMeans(k=max(1, min(lists, n)), seed=seed, maxIter=10, initMode="k-means||").fit(some.select("features"))
    centre = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "list int, centre array<double>")
    put = model.transform(v).select("vec_id", "embedding", F.col("prediction").alias("list"))
    put.write.partitionBy("list").parquet(f"{path}/lists")
    stored = spark.read.schema(put.schema).parquet(f"{path}/lists")
    far = stored.join(F.broadcast(centre), "list").groupBy("list").agg(F.sqrt(F.max(squared_distance(F.col("embedding"), F.col("centre")))).alias("radius"), F.count("*").alias("n"))
    centre.join(far, "list").write.parquet(f"{path}/centres")
    return VectorIndex(stored, spark.read.parquet(f"{path}/centres"))


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int = 4, exact: bool = True) -> DataFrame:
    """``query_id, vec_id, score, rank`` of the ``k`` nearest, as ``retrieval.vector_search`` gives them.

    The ``probes`` nearest lists give a first ``k``. With ``exact``, every other list follows whose ball may hold a vector that
    scores no worse than the last of these (by the triangle inequality, with the rounding of scores as slack); without it
    the first ``k`` are the result. Queries meet the vectors of a list in blocks of both.
    """
    asked, longest = queries.count(), index.centres.agg(F.max("n")).first()[0] or 0
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    near = q.crossJoin(F.broadcast(index.centres)).withColumn("d", F.sqrt(squared_distance(F.col("q"), F.col("centre"))))  # centres are at most as many as lists
    near = top(near, ["query_id"], ["d", "list"], 1 << 30).select("query_id", "q", "list", "radius", "d", F.col("rank").alias("nth"))

    def scored(pairs: DataFrame) -> DataFrame:
        found = tiles.nearest(index.lists, pairs, k, longest, asked, ("list",))
        return found.select("query_id", "vec_id", F.round("s", 6).alias("score"))

    order = [F.desc("score"), "vec_id"]
    first = top(scored(near.where(F.col("nth") <= probes)), ["query_id"], order, k)
    if not exact:
        return first
    worst = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("worst"))
    least = F.greatest(F.col("d") - F.col("radius") - 1e-9, F.lit(0.0))
    rest = near.where(F.col("nth") > probes).join(worst, "query_id", "left").where(F.col("worst").isNull() | (1 / (1 + least * least) >= F.col("worst") - 1e-6))
    return top(first.drop("rank").unionByName(scored(rest)), ["query_id"], order, k)
