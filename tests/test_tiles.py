from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions.views import squared_distance
from lodestone.operators import retrieval as R
from lodestone.operators import tiles


def by_pairs(vectors, queries, k):
    """The search by an expression over all pairs."""
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    scored = vectors.crossJoin(F.broadcast(q)).select("query_id", "vec_id", F.round(1 / (1 + squared_distance(F.col("embedding"), F.col("q"))), 6).alias("score"))
    return R.top(scored, ["query_id"], [F.desc("score"), "vec_id"], k)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_query_meets_vectors_one_by_one(spark):
    v = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).cast("array<float>").alias("embedding"))
    assert "Cartesian" not in plan_of(R.vector_search(v, v.where("vec_id % 10 = 0"), 3)) and "Join" not in plan_of(R.vector_search(v, v.where("vec_id % 10 = 0"), 3))


def test_blocks_give_what_all_pairs_give(spark, monkeypatch):
    for name, value in (("VECTORS", 50), ("LEAST", 7), ("QUERIES", 9), ("TILE", 4), ("PAIRS", 11)):
        monkeypatch.setattr(tiles, name, value)
    r = random.Random(5)
    rows = [(i, [r.choice([0.0, 0.5, 1.0, 3.25]) for _ in range(3)]) for i in range(400)]  # many ties
    rows += [(1000 + i, [r.gauss(0, 1) * 10 ** r.randint(-4, 4) for _ in range(3)]) for i in range(100)] + [(2000 + i, [1e-3] * 3) for i in range(80)]
    odd = [(3000, None), (3001, [1.0]), (3002, [1.0, None, 2.0]), (3003, []), (3004, [float("inf"), 1.0, 0.0]), (3005, [float("nan"), 0.0, 1.0]), (3006, [1e30, 0.0, 0.0])]
    v = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(3)
    q = v.where("vec_id % 20 = 0 or vec_id >= 3000")
    for k in (1, 7, 600):
        assert sorted(map(repr, R.vector_search(v, q, k).collect())) == sorted(map(repr, by_pairs(v, q, k).collect()))


def test_ids_that_are_texts_and_few_vectors(spark):
    v = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("é", [1.0, 0.0]), ("z", None)], "vec_id string, embedding array<float>")
    got = R.vector_search(v, v.where("vec_id = 'b'"), 4).orderBy("rank").collect()
    assert [(x["vec_id"], x["score"]) for x in got] == [("a", 1.0), ("b", 1.0), ("é", 1.0), ("z", None)]
    assert R.vector_search(v.limit(0), v, 2).count() == 0 and R.vector_search(v, v.limit(0), 2).count() == 0


def test_rounding_is_that_of_decimal_digits(spark):
    s = [0.0000005, 0.0123455, 0.1234565, 1 / 3, 0.0, 1.0, 2.5e-6, 1.5e-6] + [(2 * i + 1) / 2e6 for i in range(500)]
    want = [x[0] for x in spark.createDataFrame([(x,) for x in s], "s double").select(F.round("s", 6)).collect()]
    assert np.allclose(tiles.rounded(np.array(s), 6), np.array(want) * 1e6, atol=1e-6)


def test_sums_of_blocks_are_those_of_all_documents(spark, monkeypatch):
    for name, value in (("DOCUMENTS", 40), ("LEAST", 9), ("QUERIES", 5)):
        monkeypatch.setattr(tiles, name, value)
    r = random.Random(3)
    word = lambda: r.choice("abcdefghijklmnop") + r.choice("xy")
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(r.randint(1, 30)))) for i in range(300)] + [(900, None), (901, ""), (902, "..")], "doc_id long, text string")
    queries = spark.createDataFrame([(i, " ".join(word() for _ in range(r.randint(1, 6)))) for i in range(20)] + [(50, None), (51, "unknown"), (52, "ax ax")], "query_id long, query string")
    kept = {(q, d): (s, n) for q, d, s, n in R.bm25(docs, queries, 7).collect()}
    every = {(q, d): (s, n) for q, d, s, n in R.bm25(docs, queries, 1000).collect()}
    assert kept == {x: v for x, v in every.items() if v[1] <= 7} and len(kept) > 100
    plan = plan_of(R.bm25(docs, queries, 7))
    assert "FlatMapCoGroupsInArrow" in plan and "sum(" not in plan  # no row for each query and document


def test_texts_as_ids_of_documents(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("é", "one three"), ("c", None)], "doc_id string, text string")
    queries = spark.createDataFrame([("q", "one two"), ("p", "three"), ("n", "none")], "query_id string, query string")
    got = sorted((x["query_id"], x["rank"], x["doc_id"]) for x in R.bm25(docs, queries, 2).collect())
    assert got == [("p", 1, "é"), ("q", 1, "a"), ("q", 2, "b")]
    assert R.bm25(docs.limit(0), queries, 2).count() == 0
