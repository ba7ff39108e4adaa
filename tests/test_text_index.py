"""The stored text index against a search without one."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodestone.operators import retrieval as R
from lodestone.operators import text_index as TI

SCHEMA = "doc_id long, text string"


def docs_of(spark, n=600, seed=1):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choices(words, [1 / (j + 1) for j in range(60)], k=rnd.randrange(1, 80)))) for i in range(n)]
    return spark.createDataFrame([*rows, (9001, ""), (9002, "w1 w1 w1 w1"), (9003, "w1 w1 w1 w1")], SCHEMA)


QUERIES = [(1, "w1 w5 w59"), (2, "w0"), (3, "w58 W57, w56 w55"), (4, "none"), (5, ""), (6, "w1"), (7, None)]


def same(index, docs, queries, k, first=TI.FIRST):
    found = TI.search(index, queries, k, first=first)
    assert sorted(map(tuple, found.hits.collect())) == sorted(map(tuple, R.bm25(docs, queries, k).collect()))
    return found.bounds


def test_search_equals_a_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(TI, "SLICE", 100)
    docs, queries = docs_of(spark), spark.createDataFrame(QUERIES, "query_id long, query string")
    index = TI.build(docs, str(tmp_path / "i"))
    bounds = same(index, docs, queries, 5, first=4)
    assert bounds.where("not read").count() > 0.3 * bounds.count()  # blocks that the search leaves out
    same(index, docs, queries, 1, first=1)
    same(index, docs, queries, 5000)


def test_updates(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(TI, "SLICE", 100)
    docs, queries = docs_of(spark), spark.createDataFrame(QUERIES, "query_id long, query string")
    index = TI.build(docs, str(tmp_path / "i"))
    changed = spark.createDataFrame([(3, "w59 w59"), (4, "brand new"), (9002, ""), (7000, "w1 w58")], SCHEMA)
    after = index.update(changed, gone=spark.createDataFrame([(10,), (11,), (123456,)], "doc_id long"))
    now = docs.join(changed, "doc_id", "left_anti").where("doc_id not in (10, 11)").unionByName(changed)
    same(after, now, queries, 5)
    same(index, docs, queries, 5)  # the version before still reads as it was
    again = spark.createDataFrame([(3, "w1 w2"), (12, "w57 w57 w57")], SCHEMA)
    last = after.update(again)
    now = now.join(again, "doc_id", "left_anti").unionByName(again)
    same(last, now, queries, 5)
    assert sorted(r["doc_id"] for r in last.documents().collect()) == sorted(r["doc_id"] for r in now.collect())
    assert last.postings().where("segment = 2").agg(F.sum(F.size("docs"))).first()[0] == 5  # w1, w2, w57 and a row a document


def test_edge_cases(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, "a b"), (None, "a")], SCHEMA)
    queries = spark.createDataFrame([(1, "a")], "query_id long, query string")
    hits = TI.search(TI.build(docs, str(tmp_path / "i")), queries, 3).hits.collect()
    assert [(r["doc_id"], r["rank"]) for r in hits] == [(2, 1)]
    assert TI.search(TI.build(docs.limit(0), str(tmp_path / "e")), queries, 3).hits.count() == 0


def test_a_slice_holds_the_documents_of_its_class(spark, tmp_path):
    rows = [(i, f"w{i % 3} b") for i in range(300)] + [(1000 + i, "long " * (50 * i)) for i in range(1, 9)] + [(2000, None), (None, "w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = TI.build(docs, str(tmp_path / "index"))
    held = {r["term"]: (r["n"], r["total"], r["max_tf"], r["min_len"], r["docs"], r["tfs"], r["lens"]) for r in index.postings().where("term in ('b', 'w2')").collect()}
    assert held["b"] == (300, 600, 1, 2, list(range(300)), [1] * 300, [2] * 300) and held["w2"][4] == list(range(2, 300, 3))
    assert sorted(r["doc_id"] for r in index.documents().collect()) == [*range(300), *range(1001, 1009), 2000]
    blocks = TI._blocks(docs, 0)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in blocks and "collect_list" not in blocks
