from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import chunking as K
from lodestone.operators import retrieval as R
from lodestone.operators import vector_index as VI

ITEM = "doc_id long, position long, label string, text string, self_ref string"


def chunks(spark, rows, most, merge=True):
    items = spark.createDataFrame([(1, i, label, text, f"#/{i}") for i, (label, text) in enumerate(rows)], ITEM)
    return [(r["headings"], r["refs"], r["content"], r["n_tokens"]) for r in K.hybrid_chunks(items, most, merge).orderBy("section", "part").collect()]


def test_peers_are_merged_within_their_section(spark):
    rows = [("text", "a b"), ("text", "c"), ("section_header", "h"), ("text", "d"), ("list_item", "e f"), ("text", "g h i"), ("section_header", "k"), ("text", "l"), ("text", " "), ("text", None)]
    assert chunks(spark, rows, 4) == [([], ["#/0", "#/1"], "a b\nc", 3), (["h"], ["#/3", "#/4"], "d\ne f", 3), (["h"], ["#/5"], "g h i", 3), (["k"], ["#/7"], "l", 1)]
    assert [c[2] for c in chunks(spark, rows, 4, merge=False)] == ["a b", "c", "d", "e f", "g h i", "l"]


def test_long_items_are_cut_and_the_heading_counts(spark):
    words = " ".join(f"w{i}" for i in range(10))
    got = chunks(spark, [("section_header", "a heading"), ("text", words), ("text", "x")], 6)
    assert [(c[2], c[3]) for c in got] == [("w0 w1 w2 w3", 4), ("w4 w5 w6 w7", 4), ("w8 w9\nx", 3)]
    assert [c[3] for c in chunks(spark, [("section_header", words), ("text", "x y")], 6)] == [1, 1]
    assert chunks(spark, [("section_header", "alone")], 6) == []


def test_chunks_of_null_and_large_ids(spark):
    rows = [(i, p, "text", f"{p} x", f"#/{p}") for i in (None, 2**53 + 1, 2**53 + 2) for p in range(3)]
    got = K.hybrid_chunks(spark.createDataFrame(rows, ITEM), 4).collect()
    assert sorted((r["doc_id"] or 0, r["part"], r["content"]) for r in got) == [(i, k, t) for i in (0, 2**53 + 1, 2**53 + 2) for k, t in enumerate(("0 x\n1 x", "2 x"))]
    assert K.hybrid_chunks(spark.createDataFrame([], ITEM), 4).count() == 0


def some_vectors(spark, n=600):
    bits = [F.sin(F.col("id") * (i + 1) * 0.37).cast("float") for i in range(6)]
    return spark.range(n).select(F.col("id").alias("vec_id"), F.array(*bits).alias("embedding"))


def test_index_search_is_exact(spark, tmp_path):
    v = some_vectors(spark).unionByName(spark.createDataFrame([(9001, None)], "vec_id long, embedding array<float>"))
    index = VI.build(v, str(tmp_path / "i"), lists=12)
    assert index.lists.count() == 600 and index.centres.agg(F.sum("n")).first()[0] == 600
    q = some_vectors(spark).where("vec_id % 50 = 0")
    want = sorted(map(tuple, R.vector_search(v.where("embedding is not null"), q, 7).collect()))
    assert sorted(map(tuple, VI.search(index, q, 7, probes=1).collect())) == want
    few = {(r["query_id"], r["vec_id"]) for r in VI.search(index, q, 7, probes=4, exact=False).collect()}
    assert len(few & {(a, b) for a, b, _, _ in want}) >= 0.9 * len(want)
    assert VI.search(index, q, 1000, probes=1).count() == 600 * q.count()


def test_empty_index(spark, tmp_path):
    v = some_vectors(spark)
    assert VI.search(VI.build(v.limit(0), str(tmp_path / "i")), v.limit(2), 3).count() == 0
