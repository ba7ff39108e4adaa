from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.client import Corpus
from lodestone.functions import embedding as E
from lodestone.operators import rebuild as D

DOCS = "uri string, title string, content string"


def counting(spark):
    made = spark.sparkContext.accumulator(0)

    def model(texts):
        made.add(len(texts))
        return [[float(len(t)), float(sum(map(ord, t)) % 97)] for t in texts]

    return made, E.batched(model)


def chunks_of(corpus):
    return sorted(map(repr, corpus.store.read("chunks").select("id", "content", "heading", "key", "vector").collect()))


def test_a_rebuild_embeds_only_what_changed(spark, tmp_path):
    made, embed = counting(spark)
    long = "# Sea\n\nWhales sing long songs under the sea.\n\nTheir calves drink milk.\n\n# Land\n\nGoats climb steep rocks."
    c = Corpus(spark, str(tmp_path / "db"), embed, words=8)
    c.add(spark.createDataFrame([("a", None, long), ("b", None, "Swifts sleep."), ("c", None, "Swifts sleep."), ("d", None, None)], DOCS))
    n = len({r.key for r in c.store.read("chunks").collect()})
    assert c.store.read("chunks").count() == n + 1 and made.value == n  # two documents share a text
    c.add(spark.createDataFrame([("a", None, long + " And sheep.")], DOCS))
    assert made.value == n + 1
    c.rebuild()
    assert made.value == n + 1
    was = chunks_of(c)
    c.rechunk(1000)
    assert chunks_of(c) != was
    c.rechunk(8)
    fresh = Corpus(spark, str(tmp_path / "again"), embed, words=8)
    fresh.add(spark.createDataFrame([("a", None, long + " And sheep."), ("b", None, "Swifts sleep."), ("c", None, "Swifts sleep."), ("d", None, None)], DOCS))
    assert chunks_of(c) == chunks_of(fresh) == was
    made.value = 0
    c.rebuild(embed=embed, model="other")
    assert made.value == n and {r.key for r in c.store.read("chunks").collect()}.isdisjoint(r.key for r in fresh.store.read("chunks").collect())


def test_delta_on_nulls_ties_and_hot_texts(spark, monkeypatch):
    made, embed = counting(spark)
    told = "doc_id long, content string, key string, extra int"
    old = spark.createDataFrame([(1, "a", "x", 1), (1, "a", "x", 1), (2, None, "x", 2), (None, "b", "x", 3), (3, "", "x", 4)], told)
    first = D.delta_embedded(old, None, F.col("content"), embed, "m").collect()
    assert made.value == 3 and len(first) == 5 and not any(r.reused for r in first) and {r.extra for r in first} == {1, 2, 3, 4}
    known = spark.createDataFrame(first, "key string, doc_id long, content string, extra int, vector array<float>, reused boolean") if first[0].__fields__[0] == "key" else spark.createDataFrame(first)
    new = spark.createDataFrame([(1, "a", "y", 1), (2, "z" * 100_000, "y", 2), (4, "z" * 100_000, "y", 3), (None, None, "y", 4)] + [(5, "b", "y", 5)] * 4, told)
    plain = sorted(map(repr, D.delta_embedded(new, known, F.col("content"), embed, "m").collect()))
    assert made.value == 4
    monkeypatch.setattr(D, "HOT", 2)
    hot = D.delta_embedded(new, known, F.col("content"), embed, "m")
    assert sorted(map(repr, hot.collect())) == plain
    counts = {r.doc_id: tuple(r)[1:] for r in D.delta_counts(hot, known, "doc_id").collect()}
    assert counts == {1: (1, 1, 0, 0), 2: (1, 0, 1, 1), 3: (0, 0, 0, 1), 4: (1, 0, 1, 0), 5: (4, 4, 0, 0), None: (1, 1, 0, 1)}
    none = D.delta_embedded(new.limit(0), known.limit(0), F.col("content"), embed, "m")
    assert none.count() == 0 and D.delta_counts(none, known.limit(0), "doc_id").count() == 0
