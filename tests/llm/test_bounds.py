"""What the driver and a worker hold does not grow with the tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.llm import collocations, jaccard, workspace


def test_only_keys_of_a_large_part_of_the_rows_are_sent(spark):
    classes = workspace.materialise(spark.range(20_000).select(F.col("id").alias("k"), F.lit(300).cast("long").alias("c"), F.lit(1).alias("x")), "classes")
    joined = workspace.join_classes(spark.range(10).select(F.col("id").alias("k")), classes, ["k"])
    assert sorted(r["k"] for r in joined.collect()) == list(range(10))
    assert f">= {-(-20_000 * 300 // workspace.HOT_KEYS)})" in joined._jdf.queryExecution().optimizedPlan().toString() and workspace.HOT_KEYS <= 10_000


def test_long_tables_of_ids_are_not_sent_by_the_driver(spark, monkeypatch):
    ids = workspace.materialise(spark.range(120_000).select("id"), "ids")
    plan = lambda df: spark.range(9).join(jaccard._told(df), "id", "left_anti")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan(ids) and "strategy=broadcast" in plan(workspace.materialise(spark.range(9), "few"))
    rows = [(i, f"a b c d e f g w{i // 3}", "en") for i in range(90)] + [(200, "", "en"), (None, "a b c", "en"), (300, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = sorted(map(repr, jaccard.one_of_each(docs).collect()))
    monkeypatch.setattr(jaccard, "TOLD", 0)
    assert sorted(map(repr, jaccard.one_of_each(docs).collect())) == want and len(want) == 33


def test_phrases_are_counted_by_blocks_of_bounded_text(monkeypatch):
    monkeypatch.setattr(collocations, "TEXT_BYTES", 1000)
    texts = ["x" * (i * 7 % 90) for i in range(400)] + ["y" * 5000, None, "", "z"]
    whole = pa.record_batch([pa.array(texts), pa.array([f"l{i}" for i in range(len(texts))])], ["text", "lang"])
    blocks = list(collocations._gathered_texts(iter([whole.slice(0, 3), whole.slice(3, 300), whole.slice(303, 0), whole.slice(303)])))
    assert [x for t, _ in blocks for x in t.to_pylist()] == texts and [x for _, k in blocks for x in k.to_pylist()] == whole.column("lang").to_pylist()
    assert all(sum(len(x or "") for x in t.to_pylist()) <= 1000 or len(t) == 1 for t, _ in blocks) and len(blocks) < 60
