from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalars as X
from lodestone.operators import metrics as M


def of(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(c) for c in df.columns]).alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [("50.3%", [50.3, 0.503]), ("(123)", [-123.0]), ("−1.9 million", [-1.9, -1.9e6]), ("$1,200 and 3", [1200.0, 3.0]), ("none", [])])
def test_numbers(spark, text, want):
    assert of(spark, X.numbers, text) == pytest.approx(want)


@pytest.mark.parametrize("gold, said, want", [
    ("127.4", "$127.40", 1), ("127.4", "150", 0), ("0.935", "93.5%", 1), ("-12.3", "(12.3)", 1), ("4575515.0", "4575515000", 1), ("0.728", "it is 72.8%\nANSWER: 82.8%", 0), ("x", "3", 0), ("3", None, 0), ("0", "0", 1),
])
def test_number_match(spark, gold, said, want):
    assert of(spark, X.number_match, said, gold) == want


def test_submission(spark):
    assert [of(spark, X.submission, t) for t in ("93.5%", "$688 million", "none", "(5)", "50 %", "12345678.5", "−1,200.50", "$ 007", "1e9", "ANSWER: -0", "0.1%", None)] == ["0.935", "688", "", "5", "0.5", "12345678.5", "-1200.5", "7", "1", "0", "0.001", ""]


def test_labels_maps_and_names(spark):
    df = spark.createDataFrame([(["text", "picture", "table"], ["text", "odd"], [], {"a": 1, "b": 2}, {"b": 3}, None)], "x array<string>, y array<string>, z array<string>, m map<string,int>, n map<string,int>, o map<string,int>")
    r = df.select(*[X.primary_label(F.col(c)).alias(c) for c in "xyz"], X.merge_maps(F.col("m"), F.col("o"), F.col("n")).alias("m"), X.rename_keys(F.col("m"), {"a": "b"}).alias("k"), X.rename_keys(F.col("n"), {"b": "q"}).alias("q")).first()
    assert tuple(r)[:3] == ("table", "text", None) and r["m"] == {"a": 1, "b": 3} and r["k"] == {"b": 2} and r["q"] == {"q": 3}
    docs = spark.createDataFrame([("u/My Doc.pdf", "T"), ("x", "mydoc two"), ("y", None)], "uri string, title string")
    assert docs.where(X.name_filter(["my doc"], F.col("uri"), F.col("title"))).count() == 2 and X.name_filter([], F.col("uri"), F.col("title")) is None
    p = spark.createDataFrame([([3], 10), ([5, 3], 2048), ([], 5 << 40)], "p array<int>, n long").select(X.page_label(F.col("p")), X.byte_label(F.col("n"))).collect()
    assert [tuple(r) for r in p] == [("p. 3", "10.0 B"), ("pp. 3-5", "2.0 KB"), (None, "5.0 TB")]
    v = spark.createDataFrame([("0.9.0",), ("0.58.1",)], "v string").orderBy(F.desc(X.version_key(F.col("v")))).first()["v"]
    assert v == "0.58.1"


def ranked(spark, relevant, run, k):
    rel = spark.createDataFrame([(1, x) for x in relevant], "query_id int, doc_id string")
    got = M.ranked_metrics(spark.createDataFrame([(1, x, i) for i, x in enumerate(run, 1)], "query_id int, doc_id string, rank int"), rel, k).first()
    return got["ap"], got["ndcg"]


def test_metric_goldens(spark):
    assert ranked(spark, "1", "123", 5)[0] == 1.0 and ranked(spark, "2", "123", 5)[0] == 0.5 and ranked(spark, "13", "123", 5)[0] == pytest.approx(5 / 6, abs=1e-6)
    assert ranked(spark, "a", "ba", 5)[1] == pytest.approx(0.63093, abs=1e-5) and ranked(spark, "ab", "acb", 3)[1] == pytest.approx(1.5 / 1.63093, abs=1e-5) and ranked(spark, "abc", "ab", 2)[1] == 1.0
    none = spark.createDataFrame([], "refused boolean, answerable boolean")
    assert tuple(M.refusals(none).first()) == (0.0, 0.0)
    assert tuple(M.micro_macro(spark.createDataFrame([(1, True), (1, False), (2, True), (3, None)], "conv_id int, passed boolean")).first()) == (0.666667, 0.75)
