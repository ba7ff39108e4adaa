from __future__ import annotations

from difflib import get_close_matches

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalars as X
from lodestone.operators import evaluation as E
from lodestone.operators import queue as Q
from lodestone.operators import structure as S
from lodestone.sources import store as T


def test_metric_means_skip_nulls(spark):
    rows = spark.createDataFrame([("MapEvaluator", 0.5), ("MapEvaluator", 1.0), ("MapEvaluator", None)], "metric string, value double")
    assert [tuple(r) for r in E.metric_means(rows).collect()] == [("map", 0.75, 2)]
    assert E.metric_means(rows.limit(0)).count() == 0


def test_last_sample_of_a_question_counts(spark):
    cases = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, question string")
    samples = spark.createDataFrame([("a", ["x"], 1, None), ("a", ["y"], 2, False), ("a", ["z"], 3, True), (None, ["n"], 4, None)], "question string, uris array<string>, seq long, skip boolean")
    got = {r["id"]: r["relevant_uris"] for r in E.attach_relevant(cases, samples).collect()}
    assert got == {1: ["y"], 2: None, 3: None}


def test_resume_replaces_documents_without_chunks(spark):
    corpus = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "uri string")
    meta = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "id long, uri string")
    chunks = spark.createDataFrame([(1,), (1,)], "document_id long")
    got = {r["uri"]: (r["action"], r["old_id"]) for r in E.resume_plan(corpus, meta, chunks).collect()}
    assert got == {"a": ("skip", None), "b": ("replace", 3), "c": ("import", None), None: ("import", None)}


def test_turn_rates(spark):
    turns = [(1, 1, True, "UNANSWERABLE", True, 0.5), (1, 3, None, "ANSWERABLE", True, None), (1, 5, False, "PARTIAL", True, 1.0), (2, 1, None, None, None, None)]
    got = {r["conv_id"]: r for r in E.turn_rates(spark.createDataFrame(turns, "conv_id long, turn long, passed boolean, label string, refused boolean, cited_ap double")).collect()}
    r = got[1]
    assert (r.turns_passed, r.turns_judged, r.turns_total, r.turn_pass_rate, r.cited_eligible, r.cited_map) == (1, 2, 3, 0.5, 2, 0.75)
    assert (r.true_refusals, r.false_refusals, r.unanswerable_turns) == (1, 1, 1)
    assert r["keys"] == {"turn_1_pass": "true", "turn_1_refused": "true", "turn_1_cited_ap": "0.5", "turn_2_refused": "true", "turn_3_pass": "false", "turn_3_cited_ap": "1.0"}
    assert (got[2].turn_pass_rate, got[2].cited_map, got[2]["keys"]) == (0.0, None, {})


def test_tool_traffic_counts_own_tools_only(spark):
    parts = [
        ("r", 1, "response", "call", "rag_search", None), ("r", 1, "response", "call", "rag_search", None), ("r", 2, "request", "return", "rag_search", "failed"),
        ("r", 2, "request", "return", "rag_search", "success"), ("r", 2, "request", "retry", "rag_cite", None), ("r", 2, "request", "retry", None, None),
        ("r", 2, "request", "return", "other", "failed"), ("r", 3, "response", None, None, None),
    ]
    df = spark.createDataFrame(parts, "run string, message long, side string, kind string, tool string, outcome string")
    assert [tuple(r) for r in E.tool_traffic(df, "rag", ["rag_search", "rag_cite"]).collect()] == [("r", 2, 1, 2, 2)]


@pytest.mark.parametrize(("k", "want"), [(1, {1: "x", 2: None}), (2, {1: ["x", "y"], 2: []})])
def test_submission_rows(spark, k, want):
    predictions = spark.createDataFrame([(1, "a", "Answer: 12%"), (2, "b", None)], "id long, question string, output string")
    retrieved = spark.createDataFrame([("a", "z", 3), ("a", "x", 1), ("a", "y", 2)], "question string, context_id string, rank long")
    got = E.submission_rows(predictions, retrieved, "s", X.submission(F.col("output")), k).collect()
    assert {r["id"]: r["context_id"] for r in got} == want
    assert {r["id"]: r["prediction"] for r in got} == {1: "0.12", 2: ""}


def test_nearest_ids_equal_the_library(spark):
    known = ["3f2a-77b1-90cd", "3f2a-77b1-90ce", "aaaa-bbbb-cccc", None]
    cited = ["3f2a-77b1-90cd", "3f2a-77b-90cd", "aaaa-cccc", "zz", "", None]
    df = spark.createDataFrame([(c, known) for c in cited] + [("x", None), ("x", [])], "chunk_id string, known array<string>")
    got = [r["resolved"] for r in E.nearest_ids(df).collect()]
    real = [x for x in known if x]
    assert got == [c if c is None else (get_close_matches(c, real, 1, 0.75) or [c])[0] for c in cited] + ["x", "x"]


def test_citation_policy(spark):
    ev = [
        ("redirect", "begin", 1, None), ("redirect", "evidence", 2, None), ("gone", "begin", 1, None), ("gone", "evidence", 2, None), ("asked", "begin", 1, None), ("asked", "evidence", 2, None),
        ("told", "begin", 1, None), ("told", "evidence", 2, None), ("told", "declare", 3, ["c"]), ("aside", "begin", 1, None),
        ("reuse", "begin", 1, None), ("reuse", "declare", 2, ["c"]), ("reuse", "begin", 3, None),
    ]
    events = spark.createDataFrame([(c, "rag", n, k, n, n, ids) for c, k, n, ids in ev], "conv string, capability string, seq long, kind string, question long, epoch long, chunk_ids array<string>")
    asked = spark.createDataFrame([("asked", 1), ("redirect", 0)], "conv string, question long")
    can = spark.createDataFrame([("redirect",), ("asked",), ("told",), ("reuse",)], "conv string")
    got = {r["conv"]: (r["question"], r["action"], r["violated"]) for r in E.citation_policy(events, asked, can).collect()}
    assert got == {"redirect": (1, "redirect", True), "gone": (1, "violation", True), "asked": (1, "none", True), "told": (1, "none", False), "aside": (1, "none", False), "reuse": (3, "redirect", True)}


def test_structural_title(spark):
    rows = [
        (1, 0, "section_header", "head", "body"), (1, 1, "title", " body ", "body"), (1, 2, "title", "f1", "furniture"), (1, 3, "title", "f2", "furniture"), (1, 4, "title", "  ", "furniture"),
        (2, 0, "section_header", " ", "body"), (2, 1, "section_header", "h1", None), (2, 2, "section_header", "h2", "body"), (3, 0, "title", "b1", None), (3, 1, "title", "b2", "body"), (4, 0, "text", "t", "body"), (5, 0, "title", None, "body"),
    ]
    got = S.structural_title(spark.createDataFrame(rows, "doc_id long, position long, label string, text string, layer string")).collect()
    assert {r["doc_id"]: r["title"] for r in got} == {1: "f2", 2: "h1", 3: "b1"}


def test_citation_text_leaves_out_what_is_null(spark):
    rows = [(1, None, "u", None, None, None, "c"), (2, "t", "u", [4, 7], ["a", "b"], ["#/p/0"], "c"), (3, "t", "u", [4], [], [], None)]
    df = spark.createDataFrame(rows, "n long, title string, uri string, pages array<int>, headings array<string>, pics array<string>, content string")
    got = [r[0] for r in df.select(X.citation_text(*[F.col(c) for c in df.columns])).collect()]
    assert got == ["[1] u u\nc\n", "[2] t u - pp. 4-7, Section: b\n[Figure: #/p/0]\nc\n", "[3] t u - p. 4\n\n"]
    assert [r[0] for r in spark.range(1).select(X.cited_texts(F.array().cast("array<string>"))).collect()] == [""]


def test_meta_options(spark):
    df = spark.createDataFrame([(["a=1", "b=[1, 2]", "c=x=y", 'd=say "hi"', "e=", "a=null", None, "g=true"],)], "o array<string>")
    assert df.select(X.meta_options(F.col("o"))).first()[0] == {"a": "null", "b": "[1,2]", "c": '"x=y"', "d": '"say \\"hi\\""', "e": '""', "g": "true"}
    for bad in ("novalue", "=v"):
        with pytest.raises(Exception, match="KEY=VALUE"):
            spark.createDataFrame([([bad],)], "o array<string>").select(X.meta_options(F.col("o"))).collect()


def test_data_uris(spark):
    df = spark.createDataFrame([("data:image/png;base64,aGk=",), ("data:text/plain,hi",), ("http://x",), (None,)], "u string")
    assert [r[0] for r in df.select(X.decoded_uri(F.col("u"))).collect()] == [b"hi", None, None, None]


def test_document_page_of_an_empty_table_has_one_page(spark):
    meta = spark.createDataFrame([(f"{i:03}",) for i in range(101)], "id string")
    last = T.document_page(meta, 3).collect()
    assert [tuple(r) for r in last] == [("100", 101, 3, 3)]
    assert T.document_page(meta.limit(0)).count() == 0


def test_split_columns_goes_on_where_it_stopped(spark):
    wide = spark.createDataFrame([(1, "a", None), (2, "b", "m")], "id long, uri string, metadata string")
    rows, slim = T.split_columns(wide, spark.createDataFrame([(2,)], "id long"), ["uri", "metadata", "title"], {"metadata": "{}"})
    assert [tuple(r) for r in rows.collect()] == [(1, "a", "{}")]
    assert slim.columns == ["id"]


def test_drain_report_never_falls(spark):
    rows = [("queued", None), ("succeeded", "2024-01-02"), ("succeeded", "2023-01-02"), ("dead", "2024-01-03")]
    q = spark.createDataFrame(rows, "status string, completed_at string").withColumn("completed_at", F.col("completed_at").cast("timestamp"))
    since = F.lit("2024-01-01").cast("timestamp")
    assert tuple(Q.drain_report(q, since).first()) == (3, 2, 1, 1, 1, 0)
    assert tuple(Q.drain_report(q, since, 9).first()) == (9, 2, 1, 1, 1, 0)
    assert tuple(Q.drain_report(q.limit(0), since).first()) == (0, 0, 0, 0, 0, 0)
