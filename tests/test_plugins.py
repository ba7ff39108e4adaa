from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.functions import plugins
from lodestone.functions.scalars import agent_text
from lodestone.operators.structure import backfill_levels, outline


def test_reranker_scores_pairs_and_keeps_the_best(spark):
    docs = spark.createDataFrame([(1, "aa"), (2, "aaaa"), (3, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "q")], "query_id long, query string")
    candidates = spark.createDataFrame([(0, d) for d in (1, 2, 3, 2)], "query_id long, doc_id long")
    got = plugins.rerank_by(candidates, docs, queries, 2, lambda q, t: [len(x) - 2.0 for x in t], squash=True).orderBy("rank").collect()
    assert [(r["doc_id"], round(r["score"], 4)) for r in got] == [(2, 0.8808), (1, 0.5)]
    assert plugins.rerank_by(candidates.limit(0), docs, queries, 2, lambda q, t: [0.0] * len(t)).isEmpty()
    assert (plugins.overfetch(5, True), plugins.overfetch(5, False)) == (50, 5)


def test_providers_lose_reserved_keys(spark):
    docs = spark.createDataFrame([("s", "u1"), ("t", "u2"), (None, "u3")], "source string, uri string")
    known = {"p": lambda d: F.create_map(F.lit("team"), F.lit("x"), F.lit("md5"), F.lit("forged"))}
    got = docs.select("uri", plugins.Providers(known, {"s": "p", "t": None}).metadata(docs).alias("m")).collect()
    assert {r["uri"]: r["m"] for r in got} == {"u1": {"team": "x"}, "u2": {}, "u3": {}}
    with pytest.raises(LookupError):
        plugins.Providers(known, {"s": "missing"})


def test_converters_do_not_guess(spark):
    c = plugins.Converters()
    c.register(".MD", lambda d: d.withColumn("kind", F.lit("md")))
    assert c.convert(spark.range(1), ".md").first()["kind"] == "md"
    with pytest.raises(LookupError):
        c.convert(spark.range(1), ".xyz")


def test_text_of_a_result(spark):
    row = spark.createDataFrame(
        [("c1", 0.126, 1, 3, "T", ["A", "B"], ["text", "table"], {"#/p/0": "cap", "#/p/1": ""}, "body"), ("c2", 0.126, None, None, None, None, None, None, None)],
        "id string, score double, rank int, total int, title string, headings array<string>, labels array<string>, captions map<string,string>, content string",
    )
    got = [r[0] for r in row.select(agent_text(*[F.col(c) for c in row.columns])).collect()]
    assert got[0] == '[c1] [rank 1 of 3]\nSource: "T" > A > B\nType: table\nFigure caption (#/p/0): cap\nContent:\nbody'
    assert got[1] == "[c2] (score: 0.13)\nContent:\n"


def test_outline_matches_a_walk(spark):
    levels = [2, 0, 1, 3, 2, 0, 2, 12, 10, 1, 0]
    items = spark.createDataFrame([(1, i, "section_header" if v else "text", v or None, str(i)) for i, v in enumerate(levels)], "doc_id long, position int, label string, level int, text string")
    got = {r["position"]: (r["parent_pos"], r["end_pos"]) for r in outline(items).collect()}
    flat = [min(v, 9) for v in levels]
    want = {}
    for i, v in enumerate(flat):
        if v:
            want[i] = (next((j for j in range(i - 1, -1, -1) if 0 < flat[j] < v), None), next((j for j in range(i + 1, len(flat)) if 0 < flat[j] <= v), len(flat)))
    assert got == want


def test_levels_are_filled_where_the_counts_agree(spark):
    schema = "doc_id long, self_ref string, level int"
    old = spark.createDataFrame([(1, "a", None), (1, "b", 4), (2, "a", 7)], schema)
    new = spark.createDataFrame([(1, "a", 1), (1, "b", None), (2, "a", 1), (2, "b", 2)], schema)
    got = sorted(((r["doc_id"], r["self_ref"]), r["level"]) for r in backfill_levels(old, new).collect())
    assert got == [((1, "a"), 1), ((1, "b"), None), ((2, "a"), 7)]


def test_commands(spark, tmp_path, capsys):
    store = str(tmp_path / "store")
    assert cli.execute(spark, [store, "add", "mem://a", "# Rivers\n\nThe Danube flows east.", "--title", "A"]) == "version 1"
    cli.execute(spark, [store, "tag", "first"])
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "b.md").write_text("Mountains are high.")
    assert cli.execute(spark, [store, "add-files", str(folder)]) == "version 2"
    assert {r["tag"] for r in cli.execute(spark, [store, "tags"]).collect()} == {"first"}
    assert cli.execute(spark, [store, "list"]).count() == 2
    assert cli.execute(spark, [store, "search", "Danube", "--kind", "fts"]).first()["uri"] == "mem://a"
    assert "Danube" in cli.execute(spark, [store, "get", "mem://a"]).first()["content"]
    cli.execute(spark, [store, "delete", "mem://a"])
    assert cli.execute(spark, [store, "list"]).count() == 1
    cli.execute(spark, [store, "restore", "first"])
    cli.main([store, "list"])
    assert [json.loads(x)["uri"] for x in capsys.readouterr().out.splitlines()] == ["mem://a"]
