from __future__ import annotations

import pytest

from lodestone.operators import ledger as L

EVENTS = "conv long, capability string, seq long, kind string, question long, epoch long, chunk_ids array<string>"


def B(q):
    return ("begin", q, None, None)


def E(e):
    return ("evidence", None, e, None)


def D(e, *refs):
    return ("declare", None, e, list(refs))


def events(spark, **by):
    rows = [(1, c, i, *e) for c, es in by.items() for i, e in enumerate(es)]
    return spark.createDataFrame(rows, EVENTS)


@pytest.mark.parametrize(
    "by, want",
    [
        ({"a": [B(2)]}, "missing"),
        ({"a": [B(2), D(1, "c1")]}, "grounded"),
        ({"a": [B(2), D(1)]}, "ungrounded"),
        ({"a": [B(2), D(3, "c1"), B(8)]}, "missing"),
        ({"a": [B(2), E(5), D(5, "c1")]}, "missing"),
        ({"a": [B(2), E(5), D(5, "c1"), D(7, "c1")]}, "grounded"),
        ({"a": [B(2), E(3), D(5, "c1")]}, "grounded"),
        ({"a": [B(2), E(3), D(5, "c1")], "b": [B(2), E(7)]}, "missing"),
    ],
)
def test_status(spark, by, want):
    assert [r["status"] for r in L.citation_status(events(spark, **by)).collect()] == [want]


def test_declarations_merge_until_newer_evidence(spark):
    refs = lambda *es: L.ledgers(events(spark, a=[B(2), *es])).first()["refs"]
    assert refs(D(3, "c1"), D(3, "c2")) == ["c1", "c2"] and refs(D(3, "c1"), D(3, "c1")) == ["c1"]
    assert refs(D(3, "c1"), E(5), D(6, "c2")) == ["c2"]


def test_regressions(spark):
    bad = L.regressions(events(spark, a=[B(2), E(5), D(4, "x"), B(2), B(9), E(1)])).collect()
    assert sorted(r["seq"] for r in bad) == [2, 3]


def test_capsule_citations_budget_and_compaction(spark):
    cited = spark.createDataFrame([(1, "a", "c1", 1, 0), (1, "a", "c1", 5, 1), (1, "b", "c2", 3, 2), (1, "b", "zz", 3, 3)], "conv long, capability string, chunk_id string, question long, seq long")
    assert [(r["grp"], r["chunk_id"]) for r in L.capsule(cited).orderBy("grp", "capability", "chunk_id").collect()] == [(1, "c1"), (2, "c2"), (2, "zz")]
    results = spark.createDataFrame([(1, "c1", "old", 1), (1, "c1", "new", 2), (1, "c2", "two", 3)], "conv long, chunk_id string, content string, rank long")
    got = L.resolve_citations(cited, results).orderBy("seq").collect()
    assert [(r["chunk_id"], r["content"], r["number"]) for r in got] == [("c1", "new", 1), ("c1", "new", 1), ("c2", "two", 2)]
    assert [r["seq"] for r in L.over_budget(cited, 1).orderBy("seq").collect()] == [3]
    messages = spark.createDataFrame([(1, 0, "search", "r0"), (1, 1, "other", "r1"), (1, 2, "search", "r2"), (1, 9, "search", "r9"), (1, 3, None, "t")], "conv long, seq long, tool string, text string")
    out = {r["seq"]: r["text"] for r in L.compact(messages, 5, ["search"], "CAPSULE").collect()}
    assert out == {0: "[compacted] search", 1: "r1", 2: "CAPSULE", 9: "r9", 3: "t"}
