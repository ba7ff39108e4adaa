from __future__ import annotations

import random

import pytest

from lodestone.functions import tables as T
from lodestone.operators import structure as S

ITEM = "doc_id string, position int, label string, level int, text string, parent_pos string"


@pytest.fixture
def corpus(spark):
    random.seed(5)
    rows = [(d, p, random.choice(["section_header", "text", None]), random.choice([None, 0, 1, 2, 3, 5]), f"t{p}", "x") for d in ("a", "b", None) for p in range(40)]
    rows += [("c", 0, "text", None, None, None), ("d", 3, "section_header", 2, None, None)]
    items = spark.createDataFrame(rows, ITEM)
    meta = spark.createDataFrame([("a", "Alpha", 1), ("b", "Beta", None), ("c", None, 2), ("d", "Album", 3)], "id string, title string, `_m` int")
    chunks = spark.createDataFrame([("a-0", "a", "red fox red"), ("a-1", "a", "Red dog"), ("b-0", "b", None), ("b-1", "b", ""), ("c-0", "c", "fox fox"), ("d-0", "d", "red fox red")], "chunk_id string, document_id string, content string")
    T.register(spark, meta, items, chunks, "t_")
    return items


def test_outline_function_equals_the_operator(spark, corpus):
    want = {(r.position, r.level, r.parent_pos, r.end_pos, r.doc_id) for r in S.outline(corpus.drop("parent_pos").where("doc_id is not null")).collect()}
    got = spark.sql("SELECT * FROM t_outline(TABLE(t_items_view))").collect()
    assert {(r.position, r.level, r.parent_pos, r.end_pos, r.doc_id) for r in got if r.doc_id is not None} == want
    assert len(got) == corpus.where("label = 'section_header' and level > 0").count()  # those of a null id too
    assert spark.sql("SELECT * FROM t_outline(TABLE(SELECT * FROM t_items_view WHERE false))").count() == 0
    with pytest.raises(Exception, match="lacks"):
        spark.sql("SELECT * FROM t_outline(TABLE(SELECT doc_id FROM t_items_view))").collect()


def test_toc_and_items_of_one_and_of_each(spark, corpus):
    want = S.outline(corpus.drop("parent_pos").where("doc_id = 'a'")).select("position", "level", "text", "parent_pos", "end_pos")
    got = spark.sql("SELECT * FROM t_toc('a')")
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    each = spark.sql("SELECT m.id, t.* FROM t_meta_view m, LATERAL t_toc(m.id) t").collect()
    assert len(each) == corpus.where("label = 'section_header' and level > 0 and doc_id is not null").count()
    assert spark.sql("SELECT * FROM t_toc('zz')").count() == 0 and spark.sql("SELECT * FROM t_items(NULL)").count() == 0
    assert sorted(map(repr, spark.sql("SELECT * FROM t_items('b')").collect())) == sorted(map(repr, corpus.where("doc_id = 'b'").collect()))


def test_pages_of_documents(spark, corpus):
    page = lambda *a: [r.id for r in spark.sql("SELECT * FROM t_list_documents(?, ?, ?)", args=list(a)).collect()]
    assert page(None, None, 2) == ["a", "b"] and page(None, "b", 2) == ["c", "d"] and page(None, "d", 2) == []
    assert page("Al%", None, 5) == ["a", "d"] and page("Al%", "a", 5) == ["d"] and page(None, None, 0) == []


def test_search(spark, corpus):
    got = spark.sql("SELECT * FROM t_search('RED fox', 3)").orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["a-0", "d-0", "c-0"] and got[0].score == got[1].score > got[2].score
    for blank in ("''", "'  '", "NULL", "'unheard'"):
        assert spark.sql(f"SELECT * FROM t_search({blank}, 3)").count() == 0
