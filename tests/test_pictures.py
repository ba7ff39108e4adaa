from __future__ import annotations

import pytest

from lodestone.operators import pictures as P
from lodestone.sources import slices as S

ITEMS = "doc_id long, position int, self_ref string, label string, text string, pages array<int>, picture_data binary, width int, height int"
ROWS = [
    (1, 0, "#/texts/0", "text", "intro", [1], None, None, None),
    (1, 1, "#/pictures/0", "picture", "a chart", [2, 1, 2], b"one", 100, 80),
    (1, 2, "#/texts/1", "caption", "Figure 1", [2], None, None, None),
    (1, 3, "#/pictures/1", "picture", "again", [3], b"one", 100, 80),
    (1, 4, "#/pictures/2", "picture", None, [3], b"two", 8, 80),
    (1, 5, "#/pictures/3", "picture", "lost", [3], None, None, None),
    (2, 0, "#/pictures/0", "picture", "", [1], b"one", None, None),
]


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ROWS, ITEMS)


def test_one_chunk_for_each_distinct_picture(items):
    got = sorted((r["doc_id"], r["refs"][0], r["content"], r["pages"]) for r in P.picture_chunks(items).collect())
    assert got == [(1, "#/pictures/0", "a chart", [1, 2]), (1, "#/pictures/2", "", [3]), (2, "#/pictures/0", "", [1])]
    large = {(r["doc_id"], r["refs"][0]) for r in P.picture_chunks(items, 16).collect()}
    assert large == {(1, "#/pictures/0"), (2, "#/pictures/0")}  # a picture of unknown size stays


def test_structure_order_puts_unknown_references_last(spark, items):
    texts = spark.createDataFrame([(1, 0, "lost", ["#/no"]), (1, 1, "intro", ["#/texts/0"]), (1, 2, "bare", []), (1, 3, "cap", ["#/texts/1"])], "doc_id long, ord int, content string, refs array<string>")
    got = P.in_structure_order(texts, P.picture_chunks(items).where("doc_id = 1"), items).orderBy("ord").collect()
    assert [r["content"] for r in got] == ["intro", "a chart", "cap", "", "lost", "bare"]
    assert [r["ord"] for r in got] == list(range(6))


def test_pictures_by_reference_and_by_caption(spark, items):
    results = spark.createDataFrame([(1, 7, ["#/texts/1"]), (1, 8, ["#/pictures/2", "#/texts/0"]), (1, 9, ["#/texts/0"]), (2, 7, ["#/pictures/0"]), (1, 6, ["#/pictures/3"])], "doc_id long, result_id long, refs array<string>")
    got = {(r["doc_id"], r["result_id"]): (r["image_data"], r["picture_captions"]) for r in P.with_pictures(results, items).collect()}
    assert got[1, 7] == ({"#/pictures/0": b"one"}, {"#/pictures/0": "a chart"})
    assert got[1, 8] == ({"#/pictures/2": b"two"}, None)
    assert got[1, 9] == got[1, 6] == (None, None)
    assert got[2, 7] == ({"#/pictures/0": b"one"}, None)


def test_boxes_are_turned_and_scaled(spark):
    results = spark.createDataFrame([(1, ["a", "b"])], "doc_id long, refs array<string>")
    boxed = spark.createDataFrame([(1, "a", 1, 10.0, 90.0, 20.0, 80.0, "BOTTOMLEFT"), (1, "b", 1, 0.0, 5.0, 1.0, 6.0, "TOPLEFT"), (1, "c", 1, 0.0, 1.0, 1.0, 2.0, "TOPLEFT"), (1, "a", 2, 0.0, 1.0, 1.0, 2.0, "TOPLEFT")], "doc_id long, self_ref string, page_no int, l double, t double, r double, b double, origin string")
    pages = spark.createDataFrame([(1, 1, 100.0, 100.0, 200, 300), (1, 2, 100.0, 100.0, None, None)], "doc_id long, page_no int, width double, height double, image_width int, image_height int")
    swept = spark.createDataFrame([(1, "c"), (1, "a")], "doc_id long, self_ref string")
    got = {r["self_ref"]: (r["matched"], r["left"], r["top"], r["right"], r["bottom"]) for r in P.boxes(results, boxed, pages, swept).collect()}
    assert got == {"a": (True, 20.0, 30.0, 40.0, 60.0), "b": (True, 0.0, 15.0, 2.0, 18.0), "c": (False, 0.0, 3.0, 2.0, 6.0)}


def test_slices_cover_all_pages_and_join_in_order(spark):
    files = spark.createDataFrame([("a", 5), ("b", 0), ("c", 2)], "uri string, n_pages int")
    cut = S.page_slices(files, 2)
    assert sorted(tuple(r) for r in cut.collect()) == [("a", 0, 1, 2), ("a", 1, 3, 4), ("a", 2, 5, 5), ("c", 0, 1, 2)]
    items = spark.createDataFrame([("a", 0, 0, 1, "x"), ("a", 0, 1, 2, "y"), ("a", 2, 0, 1, "z"), ("c", 0, 0, 1, "w")], "uri string, slice int, position int, page_no int, text string")
    failed = spark.createDataFrame([("c", 0)], "uri string, slice int")
    got = S.join_slices(cut, items, failed).orderBy("position").collect()
    assert [(r["uri"], r["position"], r["page_no"], r["text"]) for r in got] == [("a", 0, 1, "x"), ("a", 1, 2, "y"), ("a", 2, 5, "z")]
    with pytest.raises(ValueError):
        S.page_slices(files, 0)


def test_attachments_and_their_reconciliation(spark):
    found = spark.createDataFrame([("p", "a b/ü.pdf", b"1"), ("p", "", b"2"), ("p", "n.txt", b"3")], "parent_uri string, name string, content binary")
    now = S.attachments(found, 0)
    assert {r["uri"] for r in now.collect()} == {"p#attachment=a%20b%2F%C3%BC.pdf", "p#attachment=n.txt"}
    assert S.attachments(found, 2).isEmpty() and not S.attachments(found, 1).isEmpty()
    known = spark.createDataFrame([("p#attachment=n.txt", "p", "old"), ("p#attachment=gone", "p", "h"), ("q#attachment=x", "q", "h")], "uri string, parent_uri string, content_hash string")
    got = {r["uri"]: r["action"] for r in S.reconcile(spark.createDataFrame([("p",)], "parent_uri string"), known, now).collect()}
    assert got == {"p#attachment=a%20b%2F%C3%BC.pdf": "add", "p#attachment=n.txt": "update", "p#attachment=gone": "delete"}
