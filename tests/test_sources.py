from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from lodestone.sources import adapters as A
from lodestone.sources import files as X


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) and not isinstance(v, bool) else 'boolean' if isinstance(v, bool) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_filter(spark):
    paths = ["a.md", "b/c.MD", "b/d.txt", "node/x.md", "b/node/y.md", "b/draft-1.md", "e"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    keep = lambda **k: [r["path"] for r in df.where(X.included(F.col("path"), **k)).collect()]
    assert keep(extensions=[".md"]) == ["a.md", "b/c.MD", "node/x.md", "b/node/y.md", "b/draft-1.md"]
    assert keep(ignore=["node/", "draft-*"]) == ["a.md", "b/c.MD", "b/d.txt", "e"]
    assert keep(include=["b/**"], ignore=["**/node/*"]) == ["b/c.MD", "b/d.txt", "b/draft-1.md"] and keep(include=["/*.md"]) == ["a.md"]


def test_listing_and_diff(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.md").write_text("one")
    (tmp_path / "d" / "b.md").write_text("two")
    (tmp_path / "d" / "c.bin").write_text("x")
    found = X.listing(spark, str(tmp_path), extensions=[".md"])
    read = found._jdf.queryExecution().executedPlan().toString().partition("ReadSchema:")[2]
    assert "length" in read and "content" not in read.splitlines()[0]
    known = spark.createDataFrame(found.collect(), found.schema).select("uri", "revision")
    assert sorted(r["path"] for r in found.collect()) == ["a.md", "d/b.md"]
    os.utime(tmp_path / "a.md", (1, 1))
    (tmp_path / "d" / "b.md").unlink()
    (tmp_path / "n.md").write_text("new")
    got = {r["uri"].rpartition("/")[2]: r["action"] for r in X.discover(X.listing(spark, str(tmp_path), extensions=[".md"]), known).collect()}
    assert got == {"a.md": "UPSERT", "b.md": "DELETE", "n.md": "UPSERT"}
    assert {r["content_hash"] for r in X.bodies(spark, str(tmp_path), 2).collect()} == {"9dd4e461268c8034f5c8564e155c67a6"}


@pytest.mark.parametrize("row, want", [
    ((410, None, None, True), ("DELETE", None)), ((500, '"e"', None, True), ("UPSERT", None)), ((200, 'W/"e"', "d", True), ("UPSERT", "e")),
    ((200, None, "d", True), ("UPSERT", "d")), ((200, None, None, True), ("UNCHANGED", None)), ((200, None, None, False), ("UPSERT", None)),
])
def test_http(spark, row, want):
    df = spark.createDataFrame([row], "status int, etag string, modified string, known boolean")
    assert tuple(df.select(X.http_action(*[F.col(c) for c in df.columns]).alias("x")).first()["x"]) == want


def test_names(spark):
    ext = lambda kind, url: one(spark, X.extension(F.col("kind"), F.col("url")), kind=kind, url=url)
    assert [ext("application/pdf; q=1", "http://x/a"), ext("", "http://x/a/b.DOCX?v=1"), ext(None, "http://x.org"), ext("", "http://x.org/a/b")] == [".pdf", ".docx", ".html", ".html"]
    path = lambda uri: one(spark, X.local_path(F.col("uri")), uri=uri)
    assert [path("file:///a/b%20c+d"), path("/x/y"), path("http://h/p"), path("file://localhost/q")] == ["/a/b c+d", "/x/y", None, "/q"]
    assert one(spark, X.fenced(F.col("t"), F.col("s")), t="x = 1", s=".PY") == "```python\nx = 1\n```" and one(spark, X.fenced(F.col("t"), F.col("s")), t="x", s=".md") == "x"


def test_items(spark):
    md = "# Title\n\npara one\nstill one\n\n- item\n2. second\n```py\n# no heading\n\nx\n```\ntail"
    rows = X.markdown_items(spark.createDataFrame([(1, md), (2, None), (3, "")], "doc_id long, text string")).orderBy("position").collect()
    assert [(r["label"], r["level"], r["text"]) for r in rows] == [
        ("section_header", 1, "Title"), ("text", None, "para one\nstill one"), ("list_item", None, "item"), ("list_item", None, "second"), ("code", None, "# no heading\n\nx"), ("text", None, "tail")
    ]
    html = "<title>T &amp; x</title><nav><p>menu</p></nav><script>p('<p>no</p>')</script><h2 class=a>Head</h2><p>one <b>two</b><p>three</p><ul><li>i1<li>i2</ul><td>c</td><!-- <p>no</p> -->"
    got = X.html_items(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("position").collect()
    assert [(r["label"], r["level"], r["text"]) for r in got] == [
        ("title", None, "T & x"), ("section_header", 2, "Head"), ("text", None, "one two"), ("text", None, "three"), ("list_item", None, "i1"), ("list_item", None, "i2"), ("table", None, "c")
    ]


class Two:
    def prefixes(self):
        return ["a", "b"]

    def entries(self, prefix):
        return [(f"mem://{prefix}/{i}", str(i)) for i in range(2)]


def test_adapters(spark):
    rows = A.listed(spark, "two_prefixes", Two())
    assert rows.rdd.getNumPartitions() == 2 and sorted(r["uri"] for r in rows.collect()) == ["mem://a/0", "mem://a/1", "mem://b/0", "mem://b/1"]
    known = A.Adapters()
    known.register("mem", lambda uri: Two())
    assert isinstance(known.adhoc("mem://a"), Two)
    for f, x in ((known.configured, "mem"), (known.adhoc, "ftp://x")):
        with pytest.raises(LookupError):
            f(x)
    xml = """<d:multistatus xmlns:d="DAV:"><d:response><d:href>/f/</d:href><d:propstat><d:prop><d:resourcetype><d:collection/></d:resourcetype></d:prop></d:propstat></d:response>
    <d:response><d:href>/f/a%20b.md</d:href><d:propstat><d:prop><d:resourcetype/><d:getetag>W/"x1"</d:getetag></d:prop></d:propstat></d:response></d:multistatus>"""
    assert A.multistatus(xml, "https://h/f") == [("https://h/f/a b.md", "x1")]
    with pytest.raises(ValueError):
        A.multistatus(xml, "https://h/other/")


def test_qrels(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\nq1\td1\t2\nq2\td3\t0\n")
    assert sorted(tuple(r) for r in X.qrels(spark, str(tmp_path / "q.tsv")).collect()) == [("q1", "d1"), ("q2", "d3")]
