from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.client import Corpus
from lodestone.functions import embedding as E

DOCS = "uri string, title string, content string, parent_uri string"


def test_import_search_expand_delete_and_rebuild(spark, tmp_path):
    c = Corpus(spark, str(tmp_path / "db"), words=8)
    one = "# Whales\n\nWhales sing long songs under the sea.\n\nTheir calves drink milk.\n\n# Maps\n\nOld maps show dragons at the edge."
    docs = spark.createDataFrame([("a", "Sea", one, None), ("b", "Land", "Goats climb steep rocks.", "a"), ("c", "Sky", "Swifts sleep in the air.", None), ("d", "Nil", None, None)], DOCS)
    c.add(docs)
    assert c.count() == 4 and c.count("title = 'Sky'") == 1
    for kind in ("vector", "fts", "hybrid"):
        assert c.search("songs whales sing", 3, kind).first()["uri"] == "a"
    assert {r["uri"] for r in c.search("whales goats swifts", 3, "vector", "title like 'S%'").collect()} <= {"a", "c"}
    assert c.search("  ", 3).count() == 0
    top = c.expand(c.search("dragons", 1, "fts"), 500).first()
    assert "dragons" in top["content"] and len(top["content"]) > len("Old maps show dragons at the edge.")
    again = spark.createDataFrame([("c", "Sky", "Swifts sleep in the air.", None), ("a", "Sea", "Only kelp now.", None)], DOCS)
    assert [r["uri"] for r in c.changed(again).collect()] == ["a"]
    c.add(c.changed(again))
    assert c.count() == 4 and c.search("kelp", 1, "fts").first()["uri"] == "a" and c.search("dragons", 1, "fts").count() == 0
    assert c.add(spark.createDataFrame([("e", "New", "Fresh words.", None)], DOCS)) == 3
    c.rechunk(1000)
    assert c.store.read("chunks").count() == 4
    c.reembed(E.batched(lambda texts: [[float(len(t)), 1.0] for t in texts]))
    assert {len(r["vector"]) for r in c.store.read("chunks").collect()} == {2}
    c.delete("a")
    assert {r["uri"] for r in c.documents().collect()} == {"c", "d", "e"} and c.store.read("documents").count() == 3


def test_hashing_embedder(spark):
    df = spark.createDataFrame([("one two two",), (None,), ("",)], "t string").select(E.hashing(8)(F.col("t")).alias("v"))
    norms = [round(sum(x * x for x in r["v"]), 4) for r in df.collect()]
    assert norms == [1.0, 0.0, 0.0]


def test_metadata_titles_and_refresh(spark, tmp_path):
    c = Corpus(spark, str(tmp_path / "db"))
    rows = [("a", None, "# Whales\n\nSong.", {"k": "1", "j": "2"}), ("b", None, "no header", None), ("a", None, "# Whales\n\nSong.", {"k": "0"})]
    c.add(spark.createDataFrame(rows, "uri string, title string, content string, metadata map<string,string>"))
    first = {r["uri"]: r for r in c.store.read("document_meta").collect()}
    assert (first["a"].title, first["b"].title, first["b"].metadata) == ("Whales", None, {}) and first["a"].created_at == first["a"].updated_at
    assert c.documents("metadata['k'] is not null").count() == 1
    said = "uri string, title string, metadata map<string,string>"
    was = c.store.version()
    assert c.refresh(spark.createDataFrame([("a", "Whales", {}), ("b", None, None), ("zz", "new", {"x": "y"})], said)) == was
    assert c.refresh(spark.createDataFrame([("a", None, {"k": "9"}), ("b", "Bee", None)], said)) == was + 1
    now = {r["uri"]: r for r in c.store.read("document_meta").collect()}
    assert now["a"].metadata["k"] == "9" and now["a"].title == "Whales" and now["b"].title == "Bee" and set(now) == {"a", "b"}
    assert now["a"].created_at == first["a"].created_at and now["a"].updated_at > first["a"].updated_at
    c.add(spark.createDataFrame([("b", None, "# Bees\n\nHum.", {"n": "1"})], "uri string, title string, content string, metadata map<string,string>"))
    again = {r["uri"]: r for r in c.store.read("document_meta").collect()}["b"]
    assert (again.title, again.metadata, again.created_at) == ("Bees", {"n": "1"}, first["b"].created_at)
    assert {r["heading"] for r in c.store.read("chunks").collect()} == {"Whales", "Bees"}
