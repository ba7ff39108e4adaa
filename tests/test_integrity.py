from __future__ import annotations


from pyspark.sql import functions as F

from lodestone.operators import integrity as I


def test_report_names_what_is_wrong(spark):
    docs = spark.createDataFrame([(i,) for i in (1, 2, 3)], "doc_id long")
    meta = spark.createDataFrame([(i,) for i in (1, 2, 9)], "doc_id long")
    chunks = spark.createDataFrame([("c1", 1, ["r1"], [0.0, 1.0]), ("c2", 1, ["zz"], [0.0, 0.0]), ("c3", 7, ["r1"], [1.0])], "id string, document_id long, refs array<string>, vector array<double>")
    items = spark.createDataFrame([(1, "r1", "text", None), (5, "r1", "picture", None)], "doc_id long, self_ref string, label string, picture_data binary")
    got = {r["name"]: (r["severity"], r["n"], r["details"]) for r in I.report(docs, meta, chunks, items, 2).collect()}
    assert got == {
        "documents without metadata": ("fail", 1, "3"), "metadata without documents": ("fail", 1, "9"), "chunks without documents": ("warn", 1, "7"), "items without documents": ("warn", 1, "5"),
        "chunked documents without items": ("ok", 0, ""), "chunks with dangling references": ("warn", 2, "c2, c3"), "vectors of another size": ("fail", 1, "c3"),
        "chunks without an embedding": ("warn", 1, "c2"), "pictures without bytes": ("warn", 1, "r1"),
    }
    assert I.sample(spark.range(8), "n", "id").first()["details"] == "0, 1, 2, 3, 4 ... (+3 more)"
    kinds = {r["doc_id"]: r["kind"] for r in I.unchunked(spark.createDataFrame([(i,) for i in (1, 5, 6)], "doc_id long"), chunks.where("id = 'c3'"), items, ["text"], True).collect()}
    assert kinds == {1: "text", 5: "picture", 6: "expected"}


def test_components_and_families(spark):
    chain = [(i, i + 1, 0.9) for i in range(0, 40)] + [(100, 102, 0.95), (101, 102, 0.91234)]
    pairs = spark.createDataFrame(chain, "a long, b long, similarity double")
    got = {r["id"]: r["component"] for r in I.components(pairs).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    fam = {r["id"]: (r["keep"], r["similarity"]) for r in I.families(pairs.where("a >= 100"), spark.createDataFrame([(101, 5), (102, 5)], "id long, n long")).collect()}
    assert fam == {100: (False, 0.95), 101: (True, 0.912), 102: (False, 0.95)}  # each member's own best
    assert I.components(pairs.where("false")).count() == 0


def test_common_prefix(spark):
    df = spark.createDataFrame([(["file:///data/docs/a/x.md", "file:///data/docs/a2/y.md"],), (["/a/b", "/a/c"],)], "p array<string>")
    assert [r[0] for r in df.select(I.common_prefix(F.col("p"))).collect()] == ["file:///data/docs/", ""]


def test_store_checks(spark):
    said = "id string, provider string, name string, vector_dim int, version string"
    config = {"provider": "p", "name": "m", "vector_dim": 8}
    steps = spark.createDataFrame([("0.9.0", "a"), ("0.10.0", None), ("0.11.1", "c")], "version string, description string")
    chunks = spark.range(3)

    def lines(rows, indexed=None):
        return {r["name"]: tuple(r)[1:] for r in I.store_checks(spark.createDataFrame(rows, said), config, steps, chunks, indexed).collect()}

    got = lines([("settings", None, "m", 8, "0.9.0"), ("old", "x", "y", 1, "0")], spark.range(2))
    assert got == {"settings row": ("ok", 1, ""), "embedding drift": ("ok", 0, ""), "pending migrations": ("warn", 2, "0.10.0: , 0.11.1: c"), "vector index": ("warn", 1, "")}
    assert lines([("settings", "q", "n", 8, "0.11.1")])["embedding drift"] == ("warn", 2, "provider: q -> p, name: n -> m")
    got = lines([("settings", "q", "n", 9, "1.0.0")], spark.range(5))
    assert got["embedding drift"] == ("fail", 1, "vector_dim: 9 -> 8") and got["pending migrations"][0] == got["vector index"][0] == "ok"
    got = lines([])
    assert got["settings row"] == ("fail", 0, "") and got["embedding drift"] == ("ok", 0, "") and got["pending migrations"] == ("ok", 0, "") and got["vector index"] == ("ok", 3, "no index")
