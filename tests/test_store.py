from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.sources import store as S


@pytest.fixture()
def store(spark, tmp_path):
    s = S.Store(spark, str(tmp_path / "db"))
    meta = spark.createDataFrame([("1", "a", None, "Alpha One"), ("2", "b", "a", "Beta"), ("3", "c", "b", "Gamma"), ("4", "d", None, "Delta")], "id string, uri string, parent_uri string, title string")
    chunks = spark.createDataFrame([(f"c{i}", str(1 + i % 4), i) for i in range(8)], "id string, document_id string, n int")
    s.commit({"document_meta": meta, "chunks": chunks}, note="first")
    return s


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_versions_appends_and_conflicts(store, spark):
    more = spark.createDataFrame([("c9", "1", 9)], "id string, document_id string, n int")
    base = store.version()
    assert store.commit(append={"chunks": more}) == 2 and store.read("chunks").count() == 9 and store.read("chunks", 1).count() == 8
    with pytest.raises(S.Conflict):
        store.commit(append={"chunks": more}, base=base)
    assert store.version() == 2 and {r["table_name"]: r["n_rows"] for r in store.info().collect()} == {"chunks": 9, "document_meta": 4}


def test_changes_of_one_table(store, spark):
    new = spark.createDataFrame([("c0", "1", 100), ("zz", "1", 5)], "id string, document_id string, n int")
    store.update("chunks", new, ["id"])
    assert {r["id"]: r["n"] for r in store.read("chunks").collect()}["c0"] == 100 and store.read("chunks").count() == 8
    store.upsert("chunks", new, ["id"])
    assert "zz" in ids(store.read("chunks"))
    store.replace_scope("chunks", F.col("document_id") == "1", new.where("id = 'zz'"))
    assert ids(store.read("chunks").where("document_id = '1'")) == ["zz"]
    store.delete("chunks", F.col("n") > 4)
    assert store.read("chunks").agg(F.max("n")).first()[0] <= 4


def test_cascade_delete_and_cycles(store, spark):
    store.cascade_delete("a", {"chunks": "document_id"})
    assert ids(store.read("document_meta")) == ["4"] and {r["document_id"] for r in store.read("chunks").collect()} == {"4"}
    loop = spark.createDataFrame([("1", "a", "b"), ("2", "b", "a"), ("3", "q", None)], "id string, uri string, parent_uri string")
    assert ids(S.descendants(loop, "a")) == ["1", "2"] and ids(S.descendants(loop, "it's")) == []


def test_tags_restore_history_and_vacuum(store):
    store.tag("v1")
    store.delete("chunks", F.lit(True))
    assert store.read("chunks").count() == 0
    with pytest.raises(S.Conflict):
        store.tag("v1")
    store.restore("v1")
    assert store.read("chunks").count() == 8 and any(t.startswith("before-restore-") for t in store.tags())
    h = store.history(2).where("table_name = 'chunks'").collect()
    assert [r["version"] for r in h] == [3, 2]
    for t in list(store.tags()):
        store.untag(t)
    assert len(store.vacuum(0)) == 1 and store.read("chunks").count() == 8 and store.vacuum(0) == []


def test_empty_and_broken_manifests(spark, tmp_path):
    s = S.Store(spark, str(tmp_path / "db"))
    assert s.version() == 0 and s.info().count() == 0 and s.history().count() == 0
    s.commit({"t": spark.range(3)})
    (tmp_path / "db" / "_manifest" / "000000000002.json").write_text('{"half')
    assert s.version() == 1 and s.commit(append={"t": spark.range(2)}) == 3 and s.read("t").count() == 5


def test_lookups(store):
    meta = store.read("document_meta")
    assert ids(S.resolve_document(meta, "Beta")) == ["2"] and ids(S.resolve_document(meta, "zz")) == [] and ids(S.find_document(meta, "alphaone")) == ["1"]
    assert ids(S.list_documents(meta, "title like '%a'", 2, 1)) == ["3", "4"]
    with pytest.raises(ValueError):
        S.list_documents(meta, "parent_uri = 'a'")


def test_two_writers_lose_no_update(store, spark, monkeypatch):
    more = spark.createDataFrame([("c9", "1", 9)], "id string, document_id string, n int")
    create, raced = S.Store._create, []

    def late(self, name, value):
        if not raced:  # another writer commits between our check and our manifest
            raced.append(0)
            raced[0] = S.Store(spark, store.root).commit(append={"chunks": more})
        return create(self, name, value)

    monkeypatch.setattr(S.Store, "_create", late)
    with pytest.raises(S.Conflict):
        store.commit(append={"chunks": more})
    assert raced == [2] and store.version() == 2 and store.read("chunks").count() == 9
    assert not [n for n in store._names("_manifest") if not n.endswith(".json")]


def test_stream_batches_once_after_a_vacuum(store, spark):
    from lodestone.streaming.sync import store_sink

    put, batch = store_sink(store, "stream"), spark.range(3)
    put(batch, 0)
    put(batch, 1)
    store.commit(append={"stream": spark.range(1)}, note="other")
    store.vacuum(0)
    put(batch, 1)
    assert store.read("stream").count() == 7
