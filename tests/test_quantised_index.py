"""The quantised index: recall against an exact search, metrics and edge cases."""

from __future__ import annotations

import numpy as np
import pytest

from lodestone.operators import quantised_index as QI
from lodestone.operators import retrieval as R

SCHEMA = "vec_id long, embedding array<float>"


def clustered(spark, n=1500, dims=16, seed=2):
    rnd = np.random.default_rng(seed)
    c = rnd.normal(size=(40, dims))
    return spark.createDataFrame([(i, (c[i % 40] + 0.3 * rnd.normal(size=dims)).astype(float).tolist()) for i in range(n)], SCHEMA)


def exact(v, metric, k):
    rows = [(r["vec_id"], np.array(r["embedding"], np.float64)) for r in v.collect() if r["embedding"] is not None]
    x = np.stack([e for _, e in rows])
    out = {}
    for i, q in rows:
        if i % 50 == 0:
            s = x @ q if metric == "dot" else x @ q / np.sqrt((x * x).sum(1) * (q @ q)) if metric == "cosine" else -((x - q) ** 2).sum(1)
            out[i] = {rows[j][0] for j in np.argsort(-s, kind="stable")[:k]}
    return out


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_recall_and_bytes(spark, tmp_path, monkeypatch, metric):
    monkeypatch.setattr(QI, "LIST_BLOCK", 20)  # lists in several blocks
    monkeypatch.setattr(QI, "QUERY_BLOCK", 7)
    v = clustered(spark)
    index = QI.build(v, str(tmp_path / "i"), metric)
    assert len(index.centres) == 38 and index.books.shape == (4, 256, 4) and index.vectors.count() == 1500
    q = v.where("vec_id % 50 = 0")
    got = {}
    for r in QI.search(index, q, 10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = exact(v, metric, 10)
    assert sum(len(got[i] & w) for i, w in want.items()) >= 0.95 * sum(map(len, want.values()))
    told = QI.bytes_read(index, q, 10)
    assert told["codes"] + told["vectors"] < 0.2 * told["exact"]


def test_few_vectors_are_searched_exactly(spark, tmp_path):
    v = clustered(spark, 200).unionByName(spark.createDataFrame([(900, None), (901, [1.0]), (902, [float("nan")] * 16)], SCHEMA))
    index = QI.build(v, str(tmp_path / "i"))
    q = clustered(spark, 200).where("vec_id % 20 = 0")
    assert index.centres is None
    assert sorted(map(tuple, QI.search(index, q, 5).collect())) == sorted(map(tuple, R.vector_search(clustered(spark, 200), q, 5).collect()))
    assert QI.search(QI.build(v.limit(0), str(tmp_path / "e")), q, 5).count() == 0


def test_subspaces_must_divide(spark, tmp_path):
    with pytest.raises(ValueError):
        QI.build(clustered(spark, 300), str(tmp_path / "i"), subspaces=5)
    with pytest.raises(ValueError):
        QI.build(clustered(spark, 300), str(tmp_path / "j"), metric="l1")


def test_a_query_is_sent_to_a_block_of_lists_once(spark, monkeypatch, tmp_path):
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.normal(size=8).tolist()) for i in range(600)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id < 30")
    index = QI.build(v, str(tmp_path / "index"), lists=20)
    want = sorted(map(tuple, QI.search(index, q, 5, probes=12).collect()))
    block_of, _ = QI._blocks(index)
    told = QI._nearest_lists(index, q, 12, block_of).collect()
    assert len(told) == 30 and all(len(r["lists"]) == 12 for r in told) and set(block_of) == {0}
    monkeypatch.setattr(QI, "ROWS", 7)
    monkeypatch.setattr(QI, "LIST_BLOCK", 25)  # lists cut into parts, beside lists that share a block
    monkeypatch.setattr(QI, "QUERY_BLOCK", 10)
    assert sorted(map(tuple, QI.search(index, q, 5, probes=12).collect())) == want
    assert len(set(QI._blocks(index)[0])) > 5
