"""The pruned self-join of vectors against all pairs."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from lodestone.operators import integrity as I
from lodestone.operators import similarity as SJ

SCHEMA = "vec_id long, embedding array<double>, cell int, n long"


def frame(spark, vs):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2) for i, v in vs], SCHEMA)


def want(vs, least):
    good = [(i, np.array(v, float)) for i, v in vs if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for (i, x), (j, y) in itertools.combinations(sorted(good, key=lambda t: t[0]), 2):
        s = round(float(x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y))), 6) if len(x) == len(y) else -2
        if s >= least:
            out[i, j] = s
    return out


def clustered(n, centres, seed=1, width=0.05, dims=8):
    rnd = np.random.default_rng(seed)
    c = rnd.normal(size=(centres, dims))
    return [(i, (c[i % centres] + width * rnd.normal(size=dims)).tolist()) for i in range(n)]


def edge_vectors():
    vs = clustered(150, 9) + [(200 + i, v) for i, (_, v) in enumerate(clustered(60, 9, seed=4, width=1.0))]
    vs += [(300 + i, [1.0, 2, 3, 4, 5, 6, 7, 8]) for i in range(25)] + [(330, [2.0, 4, 6, 8, 10, 12, 14, 16])]  # copies, and the same direction
    return vs + [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [float("inf")] + [1.0] * 7), (404, [None] + [1.0] * 7), (405, []), (406, [1.0, 2.0]), (407, [1.0, 2.1])]


@pytest.mark.parametrize(("least", "pivots", "block"), [(0.95, None, 2000), (0.95, 40, 7), (0.3, 12, 50), (-0.2, 5, 2000), (0.999999, 40, 2000), (1.0, 3, 10)])
def test_pairs_are_those_of_all_comparisons(spark, monkeypatch, least, pivots, block):
    monkeypatch.setattr(SJ, "BLOCK", block)
    vs = edge_vectors()
    expect = want(vs, least)
    rows = SJ.near_pairs(frame(spark, vs), least, pivots).collect()
    got = {(r["a"], r["b"]): r["similarity"] for r in rows}
    assert len(rows) == len(got) and got.keys() == expect.keys()
    assert all(abs(s - expect[k]) < 2e-6 for k, s in got.items())


def test_edges_link_what_pairs_link(spark):
    vs = edge_vectors()
    df = frame(spark, vs)
    edges = SJ.near_edges(df, 0.95)
    assert edges.count() < SJ.near_pairs(df, 0.95).count()
    labels = {r["id"]: r["component"] for r in I.components(edges).collect()}
    assert labels == {r["id"]: r["component"] for r in I.components(SJ.near_pairs(df, 0.95)).collect()}


def test_few_pairs_are_compared_where_vectors_cluster(spark):
    seen = []
    for n in (1000, 2000, 4000):
        reps = SJ.classes(frame(spark, clustered(n, n // 20, seed=n)))
        seen.append(SJ.compared(SJ.cells(reps, 0.95, pivots=2 * int(n**0.5))) / (n * (n - 1) / 2))
    assert max(seen) < 0.1


def test_no_vectors(spark):
    assert SJ.near_pairs(frame(spark, [(1, None)]), 0.5).count() == 0 and SJ.near_edges(frame(spark, []), 0.5).count() == 0
