from __future__ import annotations

import math

import pytest

import __spark_entry__ as entry
from lodestone.plans import registry
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SF), registry.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_number_match_reads_every_document(spark, tmp_path):
    readings = {"5 million of 20%": [5.0, 20.0, 0.2, 5e6], "(3) and 2.5 Billion": [-3.0, 2.5, 2.5e9], "7": [7.0], "none": [], None: []}
    rows = [(i, t, "en", "a", len(t or "")) for i, t in enumerate(readings)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = [(i, len(n), sum(x < 0 for x in n), round(sum(math.log10(1 + abs(x)) for x in n), 6)) for i, n in enumerate(readings.values())]
    got = registry.QUERIES["number_readings"](spark, str(tmp_path)).where("part = 'text'").drop("part").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
