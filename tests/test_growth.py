"""Plans whose work must not grow as the square of the tables."""

from __future__ import annotations

import __spark_entry__  # noqa: F401  it registers all queries
from lodestone.plans import registry

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_labels_are_ranked_before_they_meet_queries(spark):
    plan = plan_of(registry.QUERIES["hybrid_rrf_topk"](spark, SF))
    assert "Window" in plan.split("Join Inner")[1]


def test_index_search_meets_lists_in_blocks(spark):
    plan = plan_of(registry.QUERIES["vector_index_topk"](spark, SF))
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan.split("FlatMapCoGroupsInArrow")[0]


def test_search_function_cuts_the_asked_text_once(spark):
    assert "array_contains" not in plan_of(registry.QUERIES["search_function"](spark, SF))
