from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import context as C
from lodestone.plans import corpus_queries

ITEMS = "doc_id long, position int, self_ref string, label string, text string, pages array<int>"
RESULTS = "doc_id long, result_id long, seq long, score double, content string, refs array<string>, pages array<int>, labels array<string>"


def items_of(spark, rows, doc=1):
    return spark.createDataFrame([(doc, p, f"#/texts/{p}", label, text, [1 + p // 5]) for p, (label, text) in enumerate(rows)], ITEMS)


def results_of(spark, *rows):
    return spark.createDataFrame([(doc, i, i, s, c, [f"#/texts/{p}" for p in at], [1], ["text"]) for i, (doc, s, c, at) in enumerate(rows)], RESULTS)


def ranges(spark, rows, at, budget):
    items, results = items_of(spark, rows), results_of(spark, *[(1, 0.5, "x", a) for a in at])
    matched = C.resolve(results, items)
    got = C.expansion_ranges(matched, C.fetched(items, matched), budget).orderBy("result_id").collect()
    return [(r["lo"], r["hi"]) for r in got]


def test_growth_without_sections_counts_every_item(spark):
    rows = [("text", "x" * 200), ("document_index", "x" * 10000), ("text", "x" * 200)]
    assert ranges(spark, rows, [[0]], 500) == [(0, 1)]


def test_growth_skips_noise_in_structured_documents(spark):
    rows = [("section_header", "h"), ("text", "x" * 100), ("footnote", "x" * 10000), ("text", "x" * 100)]
    assert ranges(spark, rows, [[1]], 500) == [(0, 3)]


def test_section_that_fits_is_returned_whole(spark):
    rows = ([("section_header", "One")] + [("text", "x" * 600)] * 3) + ([("section_header", "Two")] + [("text", "x" * 600)] * 2)
    assert ranges(spark, rows, [[1], [5]], 5000) == [(0, 3), (4, 6)]


def test_large_section_bounds_growth_and_small_one_crosses(spark):
    rows = [("section_header", "h")] + [("text", "x" * 400)] * 4 + [("section_header", "n")] + [("text", "x" * 400)] * 3
    assert ranges(spark, rows, [[3]], 900) == [(2, 4)]
    small = [("title", "t"), ("text", "authors"), ("section_header", "s"), ("text", "x" * 300), ("text", "y" * 300)]
    assert ranges(spark, small, [[0]], 500) == [(0, 4)]


def test_picture_stays_in_its_section(spark):
    rows = [("section_header", "a"), ("text", "x" * 50), ("section_header", "b"), ("picture", ""), ("text", "z"), ("section_header", "c"), ("text", "x" * 50)]
    assert ranges(spark, rows, [[3]], 5000) == [(2, 4)]


def grown(costs, centre, budget):
    lo = hi = centre
    spent = costs[centre]
    while spent < budget and (lo > 0 or hi < len(costs) - 1):
        if lo > 0:
            lo -= 1
            spent += costs[lo]
        if hi < len(costs) - 1 and spent < budget:
            hi += 1
            spent += costs[hi]
    return lo, hi


def test_growth_equals_turn_by_turn_walk(spark):
    costs = [(7 * i * i + 3) % 41 for i in range(30)]
    rows = [("text", "x" * c) for c in costs]
    at = list(range(0, 30, 3))
    for budget in (1, 60, 200, 5000):
        assert ranges(spark, rows, [[a] for a in at], budget) == [grown(costs, a, budget) for a in at]


def test_overlapping_results_merge_and_keep_the_best(spark):
    rows = [("section_header", "Head")] + [("text", f"body {i} " + "x" * 90) for i in range(4)]
    results = results_of(spark, (1, 0.4, "body 0", [1]), (1, 0.9, "body 2", [3]), (2, 0.7, "alone", [9]))
    got = C.expand(results, items_of(spark, rows), 1000).collect()
    assert [r["result_ids"] for r in got] == [[0, 1], [2]] and got[0]["result_id"] == 1 and got[0]["score"] == 0.9
    assert got[0]["content"] == "\n\n".join(t for _, t in rows) and got[0]["refs"] == [f"#/texts/{p}" for p in range(5)]
    assert got[1]["content"] == "alone" and got[1]["refs"] == ["#/texts/9"]


def test_group_splits_when_the_clip_evicts_a_member(spark):
    rows = [("section_header", "Head")] + [("text", f"start {i} " + chr(97 + i) * 300) for i in range(12)]
    texts = [t for _, t in rows]
    results = results_of(spark, (1, 0.9, texts[2], [2]), (1, 0.5, texts[6], [6]))
    got = C.expand(results, items_of(spark, rows), 1500).collect()
    assert [r["result_ids"] for r in got] == [[0], [1]]
    for r, at in zip(got, (2, 6)):
        assert len(r["content"]) <= 1500 and texts[at] in r["content"] and f"#/texts/{at}" in r["refs"]


def test_short_items_fall_back_to_the_chunk(spark):
    got = C.expand(results_of(spark, (1, 0.5, "a longer chunk than its items", [1])), items_of(spark, [("text", "a"), ("text", None)]), 500).collect()
    assert got[0]["content"] == "a longer chunk than its items" and got[0]["refs"] == ["#/texts/1"]


def test_no_results_gives_no_rows(spark):
    assert C.expand(spark.createDataFrame([], RESULTS), items_of(spark, [("text", "a")]), 500).count() == 0


def test_ranges_meet_items_by_bin(spark):
    items = [(1, p, f"t{p}") for p in range(0, 20_000)] + [(2, 5, "x"), (2, -3, "y"), (None, 1, "z")]
    ranges = [(1, k * 9, k * 9 + k % 40, k) for k in range(2_000)] + [(1, 3, 19_000, -1), (2, -10, 4, -2), (2, 5, 5, -3), (2, 9, 8, -4), (3, 0, 9, -5), (None, 0, 9, -6)]
    i = spark.createDataFrame(items, "doc_id long, position long, text string")
    r = spark.createDataFrame(ranges, "doc_id long, lo long, hi long, name int")
    want = sorted((d, p, name) for d, lo, hi, name in ranges if d is not None for e, p, _ in items if e == d and lo <= p <= hi)
    for width in (7, 512):
        joined = C.in_ranges(i, r, width)
        assert sorted(map(tuple, joined.select("doc_id", "position", "name").collect())) == want
    spread = C.in_ranges(i.repartition(8), r.hint("shuffle_hash"))
    assert "_bin" in spread._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(")[1][:60]
    sizes = C.in_ranges(i, r).groupBy("doc_id", (F.col("position") / C.BIN).cast("int").alias("b")).count()
    assert sizes.count() > 30  # the large document is many groups


def test_only_documents_found_are_cut_into_items(spark):
    found = spark.createDataFrame([(3,), (3,), (5,)], "doc_id long")
    items = corpus_queries.items_of(spark, "/root/testdata/sf0.001", found)
    whole = corpus_queries.items_of(spark, "/root/testdata/sf0.001").where("doc_id in (3, 5)")
    assert sorted(map(repr, items.collect())) == sorted(map(repr, whole.collect())) != []
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join LeftSemi")  # the join is below
