"""Items, sections, ranges and other structure within documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def section_spans(items: DataFrame) -> DataFrame:
    """Sections opened by headers, with their bounds and the characters that are no noise."""
    run = Window.partitionBy("doc_id").orderBy("position")
    cut = items.withColumn("section", F.sum(F.when(F.col("label") == "section_header", 1).otherwise(0)).over(run))
    return cut.groupBy("doc_id", "section").agg(
        F.min("position").alias("first_pos"), F.max("position").alias("last_pos"), F.sum(F.when(F.col("label") != "page_footer", F.length("text")).otherwise(0)).alias("chars")
    )


def merge_ranges(ranges: DataFrame, key: str) -> DataFrame:
    """Islands of overlapping ranges ``lo, hi``; ranges that only touch stay apart when lo > the end before."""
    order = Window.partitionBy(key).orderBy("lo", "hi", "id")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = ranges.withColumn("opens", F.when(before.isNull() | (F.col("lo") > before), 1).otherwise(0))
    island = flagged.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n")).drop("island")


def previous_item(items: DataFrame, label: str, before: str) -> DataFrame:
    """Items of ``label`` that follow directly on an item of ``before``."""
    run = Window.partitionBy("doc_id").orderBy("position")
    both = items.withColumns({"prev_label": F.lag("label").over(run), "prev_pos": F.lag("position").over(run)})
    return both.where((F.col("label") == label) & (F.col("prev_label") == before)).select("doc_id", "position", "prev_pos")


def toc(items: DataFrame) -> DataFrame:
    """Header items with their level, end and number of items up to the next header that is not deeper.

    A header's level is 1 for at most 20 characters, else 2.
    """
    level = F.when(F.length("text") <= 20, 1).otherwise(2)
    heads = items.where("label = 'section_header'").select("doc_id", "position", level.alias("level"))
    later = Window.partitionBy("doc_id").orderBy("position").rowsBetween(1, Window.unboundedFollowing)
    ends = heads.withColumn("next_any", F.min("position").over(later)).withColumn("next_top", F.min(F.when(F.col("level") == 1, F.col("position"))).over(later))
    last = items.groupBy("doc_id").agg((F.max("position") + 1).alias("after"))
    stop = F.when(F.col("level") == 1, F.col("next_top")).otherwise(F.col("next_any"))
    return ends.join(last, "doc_id").select("doc_id", "position", "level", F.coalesce(stop, "after").alias("end_pos"))


def outline(items: DataFrame, deepest: int = 9) -> DataFrame:
    """``doc_id, position, level, text, parent_pos, end_pos`` of headers that have a level.

    A section ends at the next header that is not deeper, or after the last item; its parent is the nearest earlier header
    that is less deep. Levels beyond ``deepest`` nest like that one.
    """
    heads = items.where("label = 'section_header' and level > 0").select("doc_id", "position", "level", "text").withColumn("_l", F.least("level", F.lit(deepest)))
    order = Window.partitionBy("doc_id").orderBy("position")
    after, before = order.rowsBetween(1, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    ends, parents = F.when(F.lit(False), 0), F.when(F.lit(False), 0)
    for n in range(1, deepest + 1):
        ends = ends.when(F.col("_l") == n, F.min(F.when(F.col("_l") <= n, F.col("position"))).over(after))
        parents = parents.when(F.col("_l") == n, F.max(F.when(F.col("_l") < n, F.col("position"))).over(before))
    last = items.groupBy("doc_id").agg((F.max("position") + 1).alias("_after"))
    return heads.select("doc_id", "position", "level", "text", parents.alias("parent_pos"), ends.alias("_end")).join(last, "doc_id").withColumn("end_pos", F.coalesce("_end", "_after")).drop("_end", "_after")


def backfill_levels(items: DataFrame, again: DataFrame) -> DataFrame:
    """``items`` with the ``level`` that an extraction made ``again`` gives for the same reference.

    Documents of which the two have different numbers of items keep their levels.
    """
    count = [d.groupBy("doc_id").agg(F.count("*").alias(n)) for d, n in ((items, "_a"), (again, "_b"))]
    same = count[0].join(count[1], "doc_id").where("_a = _b").select("doc_id")
    new = again.join(same, "doc_id", "left_semi").groupBy("doc_id", "self_ref").agg(F.max("level").alias("_level"), F.lit(True).alias("_new"))
    old = items if "level" in items.columns else items.withColumn("level", F.lit(None).cast("int"))
    return old.join(new, ["doc_id", "self_ref"], "left").withColumn("level", F.when(F.col("_new"), F.col("_level")).otherwise(F.col("level"))).drop("_level", "_new")


def structural_title(items: DataFrame) -> DataFrame:
    """``doc_id, title`` of ``doc_id, position, label, text, layer``: the last title of the furniture, else the first of the body,
    else the first header; blank texts aside. Documents without any are left out.
    """
    i = items.where("label in ('title', 'section_header')").withColumn("_t", F.trim("text")).where("_t <> ''")
    title, furniture = F.col("label") == "title", F.coalesce(F.col("layer") == "furniture", F.lit(False))
    pick = lambda agg, when: agg(F.when(when, F.col("_t")), F.when(when, F.col("position")))
    best = F.coalesce(pick(F.max_by, title & furniture), pick(F.min_by, title & ~furniture), pick(F.min_by, ~title))
    return i.groupBy("doc_id").agg(best.alias("title"))
