"""Context expansion: search results grow into their sections or surroundings, within a budget of characters.

Items are ``doc_id, position, self_ref, label, text, pages``; results are ``doc_id, result_id, seq, score, content,
refs, pages, labels``. Every step is a join by document or a window over the fetched items, so no document meets the
driver. Results whose refs resolve to no item pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Labels that carry no content, that open a section, and whose hits never leave their section.
NOISE = ("footnote", "page_header", "page_footer", "document_index")
BOUNDARY = ("section_header", "title")
TIGHT = ("picture", "table")
MARGIN = 100
MIN_SECTION_SHARE = 0.2
MIN_ANCHOR = 128
#: Positions in a bin of the interval join.
BIN = 512


def resolve(results: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, result_id, position``: the distinct positions that the refs of each result name."""
    refs = results.select("doc_id", "result_id", F.explode("refs").alias("self_ref"))
    return refs.join(items.select("doc_id", "self_ref", "position"), ["doc_id", "self_ref"]).select("doc_id", "result_id", "position").distinct()


def windows(matched: DataFrame, margin: int = MARGIN) -> DataFrame:
    """``doc_id, lo, hi``: the inclusive range to fetch around all matches of a document."""
    return matched.groupBy("doc_id").agg(F.greatest(F.lit(0), F.min("position") - margin).alias("lo"), (F.max("position") + margin).alias("hi"))


def in_ranges(items: DataFrame, ranges: DataFrame, width: int = BIN) -> DataFrame:
    """Items whose position lies in a range of their document, both ends included; an item in several ranges comes once for each.

    Items and ranges meet by document and bin of ``width`` positions, so a document of any number of items and ranges is
    many small groups. A range is a row for each bin it touches; an item is in one bin, so no pair is met twice.
    """
    bin_of = lambda c: F.floor(F.col(c) / width).cast("long")
    spread = ranges.withColumn("_bin", F.explode(F.sequence(bin_of("lo"), F.greatest(bin_of("hi"), bin_of("lo")))))
    met = items.withColumn("_bin", bin_of("position")).join(spread, ["doc_id", "_bin"])
    return met.where(F.col("position").between(F.col("lo"), F.col("hi"))).drop("_bin")


def fetched(items: DataFrame, matched: DataFrame) -> DataFrame:
    """Window items with their index, section, the section's bounds and its characters that are no noise."""
    opens = F.col("label").isin(*BOUNDARY).cast("int")
    run, sec = Window.partitionBy("doc_id").orderBy("position"), Window.partitionBy("doc_id", "section")
    near = in_ranges(items, windows(matched)).drop("lo", "hi").withColumns({"label": F.coalesce("label", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    near = near.withColumns({"idx": F.row_number().over(run), "section": F.sum(opens).over(run), "structured": F.max(opens).over(Window.partitionBy("doc_id")) == 1})
    near = near.withColumn("cost", F.when(F.col("structured") & F.col("label").isin(*NOISE), 0).otherwise(F.length("text")))
    return near.withColumns({"sec_chars": F.sum("cost").over(sec), "sec_lo": F.min("position").over(sec), "sec_hi": F.max("position").over(sec)})


def expansion_ranges(matched: DataFrame, near: DataFrame, max_chars: int) -> DataFrame:
    """``doc_id, result_id, lo, hi``: the section of the middle match if it fits, else growth around that match.

    Growth takes an item below, then one above, turn by turn, while the characters so far are under the budget; as
    costs are never negative, that is a running sum over items ordered by distance.
    """
    by = ["doc_id", "result_id"]
    hits = matched.join(near.select("doc_id", "position", "label"), ["doc_id", "position"]).groupBy(*by)
    hits = hits.agg(F.sort_array(F.collect_list("position")).alias("p"), F.max(F.col("label").isin(*TIGHT)).alias("tight"))
    centre = hits.select(*by, "tight", F.element_at("p", (F.floor(F.size("p") / 2) + 1).cast("int")).alias("position"))
    centre = centre.join(near.select("doc_id", "position", F.col("idx").alias("at"), "structured", "sec_chars", "sec_lo", "sec_hi"), ["doc_id", "position"])
    useful = (F.col("sec_chars") >= int(max_chars * MIN_SECTION_SHARE)) | F.col("tight")
    centre = centre.withColumn("fits", F.col("structured") & (F.col("sec_chars") <= max_chars) & useful)
    bounded = F.col("structured") & (F.col("sec_chars") > max_chars)
    around = near.select("doc_id", F.col("position").alias("pos"), F.col("idx").alias("i"), "cost")
    grow = centre.where(~F.col("fits")).join(around, "doc_id").where(~bounded | F.col("pos").between(F.col("sec_lo"), F.col("sec_hi")))
    order = Window.partitionBy(*by).orderBy(F.abs(F.col("i") - F.col("at")), "i").rowsBetween(Window.unboundedPreceding, -1)
    grown = grow.withColumn("spent", F.coalesce(F.sum("cost").over(order), F.lit(0))).where((F.col("i") == F.col("at")) | (F.col("spent") < max_chars))
    grown = grown.groupBy(*by).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    return centre.where("fits").select(*by, F.col("sec_lo").alias("lo"), F.col("sec_hi").alias("hi")).unionByName(grown)


def group_ranges(ranges: DataFrame) -> DataFrame:
    """Add ``grp``: ranges of a document that share a position are in one group; those that only touch are not."""
    order = Window.partitionBy("doc_id").orderBy("lo", "seq")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = ranges.withColumn("opens", F.coalesce(before < F.col("lo"), F.lit(True)).cast("int"))
    return flagged.withColumn("grp", F.sum("opens").over(order)).drop("opens")


def build(grouped: DataFrame, near: DataFrame, max_chars: int) -> DataFrame:
    """One expanded result for each ``doc_id, grp``, with its ``set``, clipped to the budget around the evidence of its best member.

    ``refs``, ``pages`` and ``labels`` are those of the items that survive the clip; ``lost`` says that some member
    has none of its refs among them.
    """
    by, m = ["doc_id", "grp"], max_chars
    member = F.struct("lo", "seq", "result_id", "score", F.coalesce("content", F.lit("")).alias("content"), "refs", "pages", "labels")
    groups = grouped.groupBy(*by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("set").alias("set"), F.sort_array(F.collect_list(member)).alias("members"))
    inside = near.join(groups.select(*by, "lo", "hi"), "doc_id").where(F.col("position").between(F.col("lo"), F.col("hi")))
    full = F.length("text") > 0
    inside = inside.where(~(F.col("structured") & F.col("label").isin(*NOISE)) & (full | (F.col("label") == "picture")))
    order = Window.partitionBy(*by).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(full, F.length("text") + 2)).over(order), F.lit(0))
    inside = inside.withColumn("a", F.when(full, before).otherwise(F.greatest(before - 2, F.lit(0)))).withColumn("z", F.col("a") + F.length("text"))
    spans = inside.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("position", "a", "z", "self_ref", "label", "text", F.col("pages").alias("pages")))).alias("spans"))
    g = groups.join(spans, by, "left").withColumn("spans", F.expr("coalesce(spans, cast(array() as " + spans.schema["spans"].dataType.simpleString() + "))"))
    g = g.withColumn("best", F.expr("members[-array_max(transform(members, (r, i) -> struct(r.score as s, -i as i))).i]"))
    g = g.withColumn("joined", F.expr("array_join(transform(filter(spans, s -> s.text <> ''), s -> s.text), '\\n\\n')"))
    g = g.withColumn("own", F.expr("length(joined) < length(best.content)")).withColumn("base", F.expr("if(own, best.content, joined)"))
    cut = f"least(greatest(least({m} div 2, length(c) div 2), least({MIN_ANCHOR}, {m}, length(c))), {m}, length(c))"
    middle = f"if({cut} < length(c), substring(c, cast(greatest(0, length(c) div 2 - ({cut}) div 2) + 1 as int), cast({cut} as int)), null)"
    tries = "filter(concat(array(best.content), transform(members, r -> r.content)), c -> c <> '')"
    g = g.withColumn("anchor", F.expr(f"get(filter(flatten(transform({tries}, c -> array(if(length(c) <= {m}, c, null), {middle}))), a -> a is not null and instr(base, a) > 0), 0)"))
    g = g.withColumn("mid", F.expr("instr(base, anchor) - 1 + length(anchor) div 2"))
    g = g.withColumn("win_z", F.expr(f"if(mid is null, least(length(base), {m}), least(length(base), greatest(0, mid - {m} div 2) + {m}))")).withColumn("win_a", F.expr(f"greatest(0, win_z - {m})"))
    g = g.withColumn("clipped", F.expr(f"length(base) > {m}"))
    g = g.withColumn("kept", F.expr("filter(spans, s -> not clipped or if(s.a = s.z, s.a between win_a and win_z, s.a < win_z and s.z > win_a))"))
    g = g.withColumn("live", F.expr("if(own, best.refs, transform(kept, s -> s.self_ref))"))
    g = g.withColumn("from_items", F.expr("if(own, best.pages, flatten(transform(kept, s -> coalesce(s.pages, cast(array() as array<int>)))))"))
    added = "flatten(transform(filter(members, r -> size(r.refs) > 0 and size(r.pages) > 0 and size(array_except(r.refs, live)) = 0), r -> r.pages))"
    return g.select(
        *by, "set", F.col("best.result_id").alias("result_id"), F.expr("array_distinct(transform(members, r -> r.result_id))").alias("result_ids"), F.expr("array_min(transform(members, r -> r.seq))").alias("seq"),
        F.expr("array_max(transform(members, r -> r.score))").alias("score"), F.expr("if(clipped, substring(base, cast(win_a + 1 as int), cast(win_z - win_a as int)), base)").alias("content"),
        F.expr("if(size(live) > 0, live, best.refs)").alias("refs"), F.expr(f"sort_array(array_distinct(concat(from_items, {added})))").alias("pages"),
        F.expr("sort_array(array_distinct(if(own, best.labels, filter(transform(kept, s -> s.label), l -> l <> ''))))").alias("labels"),
        F.expr("size(members) > 1 and exists(members, r -> size(r.refs) > 0 and not arrays_overlap(r.refs, if(size(live) > 0, live, best.refs)))").alias("lost"),
    )


def expand(results: DataFrame, items: DataFrame, max_chars: int) -> DataFrame:
    """Expanded results, best first: ``doc_id, result_id, result_ids, seq, score, content, refs, pages, labels``.

    Overlapping ranges of a document become one result, unless the clip would leave a member without any of its
    evidence; then each member of that group stands by itself. Both forms are built in one pass over the items.
    """
    matched = resolve(results, items)
    near = fetched(items, matched)
    ranges = results.join(expansion_ranges(matched, near, max_chars), ["doc_id", "result_id"])
    alone = F.struct(F.lit(False).alias("shared"), F.lit(0).cast("long").alias("nr"), F.col("result_id").cast("string").alias("only"))
    shared = F.struct(F.lit(True).alias("shared"), F.col("grp").alias("nr"), F.lit("").alias("only"))
    both = group_ranges(ranges).withColumn("set", F.col("grp")).withColumn("grp", F.explode(F.array(shared, alone)))
    built = build(both, near, max_chars).withColumn("shared", F.col("grp.shared"))
    split = F.max(F.col("shared") & F.col("lost")).over(Window.partitionBy("doc_id", "set"))
    chosen = built.withColumn("split", split).where(F.col("shared") != F.col("split"))
    plain = results.join(matched.select("doc_id", "result_id").distinct(), ["doc_id", "result_id"], "left_anti").withColumn("result_ids", F.array("result_id"))
    cols = ["doc_id", "result_id", "result_ids", "seq", "score", "content", "refs", "pages", "labels"]
    out = chosen.select(*cols).unionByName(plain.select(*cols))
    return out.orderBy(F.desc("score"), "doc_id", "seq")
