"""Named queries on outlines, slices, attachments, picture chunks and texts of results; see ``registry`` for the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import scalars as X
from lodestone.functions import views as V
from lodestone.operators import pictures as P
from lodestone.operators import structure as S
from lodestone.plans.corpus_queries import items_of
from lodestone.plans.registry import ITEMS, META, docs_of, query
from lodestone.sources import slices as L

#: Level of a header by the length of its text.
LEVEL = "CASE WHEN length(text) <= 15 THEN 1 WHEN length(text) <= 35 THEN 2 ELSE 3 END"
#: Characters of a page, pages of a slice, items of a slice.
PAGE, SLICE, PART = 500, 4, 3


@query("outline_tree", f"""WITH h AS (SELECT doc_id, position, {LEVEL} AS level FROM ({ITEMS}) WHERE label = 'section_header'), l AS (SELECT doc_id, max(position) + 1 AS after FROM ({ITEMS}) GROUP BY doc_id)
SELECT h.doc_id, h.position, h.level, (SELECT max(p.position) FROM h p WHERE p.doc_id = h.doc_id AND p.position < h.position AND p.level < h.level) AS parent_pos,
coalesce((SELECT min(n.position) FROM h n WHERE n.doc_id = h.doc_id AND n.position > h.position AND n.level <= h.level), l.after) AS end_pos FROM h JOIN l USING (doc_id)""")  # fmt: skip
def outline_tree(spark, d):
    """Headers with their parent and end."""
    return S.outline(V.items(docs_of(spark, d)).withColumn("level", F.expr(LEVEL))).drop("text")


@query("heading_backfill", f"""SELECT doc_id, position, CASE WHEN max(label = 'page_footer') OVER (PARTITION BY doc_id) THEN 0 ELSE {LEVEL} END AS level FROM ({ITEMS})""")
def heading_backfill(spark, d):
    """Levels from a second extraction, which has no blank lines and so differs in number where there are some."""
    items = items_of(spark, d).withColumn("level", F.lit(0))
    again = items.where("label <> 'page_footer'").withColumn("level", F.expr(LEVEL))
    return S.backfill_levels(items, again).select("doc_id", "position", "level")


@query("page_slices", f"""SELECT uri, slice, slice * {SLICE} + 1 AS first_page, least(slice * {SLICE} + {SLICE}, n_pages) AS last_page
FROM (SELECT uri, n_pages, unnest(range(0, CAST(ceil(n_pages / {SLICE}.0) AS BIGINT))) AS slice FROM (SELECT uri, CAST(ceil(n_chars / {PAGE}.0) AS BIGINT) AS n_pages FROM ({META})))""")  # fmt: skip
def page_slices(spark, d):
    """Slices of documents cut into pages."""
    return L.page_slices(V.meta(docs_of(spark, d)).select("uri", F.ceil(F.col("n_chars") / PAGE).alias("n_pages")), SLICE)


@query("joined_slices", f"SELECT CAST(doc_id AS VARCHAR) AS uri, position, position // {PART} + 1 AS page_no, length(text) AS chars FROM ({ITEMS}) WHERE doc_id NOT IN (SELECT doc_id FROM ({ITEMS}) WHERE length(text) > 1000)")
def joined_slices(spark, d):
    """Items of slices as items of whole documents; a slice with a very long line counts as failed."""
    i = V.items(docs_of(spark, d)).select(F.col("doc_id").cast("string").alias("uri"), F.floor(F.col("position") / PART).alias("slice"), (F.col("position") % PART).alias("position"), F.lit(1).alias("page_no"), F.length("text").alias("chars"))
    cut = i.select("uri", "slice", (F.col("slice") + 1).alias("first_page")).distinct()
    return L.join_slices(cut, i, i.where("chars > 1000").select("uri", "slice"))


@query("attachment_reconcile", """WITH o AS (SELECT 'doc://' || doc_id AS uri, source AS parent_uri, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0),
n AS (SELECT 'doc://' || doc_id AS uri, source AS parent_uri, CASE WHEN doc_id % 11 = 0 THEN 'new' ELSE md5(text) END AS h FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 7 = 0)
SELECT coalesce(o.uri, n.uri) AS uri, coalesce(o.parent_uri, n.parent_uri) AS parent_uri, CASE WHEN n.uri IS NULL THEN 'delete' WHEN o.uri IS NULL THEN 'add' ELSE 'update' END AS action
FROM o FULL JOIN n ON o.uri = n.uri WHERE o.h IS DISTINCT FROM n.h OR o.uri IS NULL OR n.uri IS NULL""")  # fmt: skip
def attachment_reconcile(spark, d):
    """Children added, changed and removed between two scans of their parents."""
    docs = docs_of(spark, d)
    child = docs.select("doc_id", F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("uri"), F.col("source").alias("parent_uri"), F.md5("text").alias("content_hash"))
    now = child.where("doc_id % 5 <> 0 or doc_id % 7 = 0").withColumn("content_hash", F.when(F.col("doc_id") % 11 == 0, "new").otherwise(F.col("content_hash")))
    return L.reconcile(child.select("parent_uri"), child.where("doc_id % 7 <> 0").drop("doc_id"), now.drop("doc_id"))


@query("picture_chunk_order", f"""WITH p AS (SELECT doc_id, min(position) AS position, text AS content, 'picture' AS kind FROM ({ITEMS}) WHERE label = 'section_header' GROUP BY doc_id, text)
SELECT doc_id, content, kind, row_number() OVER (PARTITION BY doc_id ORDER BY position) - 1 AS ord FROM (SELECT * FROM p UNION ALL SELECT doc_id, position, text, 'text' FROM ({ITEMS}) WHERE label = 'text')""")  # fmt: skip
def picture_chunk_order(spark, d):
    """Chunks of text and of pictures in reading order; short lines stand for pictures, with their text as bytes."""
    items = items_of(spark, d).withColumn("picture_data", F.when(F.col("label") == "section_header", F.encode("text", "utf-8")))
    items = items.withColumn("label", F.when(F.col("label") == "section_header", "picture").otherwise(F.col("label")))
    texts = items.where("label = 'text'").select("doc_id", F.col("position").alias("ord"), F.col("text").alias("content"), F.array("self_ref").alias("refs"), F.array(F.lit("text")).alias("labels"))
    merged = P.in_structure_order(texts, P.picture_chunks(items), items)
    return merged.select("doc_id", "content", F.get("labels", F.lit(0)).alias("kind"), "ord")


@query("agent_texts", """SELECT doc_id, md5('[' || doc_id || '] [rank ' || doc_id || ']' || chr(10) || 'Source: "' || lang || ' document ' || doc_id || '" > ' || lang || ' > ' || source || chr(10) || 'Type: table' || chr(10) || 'Content:' || chr(10) || coalesce(text, '')) AS digest FROM documents""")
def agent_texts(spark, d):
    """Digest of each document written out as a search result."""
    docs = docs_of(spark, d)
    number, none = F.col("doc_id").cast("string"), F.lit(None)
    title = F.concat("lang", F.lit(" document "), number)
    shown = X.agent_text(number, F.lit(0.5), F.col("doc_id"), none.cast("int"), title, F.array("lang", "source"), F.array(F.lit("text"), F.lit("table")), none.cast("map<string,string>"), F.col("text"))
    return docs.select("doc_id", F.md5(shown).alias("digest"))
