"""Pictures of documents: their chunks, their bytes on search results, and boxes on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def picture_chunks(items: DataFrame, min_side: int = 0) -> DataFrame:
    """``doc_id, content, refs, labels, pages, image`` of each distinct picture of a document, where it stands first.

    ``items`` has ``picture_data`` and, where known, ``width`` and ``height``; a picture whose smaller side is known to be
    under ``min_side`` has no chunk, nor has one without bytes. Bytes are compared by their hash, so they do not shuffle twice.
    """
    p = items.where((F.col("label") == "picture") & F.col("picture_data").isNotNull())
    if min_side > 0 and {"width", "height"} <= set(items.columns):
        p = p.where(F.coalesce(F.least("width", "height") >= min_side, F.lit(True)))
    same = Window.partitionBy("doc_id", "_hash").orderBy("position")
    first = p.withColumn("_hash", F.sha2("picture_data", 256)).withColumn("_rn", F.row_number().over(same)).where("_rn = 1")
    return first.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("content"), F.array("self_ref").alias("refs"), F.array(F.lit("picture")).alias("labels"),
        F.array_sort(F.array_distinct("pages")).alias("pages"), F.col("picture_data").alias("image"),
    )


def in_structure_order(text_chunks: DataFrame, pictures: DataFrame, items: DataFrame) -> DataFrame:
    """Chunks of both kinds by the position of their first reference, numbered anew as ``ord``.

    Text comes before pictures at one position; chunks without a known first reference come last, in their old order.
    """
    texts = text_chunks.withColumns({"_kind": F.lit(0), "_old": F.col("ord").cast("long")}).drop("ord")
    both = texts.unionByName(pictures.withColumns({"_kind": F.lit(1), "_old": F.lit(0).cast("long")}), allowMissingColumns=True)
    at = items.groupBy("doc_id", F.col("self_ref").alias("_first")).agg(F.min("position").alias("_at"))
    placed = both.withColumn("_first", F.get("refs", F.lit(0))).join(at, ["doc_id", "_first"], "left")
    order = Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("_at"), "_kind", "_old", "_first")
    return placed.withColumn("ord", F.row_number().over(order) - 1).drop("_kind", "_old", "_first", "_at")


def with_pictures(results: DataFrame, items: DataFrame) -> DataFrame:
    """``results`` with ``image_data`` (picture to bytes) and ``picture_captions``; null where there are none.

    A result carries the pictures that it refers to, and those whose caption it refers to: a caption follows its picture.
    """
    run = Window.partitionBy("doc_id").orderBy("position")
    mine = items.join(results.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "position", "self_ref", "label", "text")
    before = mine.withColumns({"_label": F.lag("label").over(run), "_ref": F.lag("self_ref").over(run)})
    captions = before.where("label = 'caption' and _label = 'picture'").select("doc_id", "self_ref", F.col("_ref").alias("picture"))
    direct = mine.where("label = 'picture'").select("doc_id", "self_ref", F.col("self_ref").alias("picture"))
    asked = results.select("doc_id", "result_id", F.explode(F.array_distinct("refs")).alias("self_ref"))
    wanted = asked.join(direct.unionByName(captions), ["doc_id", "self_ref"]).select("doc_id", "result_id", "picture").distinct()
    held = items.where("label = 'picture' and picture_data is not null").select("doc_id", F.col("self_ref").alias("picture"), "picture_data", F.col("text").alias("_caption"))
    found = wanted.join(held, ["doc_id", "picture"]).groupBy("doc_id", "result_id").agg(F.sort_array(F.collect_list(F.struct("picture", "picture_data", "_caption"))).alias("_p"))
    told = F.filter("_p", lambda x: F.coalesce(x["_caption"], F.lit("")) != "")
    maps = found.select(
        "doc_id", "result_id", F.map_from_entries(F.transform("_p", lambda x: F.struct(x["picture"], x["picture_data"]))).alias("image_data"),
        F.when(F.size(told) > 0, F.map_from_entries(F.transform(told, lambda x: F.struct(x["picture"], x["_caption"])))).alias("picture_captions"),
    )
    return results.join(maps, ["doc_id", "result_id"], "left")


def boxes(results: DataFrame, boxed: DataFrame, pages: DataFrame, swept: DataFrame | None = None) -> DataFrame:
    """``doc_id, page_no, self_ref, matched, left, top, right, bottom`` in pixels from the top left of the page's image.

    ``boxed`` has ``doc_id, self_ref, page_no, l, t, r, b, origin`` (``BOTTOMLEFT`` or ``TOPLEFT``), ``pages`` has
    ``doc_id, page_no, width, height, image_width, image_height``. ``swept`` names further ``doc_id, self_ref`` around the
    matched ones. Pages without a size or an image have no boxes.
    """
    marks = results.select("doc_id", F.explode("refs").alias("self_ref")).withColumn("matched", F.lit(True))
    if swept is not None:
        marks = marks.unionByName(swept.select("doc_id", "self_ref").withColumn("matched", F.lit(False)))
    marks = marks.groupBy("doc_id", "self_ref").agg(F.max("matched").alias("matched"))
    j = boxed.join(marks, ["doc_id", "self_ref"]).join(pages.where("width > 0 and height > 0 and image_width > 0 and image_height > 0"), ["doc_id", "page_no"])
    up = F.col("origin") == "BOTTOMLEFT"
    sx, sy = F.col("image_width") / F.col("width"), F.col("image_height") / F.col("height")
    t, b = (F.when(up, F.col("height") - F.col(c)).otherwise(F.col(c)) * sy for c in "tb")
    return j.select("doc_id", "page_no", "self_ref", "matched", (F.col("l") * sx).alias("left"), F.least(t, b).alias("top"), (F.col("r") * sx).alias("right"), F.greatest(t, b).alias("bottom"))
