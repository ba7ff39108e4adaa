"""Paged files cut into slices of pages and put together again, and files attached to files as child documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: levels of documents within documents, the outermost included.
MAX_DEPTH = 3


def page_slices(files: DataFrame, size: int) -> DataFrame:
    """``uri, slice, first_page, last_page`` for files with ``n_pages``: pages count from 1, and each slice is a row of its own."""
    if size <= 0:
        raise ValueError("a slice needs at least one page")
    rows = files.where("n_pages > 0").select("uri", "n_pages", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_pages") - 1) / size).cast("int"))).alias("slice"))
    return rows.select("uri", "slice", (F.col("slice") * size + 1).alias("first_page"), F.least(F.col("slice") * size + size, F.col("n_pages")).alias("last_page"))


def join_slices(slices: DataFrame, items: DataFrame, failed: DataFrame) -> DataFrame:
    """``items`` of converted slices (``uri, slice, position, page_no`` and more) as items of the whole files.

    Positions run on over the slices, pages count from the start of the file. A file with a failed slice (``uri, slice``)
    has no items at all, so that it is tried again as a whole.
    """
    sound = items.join(failed.select("uri").distinct(), "uri", "left_anti")
    lengths = slices.join(sound.groupBy("uri", "slice").agg((F.max("position") + 1).alias("_n")), ["uri", "slice"], "left")
    order = Window.partitionBy("uri").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lengths.select("uri", "slice", F.coalesce(F.sum(F.coalesce("_n", F.lit(0))).over(order), F.lit(0)).alias("_from"), (F.col("first_page") - 1).alias("_page"))
    both = sound.join(offsets, ["uri", "slice"])
    return both.withColumns({"position": F.col("position") + F.col("_from"), "page_no": F.col("page_no") + F.col("_page")}).drop("slice", "_from", "_page")


def _quoted(name: Column) -> Column:
    """Percent-encoded, but for letters, digits and ``_.-~``."""
    form = F.url_encode(name)  # of forms: blanks are plus signs, an asterisk stays and a tilde doesn't
    return F.replace(F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def attachments(found: DataFrame, depth: int) -> DataFrame:
    """``uri, parent_uri, content, content_hash, depth`` of ``parent_uri, name, content`` attached to documents at ``depth``.

    Nameless files are left out; of one name in one document the last by content hash stays. At the deepest level there are none.
    """
    named = found.where("coalesce(name, '') <> ''").withColumn("content_hash", F.md5("content"))
    if depth + 1 >= MAX_DEPTH:
        named = named.where(F.lit(False))
    child = named.withColumn("uri", F.concat("parent_uri", F.lit("#attachment="), _quoted(F.col("name"))))
    last = Window.partitionBy("uri").orderBy(F.desc("content_hash"))
    return child.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").select("uri", "parent_uri", "content", "content_hash", F.lit(depth + 1).alias("depth"))


def reconcile(scanned: DataFrame, known: DataFrame, now: DataFrame) -> DataFrame:
    """``uri, parent_uri, action`` that bring the children of the ``scanned`` parents (``parent_uri``) in line.

    ``known`` and ``now`` have ``uri, parent_uri, content_hash``. Children of parents that could not be scanned stay.
    """
    parents = scanned.select("parent_uri").distinct()
    old = known.join(parents, "parent_uri", "left_semi").select("uri", "parent_uri", F.col("content_hash").alias("_old"))
    new = now.join(parents, "parent_uri", "left_semi").select("uri", F.col("parent_uri").alias("_parent"), F.col("content_hash").alias("_new"), F.lit(True).alias("_is"))
    both = old.withColumn("_was", F.lit(True)).join(new, "uri", "full_outer").where(~(F.col("_was").eqNullSafe(True) & F.col("_is").eqNullSafe(True) & F.col("_old").eqNullSafe(F.col("_new"))))
    action = F.when(F.col("_is").isNull(), "delete").when(F.col("_was").isNull(), "add").otherwise("update")
    return both.select("uri", F.coalesce("parent_uri", "_parent").alias("parent_uri"), action.alias("action"))
