"""A corpus in a versioned store: import, search, expand, delete and rebuild, each change one commit over all tables."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import scalars as X
from lodestone.functions.embedding import Embedder, hashing
from lodestone.operators import chunking, context, rebuild
from lodestone.operators import retrieval as R
from lodestone.operators.structure import structural_title
from lodestone.sources.files import markdown_items
from lodestone.sources.store import Store, list_documents

#: Tables and the column that names the document.
TABLES = {"document_meta": "id", "documents": "id", "document_items": "doc_id", "chunks": "document_id"}


def _no_metadata() -> Column:
    return F.create_map().cast("map<string,string>")


def _entries(column: str) -> Column:
    """A map as sorted entries, which compare as maps don't."""
    return F.array_sort(F.map_entries(column))


class Corpus:
    """Documents are ``uri, title, content`` and optionally ``parent_uri`` and ``metadata``, a map of texts; their id is a hash of the uri.

    A null title becomes the one that the structure of the document gives. ``model`` names the embedder: chunks with the
    same text keep their vectors as long as the name stays.
    """

    def __init__(self, spark: SparkSession, root: str, embed: Embedder | None = None, words: int = 200, model: str = "default"):
        self.store, self.embed, self.words, self.model = Store(spark, root), embed or hashing(), words, model

    def _parts(self, docs: DataFrame) -> dict[str, DataFrame]:
        now = F.lit(datetime.now(UTC))
        if "metadata" not in docs.columns:
            docs = docs.withColumn("metadata", F.lit(None).cast("map<string,string>"))
        rest = [c for c in docs.columns if c != "uri"]
        rank = F.struct(*[_entries(c) if c == "metadata" else F.col(c) for c in rest])
        d = docs.groupBy("uri").agg(F.max_by(F.struct(*rest), rank).alias("_r")).select("uri", "_r.*").withColumn("id", F.sha2("uri", 256))  # of one uri always the same row
        parent = F.col("parent_uri") if "parent_uri" in docs.columns else F.lit(None).cast("string")
        items = markdown_items(d.withColumnRenamed("content", "text"), "id").withColumns({"self_ref": F.concat(F.lit("#/texts/"), F.col("position").cast("string")), "pages": F.lit(None).cast("array<int>")})
        found = structural_title(items.withColumn("layer", F.lit("body"))).select(F.col("doc_id").alias("id"), F.col("title").alias("_found"))
        meta = d.join(found, "id", "left").select(
            "id", "uri", F.coalesce("title", "_found").alias("title"), parent.alias("parent_uri"), F.md5("content").alias("content_hash"),
            F.coalesce("metadata", _no_metadata()).alias("metadata"), now.alias("created_at"), now.alias("updated_at"),
        )
        return {"document_meta": meta, "documents": d.select("id", "content"), "document_items": items, "chunks": self._chunks(items)}

    def _chunks(self, items: DataFrame) -> DataFrame:
        """Chunks of at most ``words`` words that stay within a section; what is embedded starts with the section's heading.

        Vectors of texts that the store knows are taken from it, the others are made.
        """
        c = chunking.hybrid_chunks(items, self.words)
        ord_ = F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "part")) - 1
        chunk_id = F.concat_ws("-", "doc_id", F.col("ord").cast("string"))
        heading = F.get("headings", F.size("headings") - 1)
        told = X.contextualised(F.when(heading.isNotNull(), F.array(heading)).otherwise(F.array().cast("array<string>")), F.col("content"))
        cut = c.withColumn("ord", ord_).select(chunk_id.alias("id"), F.col("doc_id").alias("document_id"), "ord", "content", "refs", "labels", heading.alias("heading"), told.alias("_told_text"))
        known = self.store.read("chunks") if self.store.version() else None
        known = None if known is None or "key" not in known.columns else known.select("key", "vector")
        return rebuild.delta_embedded(cut, known, F.col("_told_text"), self.embed, self.model).drop("_told_text", "reused")

    def add(self, docs: DataFrame) -> int:
        """Add documents; those whose uri is known are replaced, but keep their creation time and the metadata not given anew.

        Appends only, when none is known.
        """
        new = self._parts(docs)
        if self.store.version() == 0:
            return self.store.commit(new, note="add")
        ids = new["document_meta"].select("id")
        if self.store.read("document_meta").join(ids, "id", "left_semi").isEmpty():
            return self.store.commit(append=new, note="add")
        before = self.store.read("document_meta").select("id", F.col("created_at").alias("_at"), F.col("metadata").alias("_old"))
        meta = new["document_meta"].join(before, "id", "left").withColumns({"created_at": F.coalesce("_at", "created_at"), "metadata": X.merge_maps(F.col("_old"), F.col("metadata"))})
        new["document_meta"] = meta.select(*new["document_meta"].columns)
        kept = {t: self.store.read(t).join(ids.withColumnRenamed("id", c), c, "left_anti").select(*new[t].columns) for t, c in TABLES.items()}
        return self.store.commit({t: kept[t].unionByName(new[t]) for t in TABLES}, note="replace")

    def refresh(self, rows: DataFrame) -> int:
        """Set titles and add metadata of known documents from ``uri, title, metadata``; null titles stay, of one uri one row counts.

        A version is committed only if something changes; returns the newest one.
        """
        one = rows.groupBy("uri").agg(F.max_by(F.struct("title", "metadata"), F.struct("title", _entries("metadata"))).alias("_r"))
        old = self.store.read("document_meta")
        both = old.join(one, "uri", "left").withColumns({"_title": F.coalesce("_r.title", "title"), "_meta": X.merge_maps(F.col("metadata"), F.col("_r.metadata"))})
        differs = ~F.col("_title").eqNullSafe(F.col("title")) | ~_entries("_meta").eqNullSafe(_entries("metadata"))
        if both.where(differs).isEmpty():
            return self.store.version()
        new = both.withColumn("updated_at", F.when(differs, F.lit(datetime.now(UTC))).otherwise(F.col("updated_at"))).withColumns({"title": F.col("_title"), "metadata": F.col("_meta")})
        return self.store.commit({"document_meta": new.select(*old.columns)}, note="refresh")

    def changed(self, docs: DataFrame) -> DataFrame:
        """Documents that are new or whose content differs from the stored one."""
        known = self.store.read("document_meta").select("uri", F.col("content_hash").alias("_hash"))
        return docs.join(known, "uri", "left").where(~F.col("_hash").eqNullSafe(F.md5("content"))).drop("_hash")

    def delete(self, uri: str) -> int:
        """Delete a document and all below it."""
        return self.store.cascade_delete(uri, {t: c for t, c in TABLES.items() if t != "document_meta"})

    def documents(self, where: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        return list_documents(self.store.read("document_meta"), where, limit, offset)

    def count(self, where: str | None = None) -> int:
        return self.documents(where).count()

    def search(self, text: str, limit: int = 5, kind: str = "hybrid", where: str | None = None) -> DataFrame:
        """``chunk_id, document_id, uri, title, content, score, rank, refs, labels``; the filter holds before the limit. Blank text finds nothing."""
        spark, chunks, meta = self.store.spark, self.store.read("chunks"), self.store.read("document_meta")
        if where:
            chunks = chunks.join(self.documents(where).select(F.col("id").alias("document_id")), "document_id", "left_semi")
        q = spark.createDataFrame([(0, text)], "query_id int, query string").where(F.trim("query") != "")
        ranked = []
        if kind in ("vector", "hybrid"):
            asked = q.select(F.col("query_id").cast("string").alias("vec_id"), self.embed(F.col("query")).alias("embedding"))
            ranked.append(R.vector_search(chunks.select(F.col("id").alias("vec_id"), F.col("vector").alias("embedding")), asked, limit).withColumnRenamed("vec_id", "chunk_id"))
        if kind in ("fts", "hybrid"):
            fts = R.bm25(chunks.select(F.col("id").alias("doc_id"), F.col("content").alias("text")), q, limit).withColumnRenamed("doc_id", "chunk_id")
            ranked.append(fts.withColumn("query_id", F.col("query_id").cast("string")))
        if not ranked:
            raise ValueError(f"unknown kind of search: {kind}")
        hits = R.fuse(ranked, "chunk_id", limit) if kind == "hybrid" else ranked[0]
        found = hits.join(chunks.withColumnRenamed("id", "chunk_id"), "chunk_id").join(meta.select(F.col("id").alias("document_id"), "uri", "title"), "document_id", "left")
        return found.select("chunk_id", "document_id", "uri", "title", "content", "score", "rank", "refs", "labels").orderBy("rank")

    def expand(self, hits: DataFrame, max_chars: int = 4000) -> DataFrame:
        """Search results grown into their context."""
        none = F.lit(None).cast("array<int>")
        r = hits.select(F.col("document_id").alias("doc_id"), F.col("chunk_id").alias("result_id"), F.col("rank").alias("seq"), "score", "content", "refs", none.alias("pages"), "labels")
        return context.expand(r, self.store.read("document_items"), max_chars)

    def rebuild(self, words: int | None = None, embed: Embedder | None = None, model: str | None = None) -> int:
        """Cut all chunks anew from the items and embed only the texts whose vectors the store lacks.

        An embedder without a name counts as a new model, so it embeds all.
        """
        self.words = words or self.words
        if embed is not None:
            self.embed, self.model = embed, model or f"{self.model}-{self.store.version()}"
        return self.store.commit({"chunks": self._chunks(self.store.read("document_items"))}, note="rebuild")

    def rechunk(self, words: int) -> int:
        """Cut all chunks anew; those that come out as before keep their vectors."""
        return self.rebuild(words=words)

    def reembed(self, embed: Embedder) -> int:
        """Embed all chunks anew."""
        return self.rebuild(embed=embed)
