"""Named queries on table functions, rebuilds and sweeps; see ``registry`` for the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import embedding as E
from lodestone.functions import tables as T
from lodestone.functions import views as V
from lodestone.operators import rebuild as D
from lodestone.plans.document_queries import LEVEL
from lodestone.plans.registry import CHUNKS, ITEMS, META, SQL, docs_of, query
from lodestone.streaming import sync as Y

#: Documents of the second version of a corpus: some have another text, some are gone.
CHANGED, GONE = "doc_id % 11 = 0", "doc_id % 13 = 0"
WORD = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"


def functions_of(spark, d) -> None:
    docs = docs_of(spark, d)
    chunks = V.chunks(docs).select(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("ord").cast("string")).alias("chunk_id"), F.col("doc_id").alias("document_id"), "content")
    T.register(spark, V.meta(docs), V.items(docs).withColumn("level", F.expr(LEVEL)), chunks, "lodestone_")


@query("outline_function", SQL["outline_tree"])
def outline_function(spark, d):
    """Headers of all documents by the Python table function."""
    functions_of(spark, d)
    return spark.sql("SELECT * FROM lodestone_outline(TABLE(lodestone_items_view))")


@query("toc_function", SQL["outline_tree"])
def toc_function(spark, d):
    """The same by the SQL table function, called for each document."""
    functions_of(spark, d)
    return spark.sql("SELECT m.doc_id, t.position, t.level, t.parent_pos, t.end_pos FROM lodestone_meta_view m, LATERAL lodestone_toc(m.doc_id) t")


@query("items_function", f"SELECT m.title, i.position, i.label, i.text FROM ({META}) m JOIN ({ITEMS}) i USING (doc_id)")
def items_function(spark, d):
    """Items looked up for each document of the metadata."""
    functions_of(spark, d)
    return spark.sql("SELECT m.title, i.position, i.label, i.text FROM lodestone_meta_view m, LATERAL lodestone_items(m.doc_id) i")


@query("list_documents_function", f"SELECT id, uri, title FROM ({META}) WHERE title LIKE 'en %' AND id > '15' ORDER BY id LIMIT 100")
def list_documents_function(spark, d):
    """The page of a hundred titles after an id."""
    functions_of(spark, d)
    return spark.sql("SELECT id, uri, title FROM lodestone_list_documents('en %', '15', 100)")


@query("search_function", f"""WITH c AS (SELECT doc_id || '-' || ord AS chunk_id, doc_id AS document_id, {WORD.format("content")} AS w FROM ({CHUNKS})
), st AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM c
), q AS (SELECT unnest(list_distinct({WORD.format("text")})) AS term FROM (SELECT text FROM benchmark ORDER BY item_id LIMIT 1)
), tf AS (SELECT chunk_id, document_id, len, term, count(*) AS tf FROM (SELECT chunk_id, document_id, len(w) AS len, unnest(w) AS term FROM c) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term
), s AS (SELECT chunk_id, document_id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 5) AS score
  FROM tf JOIN df USING (term), st GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s) WHERE rank <= 50""")  # fmt: skip
def search_function(spark, d):
    """The fifty best chunks for the text of the first benchmark item."""
    functions_of(spark, d)
    asked = V.table(spark, d, "benchmark").orderBy("item_id").first()
    return spark.sql("SELECT * FROM lodestone_search(:asked, 50)", {"asked": asked["text"]})


def second_version(docs: DataFrame) -> DataFrame:
    return docs.where(f"NOT ({GONE})").withColumn("text", F.when(F.expr(CHANGED), F.concat("text", F.lit(" appended line"))).otherwise(F.col("text")))


@query("delta_rebuild", f"""WITH o AS ({CHUNKS}), n AS ({CHUNKS.replace("FROM documents", f"FROM (SELECT doc_id, CASE WHEN {CHANGED} THEN text || ' appended line' ELSE text END AS text FROM documents WHERE NOT ({GONE}))")}),
nc AS (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (content IN (SELECT content FROM o)) AS n_reused FROM n GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_gone FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = o.doc_id AND n.content = o.content) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_reused, 0) AS n_reused, coalesce(n_chunks - n_reused, 0) AS n_new, coalesce(n_gone, 0) AS n_gone
FROM (SELECT DISTINCT doc_id FROM o) d LEFT JOIN nc USING (doc_id) LEFT JOIN g USING (doc_id)""")  # fmt: skip
def delta_rebuild(spark, d):
    """Chunks kept, made and gone when a corpus of which all is embedded becomes its second version."""
    docs, embed = docs_of(spark, d), E.hashing(8)
    first = V.stored(D.delta_embedded(V.chunks(docs), None, F.col("content"), embed, "hashing-8"), "first")
    second = D.delta_embedded(V.chunks(second_version(docs)), first.select("key", "vector"), F.col("content"), embed, "hashing-8")
    return D.delta_counts(second, first, "doc_id")


@query("listing_sweep", """WITH l AS (SELECT 'doc://' || doc_id AS uri, doc_id, md5(text) AS h FROM documents)
SELECT uri, 'UPSERT' AS action, h AS revision, CAST(60 AS BIGINT) AS at FROM l
UNION ALL SELECT uri, 'UPSERT', 'new', CAST(120 AS BIGINT) FROM l WHERE doc_id % 11 = 0 AND doc_id % 7 <> 0 AND doc_id % 5 <> 0
UNION ALL SELECT uri, 'UPSERT', 'new', CAST(180 AS BIGINT) FROM l WHERE doc_id % 11 = 0 AND doc_id % 7 <> 0 AND doc_id % 5 = 0
UNION ALL SELECT uri, 'DELETE', h, CAST(180 AS BIGINT) FROM l WHERE doc_id % 7 = 0""")
def listing_sweep(spark, d):
    """Changes that three listings of all documents tell: every seventh lacks in two, every fifth in one, every eleventh changes."""
    docs = docs_of(spark, d)
    listed = docs.select(F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("uri"), F.md5("text").alias("revision"), "doc_id")
    again = F.when(F.col("doc_id") % 11 == 0, "new").otherwise(F.col("revision")).alias("revision")
    folder = V.scratch(spark, "sweep")
    for at, rows in enumerate([listed, listed.where("doc_id % 7 <> 0 and doc_id % 5 <> 0").select("uri", again), listed.where("doc_id % 7 <> 0").select("uri", again)], 1):
        rows.select("uri", "revision", F.timestamp_seconds(F.lit(60 * at)).alias("ts")).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema("uri string, revision string, ts timestamp").parquet(f"{folder}/in")
    told = Y.swept(stream, 60).select("uri", "action", "revision", F.unix_seconds("ts").alias("at"))
    told.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("uri string, action string, revision string, at long").parquet(f"{folder}/out")
