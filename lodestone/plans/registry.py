"""Named queries over the test tables, with the SQL that an independent engine runs for each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import scalars as X
from lodestone.functions import views as V
from lodestone.operators import integrity as I
from lodestone.operators import metrics as M
from lodestone.operators import queue as Q
from lodestone.operators import retrieval as R
from lodestone.operators import structure as S
from lodestone.sources import store as T

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return put


META = "SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, 'doc://' || source || '/' || doc_id AS uri, lang || ' document ' || doc_id AS title, lang, source, n_chars FROM documents"
ITEMS = """SELECT doc_id, position, text, CASE WHEN trim(text) = '' THEN 'page_footer' WHEN length(text) <= 60 THEN 'section_header' ELSE 'text' END AS label
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position FROM documents)"""
CHUNKS = """SELECT doc_id, ord, array_to_string(w[ord * 50 + 1:ord * 50 + 50], ' ') AS content
FROM (SELECT doc_id, w, unnest(range(0, CAST(ceil(len(w) / 50.0) AS BIGINT))) AS ord FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))"""
JOBS = """SELECT event_id AS id, user_id AS source_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'claimed' WHEN 'error' THEN 'dead' ELSE 'succeeded' END AS status, ts, value FROM events"""
DIST = "list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE))))"
VECTOR = f"""SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
FROM (SELECT q.vec_id AS query_id, v.vec_id, round(1 / (1 + {DIST}), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0)) WHERE rank <= 10"""
BM25 = """WITH tok AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents
), len AS (SELECT doc_id, len(w) AS n FROM tok), st AS (SELECT count(*) AS docs, avg(n) AS al FROM len
), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM tok) GROUP BY ALL
), q AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> ''))) AS term FROM benchmark
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term
), s AS (SELECT query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / al))), 5) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len USING (doc_id), st GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5"""


def docs_of(spark, d):
    return V.table(spark, d, "documents")


def vectors_of(spark, d):
    return V.table(spark, d, "embeddings")


def bench_queries(spark, d):
    return V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def searched(spark, d, k=10):
    v = vectors_of(spark, d)
    return R.vector_search(v, v.where("vec_id % 100 = 0"), k)


def jobs_of(spark, d):
    return Q.jobs(V.table(spark, d, "events"))


@query("doc_filter_list", f"SELECT id, uri, title FROM ({META}) WHERE lang = 'en' AND n_chars > 1000 ORDER BY doc_id LIMIT 50 OFFSET 10")
def doc_filter_list(spark, d):
    return V.meta(docs_of(spark, d)).where("lang = 'en' and n_chars > 1000").orderBy("doc_id").offset(10).limit(50).select("id", "uri", "title")


NAMES = ["Src1/", "document 7", "frdocument"]
NAMED = " OR ".join(f"lower({c}) LIKE '%{n.lower()}%' OR replace(lower({c}), ' ', '') LIKE '%{n.lower().replace(' ', '')}%'" for n in NAMES for c in ("uri", "title"))


@query("doc_name_filter", f"SELECT id, uri FROM ({META}) WHERE {NAMED}")
def doc_name_filter(spark, d):
    return V.meta(docs_of(spark, d)).where(X.name_filter(NAMES, F.col("uri"), F.col("title"))).select("id", "uri")


@query("metadata_json_filter", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def metadata_json_filter(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return V.table(spark, d, "events").where(k >= 50).select("event_id", k.alias("k"))


@query("chunk_semi_join_filter", f"SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(content)) AS BIGINT) AS chars FROM ({CHUNKS}) WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'de') GROUP BY doc_id")
def chunk_semi_join_filter(spark, d):
    docs = docs_of(spark, d)
    kept = V.chunks(docs.join(docs.where("lang = 'de'").select("doc_id"), "doc_id", "left_semi"))
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("content")).cast("long").alias("chars"))


@query("chunk_windows", f"SELECT doc_id, ord, length(content) AS n_chars, md5(content) AS content_md5 FROM ({CHUNKS})")
def chunk_windows(spark, d):
    return V.chunks(docs_of(spark, d)).select("doc_id", F.col("ord").cast("long").alias("ord"), F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("content_md5"))


@query("vector_topk", VECTOR)
def vector_topk(spark, d):
    return searched(spark, d)


@query("vector_topk_filtered_provenance", f"SELECT query_id, vec_id, score, rank, uri, title FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, v.label, round(1 / (1 + {DIST}), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 AND v.vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en'))) r LEFT JOIN ({META}) m ON m.doc_id = r.vec_id WHERE rank <= 10")
def vector_topk_filtered_provenance(spark, d):
    v, docs = vectors_of(spark, d), docs_of(spark, d)
    kept = v.join(docs.where("lang = 'en'").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    hits = R.vector_search(kept, v.where("vec_id % 100 = 0"), 10)
    return hits.join(V.meta(docs).withColumnRenamed("doc_id", "vec_id"), "vec_id", "left").select("query_id", "vec_id", "score", "rank", "uri", "title")


@query("fts_bm25_topk", BM25)
def fts_bm25_topk(spark, d):
    return R.bm25(docs_of(spark, d), bench_queries(spark, d), 5)


@query("phrase_match", "SELECT item_id, doc_id FROM documents d, benchmark b WHERE b.text <> '' AND contains(d.text, b.text)")
def phrase_match(spark, d):
    return R.phrase_match(docs_of(spark, d), V.table(spark, d, "benchmark"))


@query("hybrid_rrf_topk", f"""WITH v AS ({VECTOR}), l AS (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON v.label = q.label WHERE q.vec_id % 100 = 0),
f AS (SELECT query_id, vec_id, round(sum(1 / (CAST(60 AS DOUBLE) + rank)), 6) AS score FROM (SELECT query_id, vec_id, rank FROM v UNION ALL SELECT query_id, vec_id, rank FROM l WHERE rank <= 10) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM f) WHERE rank <= 10""")
def hybrid_rrf_topk(spark, d):
    v = vectors_of(spark, d)
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    first = R.top(v.select("vec_id", "label"), ["label"], ["vec_id"], 10)  # queries of a label have the same ones
    lexical = R.top(first.drop("rank").join(q, "label").drop("label"), ["query_id"], ["vec_id"], 10)
    return R.fuse([searched(spark, d), lexical], "vec_id", 10)


@query("picture_dedup", f"SELECT query_id, label, vec_id, score FROM (SELECT r.*, e.label, row_number() OVER (PARTITION BY query_id, e.label ORDER BY score DESC, rank) AS rn FROM ({VECTOR}) r JOIN embeddings e USING (vec_id)) WHERE rn = 1")
def picture_dedup(spark, d):
    hits = searched(spark, d).join(vectors_of(spark, d).select("vec_id", "label"), "vec_id")
    first = Window.partitionBy("query_id", "label").orderBy(F.desc("score"), "rank")
    return hits.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("query_id", "label", "vec_id", "score")


@query("section_spans", f"""SELECT doc_id, section, min(position) AS first_pos, max(position) AS last_pos, CAST(sum(CASE WHEN label <> 'page_footer' THEN length(text) ELSE 0 END) AS BIGINT) AS chars
FROM (SELECT *, CAST(sum(CASE WHEN label = 'section_header' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY position) AS BIGINT) AS section FROM ({ITEMS})) GROUP BY doc_id, section""")
def section_spans(spark, d):
    return S.section_spans(V.items(docs_of(spark, d))).withColumns({c: F.col(c).cast("long") for c in ("first_pos", "last_pos")})


@query("merge_overlapping_ranges", """WITH r AS (SELECT event_id AS id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS lo, CAST(floor(epoch(ts)) AS BIGINT) + 7200 AS hi FROM events),
f AS (SELECT *, CASE WHEN lo > coalesce(max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS o FROM r),
i AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY lo, hi, id ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT user_id, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM i GROUP BY user_id, island""")
def merge_overlapping_ranges(spark, d):
    lo = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    r = V.table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", lo.alias("lo"), (lo + 7200).alias("hi"))
    return S.merge_ranges(r, "user_id")


@query("caption_prev_picture", f"SELECT doc_id, position, prev_pos FROM (SELECT *, lag(label) OVER w AS pl, lag(position) OVER w AS prev_pos FROM ({ITEMS}) WINDOW w AS (PARTITION BY doc_id ORDER BY position)) WHERE label = 'text' AND pl = 'section_header'")
def caption_prev_picture(spark, d):
    return S.previous_item(V.items(docs_of(spark, d)), "text", "section_header").select("doc_id", F.col("position").cast("long").alias("position"), F.col("prev_pos").cast("long").alias("prev_pos"))


@query("toc_tree", f"""WITH i AS ({ITEMS}), h AS (SELECT doc_id, position, CASE WHEN length(text) <= 20 THEN 1 ELSE 2 END AS level FROM i WHERE label = 'section_header'),
l AS (SELECT doc_id, max(position) + 1 AS after FROM i GROUP BY doc_id)
SELECT h.doc_id, h.position, h.level, coalesce((SELECT min(n.position) FROM h n WHERE n.doc_id = h.doc_id AND n.position > h.position AND n.level <= h.level), l.after) AS end_pos FROM h JOIN l USING (doc_id)""")
def toc_tree(spark, d):
    return S.toc(V.items(docs_of(spark, d))).withColumns({c: F.col(c).cast("long") for c in ("position", "end_pos")})


@query("ref_chunk_index", f"SELECT doc_id, label, count(*) AS n, array_to_string(list(position ORDER BY position), ',') AS positions FROM ({ITEMS}) GROUP BY doc_id, label")
def ref_chunk_index(spark, d):
    g = V.items(docs_of(spark, d)).groupBy("doc_id", "label").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("position")).alias("p"))
    return g.select("doc_id", "label", "n", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("positions"))


@query("join_documents_meta", "SELECT d.doc_id, lang, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_documents_meta(spark, d):
    return docs_of(spark, d).select("doc_id", "lang").join(V.table(spark, d, "labels"), "doc_id", "left").select("doc_id", "lang", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("quality", "toxic")])


@query("anti_join_orphans", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_orphans(spark, d):
    return docs_of(spark, d).select("doc_id").join(V.table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("snapshot_diff", """WITH o AS (SELECT doc_id, md5(text) AS r FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'changed' ELSE md5(text) END AS r FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 7 = 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.r IS NULL THEN 'DELETE' WHEN o.r IS NOT DISTINCT FROM n.r THEN 'UNCHANGED' ELSE 'UPSERT' END AS action FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def snapshot_diff(spark, d):
    # every document is in one of the two versions at least
    rev = docs_of(spark, d).select("doc_id", F.md5("text").alias("rev"))
    new = rev.where("doc_id % 5 <> 0 or doc_id % 7 = 0").withColumn("rev", F.when(F.col("doc_id") % 11 == 0, "changed").otherwise(F.col("rev")))
    return Q.snapshot_diff(rev.where("doc_id % 7 <> 0"), new, "doc_id", "rev")


TREE = "SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, 'doc/' || doc_id AS uri, CASE WHEN doc_id > 9 THEN 'doc/' || (doc_id // 10) END AS parent_uri FROM documents"
BELOW = f"WITH RECURSIVE m AS ({TREE}), t AS (SELECT id, uri FROM m WHERE uri = 'doc/1' UNION ALL SELECT m.id, m.uri FROM m JOIN t ON m.parent_uri = t.uri)"


def tree_of(spark, d):
    path = lambda c: F.concat(F.lit("doc/"), c.cast("string"))
    i = F.col("doc_id")
    return docs_of(spark, d).select("doc_id", i.cast("string").alias("id"), path(i).alias("uri"), F.when(i > 9, path(F.floor(i / 10))).alias("parent_uri"))


@query("cascade_closure", f"{BELOW} SELECT id, uri FROM t")
def cascade_closure(spark, d):
    return T.descendants(tree_of(spark, d).drop("doc_id"), "doc/1")


@query("cascade_delete", f"{BELOW} SELECT 'document_meta' AS table_name, count(*) AS n_rows, CAST(sum(doc_id) AS BIGINT) AS ids FROM m WHERE id NOT IN (SELECT id FROM t) UNION ALL SELECT 'chunks', count(*), CAST(sum(doc_id) AS BIGINT) FROM ({CHUNKS}) WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT id FROM t)")
def cascade_delete(spark, d):
    s = T.Store(spark, V.scratch(spark, "store"))
    chunks = V.chunks(docs_of(spark, d)).withColumn("document_id", F.col("doc_id").cast("string"))
    s.commit({"document_meta": tree_of(spark, d), "chunks": chunks})
    s.cascade_delete("doc/1", {"chunks": "document_id"})
    line = lambda t: s.read(t).agg(F.count("*").alias("n_rows"), F.sum("doc_id").alias("ids")).select(F.lit(t).alias("table_name"), "n_rows", "ids")
    return line("document_meta").unionByName(line("chunks"))


@query("jobs_status_counts", f"SELECT status, count(*) AS n, max(id) AS last_id FROM ({JOBS}) GROUP BY status")
def jobs_status_counts(spark, d):
    return jobs_of(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


@query("jobs_rolling_throughput", f"SELECT source_id, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-29') AS last_day, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-23') AS last_week, min(id) FILTER (WHERE status = 'queued') AS oldest_queued FROM ({JOBS}) GROUP BY source_id")
def jobs_rolling_throughput(spark, d):
    since = lambda t: F.count(F.when(F.col("ts") >= F.expr(f"timestamp_ntz'{t} 00:00:00'"), 1))
    return jobs_of(spark, d).groupBy("source_id").agg(since("2024-01-29").alias("last_day"), since("2024-01-23").alias("last_week"), F.min(F.when(F.col("status") == "queued", F.col("id"))).alias("oldest_queued"))


QUEUE = f"""SELECT id, source_id, 'doc://' || id % 20 AS uri, status, CAST(1 AS BIGINT) AS attempts, ts AS scheduled_at, CASE WHEN status = 'claimed' THEN ts END AS claimed_at,
CASE WHEN status = 'claimed' THEN 'w' || source_id % 3 END AS claimed_by, value > 50 AS beats FROM ({JOBS})"""


def at(t):
    return F.expr(f"timestamp_ntz'{t}'")


def queue_of(spark, d):
    """The queue with all its columns, from the events."""
    j, none, claimed = jobs_of(spark, d), F.lit(None), F.col("status") == "claimed"
    return j.select(
        "id", "source_id", F.concat(F.lit("doc://"), (F.col("id") % 20).cast("string")).alias("uri"), "status", F.lit(1).cast("long").alias("attempts"), F.col("ts").alias("scheduled_at"),
        F.when(claimed, F.col("ts")).alias("claimed_at"), F.when(claimed, F.concat(F.lit("w"), (F.col("source_id") % 3).cast("string"))).alias("claimed_by"),
        F.when(claimed & (F.col("value") > 50), F.col("ts") + F.make_interval(hours=F.lit(12))).alias("last_heartbeat_at"), none.cast("timestamp_ntz").alias("completed_at"), none.cast("string").alias("last_error"),
    )


@query("jobs_claim_order", f"SELECT id, CASE WHEN r <= 100 THEN 'claimed' ELSE status END AS status, CASE WHEN r <= 100 THEN 2 ELSE 1 END::BIGINT AS attempts, CASE WHEN r <= 100 THEN 'w9' ELSE claimed_by END AS claimed_by FROM (SELECT q.*, r FROM ({QUEUE}) q LEFT JOIN (SELECT id, row_number() OVER (ORDER BY scheduled_at, id) AS r FROM ({QUEUE}) WHERE status = 'queued' AND scheduled_at <= TIMESTAMP '2024-01-20' AND source_id NOT IN (3, 4)) USING (id))")
def jobs_claim_order(spark, d):
    return Q.claim(queue_of(spark, d), "w9", at("2024-01-20 00:00:00"), 100, [3, 4]).select("id", "status", "attempts", "claimed_by")


@query("job_transitions", f"""SELECT id, CASE WHEN mine AND id <= 400 THEN 'succeeded' WHEN mine AND id <= 800 THEN 'dead' WHEN mine AND id <= 1600 THEN 'queued' ELSE status END AS status,
CASE WHEN mine AND id > 1200 THEN 0 ELSE 1 END::BIGINT AS attempts, CASE WHEN mine AND id BETWEEN 401 AND 1200 THEN 'boom' END AS last_error,
CASE WHEN mine AND id BETWEEN 801 AND 1200 THEN TIMESTAMP '2024-02-02' ELSE scheduled_at END AS scheduled_at, CASE WHEN mine AND id <= 800 THEN TIMESTAMP '2024-02-01' END AS completed_at
FROM (SELECT *, status = 'claimed' AND claimed_by = 'w1' AND id BETWEEN 1 AND 1600 AS mine FROM ({QUEUE}))""")
def job_transitions(spark, d):
    now, q = at("2024-02-01 00:00:00"), queue_of(spark, d)
    q = Q.bury(Q.succeed(q, list(range(1, 401)), "w1", now), list(range(401, 801)), "w1", "boom", now)
    q = Q.release(Q.reschedule(q, list(range(801, 1201)), "w1", "boom", at("2024-02-02 00:00:00")), list(range(1201, 1601)), "w1")
    return q.select("id", "status", "attempts", "last_error", "scheduled_at", "completed_at")


@query("job_retry_cancel", f"""WITH q AS ({QUEUE}), busy AS (SELECT DISTINCT a.id FROM q a JOIN q b ON a.source_id = b.source_id AND a.uri = b.uri AND a.id <> b.id AND b.status IN ('queued', 'claimed'))
SELECT id, CASE WHEN again THEN 'queued' ELSE status END AS status, CASE WHEN again THEN 0 ELSE 1 END::BIGINT AS attempts FROM (SELECT *, id <= 500 AND status IN ('dead', 'queued') AND id NOT IN (SELECT id FROM busy) AS again FROM q)
WHERE NOT (id BETWEEN 301 AND 900 AND (again OR status IN ('queued', 'claimed')))""")
def job_retry_cancel(spark, d):
    q = Q.retry(queue_of(spark, d), list(range(0, 501)), at("2024-02-01 00:00:00"))
    return Q.cancel(q, list(range(301, 901))).select("id", "status", "attempts")


@query("job_heartbeats", f"SELECT id, CASE WHEN status = 'claimed' AND claimed_by = 'w1' THEN TIMESTAMP '2024-02-01' WHEN beats THEN claimed_at + INTERVAL 12 HOUR END AS last_heartbeat_at FROM ({QUEUE}) WHERE status = 'claimed'")
def job_heartbeats(spark, d):
    q = queue_of(spark, d)
    return Q.renew(q, q.select("id", F.lit("w1").alias("claimed_by")), at("2024-02-01 00:00:00")).where("status = 'claimed'").select("id", "last_heartbeat_at")


@query("breaker_state", f"""WITH o AS (SELECT *, sum(CASE WHEN status = 'dead' THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY ts DESC, id DESC) AS goods FROM ({JOBS})),
s AS (SELECT source_id, count(*) FILTER (WHERE goods = 0) AS failures, max(ts) FILTER (WHERE goods = 0) AS last FROM o GROUP BY source_id)
SELECT source_id AS target, failures, CASE WHEN failures >= 2 THEN last END AS opened_at, CASE WHEN failures >= 2 THEN last + INTERVAL 90 SECOND END AS open_until FROM s""")
def breaker_state(spark, d):
    return Q.breaker(jobs_of(spark, d).select(F.col("source_id").alias("target"), "ts", F.col("id").alias("seq"), (F.col("status") != "dead").alias("ok")), 2, 90)


@query("jobs_page", f"SELECT id, source_id, status FROM ({JOBS}) ORDER BY ts DESC, id DESC LIMIT 50 OFFSET 100")
def jobs_page(spark, d):
    return jobs_of(spark, d).orderBy(F.desc("ts"), F.desc("id")).offset(100).limit(50).select("id", "source_id", "status")


@query("queue_dedup_live", f"""WITH q AS ({QUEUE}), old AS (SELECT * FROM q WHERE scheduled_at < TIMESTAMP '2024-01-15'), new AS (SELECT * FROM q WHERE scheduled_at >= TIMESTAMP '2024-01-15')
SELECT id, source_id, uri, status FROM old UNION ALL SELECT id, source_id, uri, status FROM (SELECT *, row_number() OVER (PARTITION BY source_id, uri ORDER BY id) AS rn FROM new) n
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM old WHERE old.source_id = n.source_id AND old.uri = n.uri AND old.status IN ('queued', 'claimed'))""")
def queue_dedup_live(spark, d):
    q = queue_of(spark, d)
    return Q.enqueue(q.where(F.col("scheduled_at") < at("2024-01-15 00:00:00")), q.where(F.col("scheduled_at") >= at("2024-01-15 00:00:00"))).select("id", "source_id", "uri", "status")


@query("lease_reaper", f"SELECT id, CASE WHEN late THEN 'queued' ELSE status END AS status, CASE WHEN late THEN 0 ELSE 1 END::BIGINT AS attempts, CASE WHEN late THEN NULL ELSE claimed_by END AS claimed_by FROM (SELECT *, status = 'claimed' AND claimed_at + CASE WHEN beats THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END < TIMESTAMP '2024-01-15' AS late FROM ({QUEUE}))")
def lease_reaper(spark, d):
    return Q.reap(queue_of(spark, d), 86400, at("2024-01-16 00:00:00")).select("id", "status", "attempts", "claimed_by")


@query("sync_state_upsert", "WITH l AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts DESC, event_id DESC) AS rn, event_id % 2 AS half FROM events), n AS (SELECT * FROM l WHERE rn = 1 AND half = 1), o AS (SELECT * FROM l WHERE rn = 1 AND half = 0) SELECT user_id, event_id FROM n UNION ALL SELECT user_id, event_id FROM o WHERE user_id NOT IN (SELECT user_id FROM n)")
def sync_state_upsert(spark, d):
    e = V.table(spark, d, "events").withColumn("half", F.col("event_id") % 2)
    last = R.top(e, ["user_id", "half"], [F.desc("ts"), F.desc("event_id")], 1)
    return Q.upsert(last.where("half = 0").select("user_id", "event_id"), last.where("half = 1").select("user_id", "event_id"), "user_id")


@query("failure_streaks", f"WITH j AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts, id) - row_number() OVER (PARTITION BY source_id, status = 'dead' ORDER BY ts, id) AS g FROM ({JOBS})) SELECT source_id, count(*) AS streak, min(id) AS first_id FROM j WHERE status = 'dead' GROUP BY source_id, g")
def failure_streaks(spark, d):
    return Q.failure_streaks(jobs_of(spark, d))


@query("scoped_replace_merge", "SELECT doc_id, source, CASE WHEN source = 'src1' THEN 1 ELSE length(text) END AS n FROM documents")
def scoped_replace_merge(spark, d):
    docs = docs_of(spark, d).select("doc_id", "source", F.length("text").cast("long").alias("n"))
    s = T.Store(spark, V.scratch(spark, "store"))
    s.commit({"documents": docs})
    s.replace_scope("documents", F.col("source") == "src1", docs.where("source = 'src1'").withColumn("n", F.lit(1).cast("long")))
    return s.read("documents")


@query("store_merge", "SELECT doc_id, CASE WHEN lang = 'de' THEN 'updated' WHEN lang = 'fr' THEN 'upserted' ELSE source END AS source FROM documents WHERE lang <> 'es' UNION ALL SELECT doc_id + 1000000000, 'upserted' FROM documents WHERE lang = 'fr'")
def store_merge(spark, d):
    docs = docs_of(spark, d).select("doc_id", "source", "lang")
    s = T.Store(spark, V.scratch(spark, "store"))
    s.commit({"t": docs.drop("lang")})
    s.delete("t", F.col("doc_id").isNull())
    s.commit({"t": docs.where("lang <> 'es'").drop("lang")})
    other = F.col("doc_id") + 1_000_000_000
    s.update("t", docs.where("lang = 'de'").select("doc_id", F.lit("updated").alias("source")).unionByName(docs.where("lang = 'de'").select(other.alias("doc_id"), F.lit("unknown").alias("source"))), ["doc_id"])
    s.upsert("t", docs.where("lang = 'fr'").select(F.explode(F.array("doc_id", other)).alias("doc_id"), F.lit("upserted").alias("source")), ["doc_id"])
    return s.read("t")


@query("version_history_tags", """WITH n AS (SELECT (SELECT count(*) FROM documents) AS docs, (SELECT count(*) FROM benchmark) AS items, (SELECT count(*) FROM labels) AS labels)
SELECT v.*, CASE WHEN version IN (1, 4) THEN docs WHEN version = 2 THEN items ELSE items + labels END AS n_rows FROM n, (VALUES ('a', 4, 'restore start', ''), ('a', 3, 'more', 'before-restore'), ('a', 2, 'replaced', ''), ('a', 1, 'first', 'start'), ('b', 1, 'first', 'start')) v(table_name, version, note, tags)
WHERE table_name = 'a' UNION ALL SELECT 'b', 1, 'first', 'start', docs FROM n""")
def version_history_tags(spark, d):
    s = T.Store(spark, V.scratch(spark, "store"))
    docs, items, labels = (V.table(spark, d, t).select(F.col(c).alias("id")) for t, c in (("documents", "doc_id"), ("benchmark", "item_id"), ("labels", "doc_id")))
    s.commit({"a": docs, "b": docs}, note="first")
    s.tag("start")
    s.commit({"a": items}, note="replaced")
    s.commit(append={"a": labels}, note="more")
    s.restore("start")
    s.vacuum(3600)
    h = s.history()
    sizes = None
    for r in h.select("table_name", "version").collect():
        n = s.read(r["table_name"], r["version"]).agg(F.count("*").alias("n_rows")).select(F.lit(r["table_name"]).alias("table_name"), F.lit(r["version"]).cast("long").alias("version"), "n_rows")
        sizes = n if sizes is None else sizes.unionByName(n)
    tags = F.array_join(F.transform("tags", lambda t: F.regexp_replace(t, "^before-restore-.*", "before-restore")), ",")
    return h.join(sizes, ["table_name", "version"]).select("table_name", F.col("version").cast("int").alias("version"), "note", tags.alias("tags"), "n_rows")


@query("centroids", "SELECT label, i, round(sum(CAST(x AS DOUBLE)) / count(*), 5) AS mean, count(*) AS n FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0) GROUP BY label, i")
def centroids(spark, d):
    x = I.centroids(vectors_of(spark, d)).select("label", F.posexplode("embedding").alias("i", "x"), "n")
    return x.select("label", F.col("i").cast("long").alias("i"), F.round("x", 5).alias("mean"), "n")


@query("content_hash_dups", "SELECT md5(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def content_hash_dups(spark, d):
    return docs_of(spark, d).groupBy(F.md5("text").alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("metric_retrieval", f"""WITH run AS ({BM25}), rel AS (SELECT item_id AS query_id, doc_id FROM documents d, benchmark b WHERE b.text <> '' AND contains(d.text, b.text)),
n AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY query_id),
hit AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM run JOIN rel USING (query_id, doc_id)),
per AS (SELECT query_id, sum(nth / CAST(rank AS DOUBLE)) AS s, sum(CASE WHEN rank <= 3 THEN 1 ELSE 0 END) AS h, sum(CASE WHEN rank <= 3 THEN 1 / log2(CAST(rank AS DOUBLE) + 1) ELSE 0 END) AS g FROM hit GROUP BY query_id)
SELECT query_id, round(coalesce(s / n_rel, 0), 6) AS ap, round(CAST(coalesce(h / CAST(n_rel AS DOUBLE), 0) AS DOUBLE), 6) AS recall,
  round(coalesce(g / list_sum(list_transform(range(1, least(n_rel, 3) + 1), lambda r: 1 / log2(CAST(r AS DOUBLE) + 1))), 0), 6) AS ndcg FROM n LEFT JOIN per USING (query_id)""")
def metric_retrieval(spark, d):
    run = R.bm25(docs_of(spark, d), bench_queries(spark, d), 5)
    rel = R.phrase_match(docs_of(spark, d), V.table(spark, d, "benchmark")).withColumnRenamed("item_id", "query_id")
    return M.ranked_metrics(run, rel, 3)


@query("conversation_rates", "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS convs, round(avg(length(text)), 6) AS mean_chars FROM conversations GROUP BY role")
def conversation_rates(spark, d):
    return V.table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("convs"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))


@query("conversation_group", "SELECT conv_id, count(*) AS n, array_to_string(list(role ORDER BY turn, role), '>') AS roles FROM conversations GROUP BY conv_id")
def conversation_group(spark, d):
    g = V.table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return g.select("conv_id", "n", F.array_join(F.transform("r", lambda x: x["role"]), ">").alias("roles"))


@query("migration_key_rename", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'kept' ELSE json_extract_string(props, '$.k') END AS canonical_k, 1 AS n_keys FROM events WHERE props LIKE '%\"k\"%'")
def migration_key_rename(spark, d):
    props = F.from_json("props", "map<string, string>")
    both = X.merge_maps(props, F.when(F.col("event_type") == "view", F.create_map(F.lit("canonical_k"), F.lit("kept"))))  # where both keys stand, the canonical one wins
    m = V.table(spark, d, "events").where(F.col("props").like('%"k"%')).select("event_id", X.rename_keys(both, {"k": "canonical_k"}).alias("m"))
    return m.select("event_id", F.col("m")["canonical_k"].alias("canonical_k"), F.size("m").alias("n_keys"))


def _line(name, severity, ids):
    return f"""SELECT '{name}' AS name, CASE WHEN count(*) = 0 THEN 'ok' ELSE '{severity}' END AS severity, count(*) AS n,
    coalesce(string_agg(x, ', ' ORDER BY x) FILTER (WHERE r <= 5), '') || CASE WHEN count(*) > 5 THEN ' ... (+' || (count(*) - 5) || ' more)' ELSE '' END AS details
    FROM (SELECT x, row_number() OVER (ORDER BY x) AS r FROM (SELECT CAST({ids}))"""


LABELLED = f"(SELECT doc_id, position, '#/texts/' || position AS ref, label FROM ({ITEMS}))"
REPORT = " UNION ALL ".join([
    _line("documents without metadata", "fail", "doc_id AS VARCHAR) AS x FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    _line("metadata without documents", "fail", "doc_id AS VARCHAR) AS x FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"),
    _line("chunks without documents", "warn", "vec_id AS VARCHAR) AS x FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)"),
    _line("items without documents", "warn", "doc_id AS VARCHAR) AS x FROM documents WHERE false"),
    _line("chunked documents without items", "warn", "doc_id AS VARCHAR) AS x FROM documents WHERE text IS NULL AND doc_id IN (SELECT vec_id FROM embeddings)"),
    _line("chunks with dangling references", "warn", f"vec_id AS VARCHAR) AS x FROM embeddings WHERE NOT EXISTS (SELECT 1 FROM {LABELLED} i WHERE i.doc_id = vec_id AND ref = '#/texts/' || embeddings.label)"),
    _line("vectors of another size", "fail", "vec_id AS VARCHAR) AS x FROM embeddings WHERE len(embedding) <> 64"),
    _line("chunks without an embedding", "warn", "vec_id AS VARCHAR) AS x FROM embeddings WHERE list_max(list_transform(embedding, lambda x: abs(x))) = 0"),
    _line("pictures without bytes", "warn", "doc_id AS VARCHAR) AS x FROM documents WHERE false"),
])


@query("integrity_report", REPORT)
def integrity_report(spark, d):
    docs = docs_of(spark, d)
    items = V.items(docs).withColumn("self_ref", F.concat(F.lit("#/texts/"), F.col("position").cast("string")))
    chunks = vectors_of(spark, d).select(F.col("vec_id").alias("id"), F.col("vec_id").alias("document_id"), F.array(F.concat(F.lit("#/texts/"), F.col("label").cast("string"))).alias("refs"), F.col("embedding").alias("vector"))
    return I.report(docs.select("doc_id"), V.table(spark, d, "labels").select("doc_id"), chunks, items, 64)
