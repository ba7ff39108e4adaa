"""Named queries on evaluation, chunking, the vector index and hybrid search; see ``registry`` for the others."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import scalars as X
from lodestone.functions import views as V
from lodestone.operators import chunking as K
from lodestone.operators import evaluation as E
from lodestone.operators import integrity as I
from lodestone.operators import queue as Q
from lodestone.operators import quantised_index as QI
from lodestone.operators import retrieval as R
from lodestone.operators import similarity as SJ
from lodestone.operators import structure as S
from lodestone.operators import vector_index as VI
from lodestone.plans.corpus_queries import NEAR, NV, PAIRS, rows_only
from lodestone.plans.registry import BM25, CHUNKS, DIST, ITEMS, JOBS, META, QUERIES, SQL, VECTOR, bench_queries, docs_of, jobs_of, query, vectors_of
from lodestone.sources import store as T


@query("metric_means", f"""WITH m AS ({SQL["metric_retrieval"]}) SELECT metric, round(avg(v), 6) AS mean, count(*) AS n FROM (SELECT unnest(['ap', 'recall', 'ndcg']) AS metric, unnest([ap, recall, ndcg]) AS v FROM m) GROUP BY metric""")
def metric_means(spark, d):
    scores = QUERIES["metric_retrieval"](spark, d).unpivot("query_id", ["ap", "recall", "ndcg"], "metric", "value")
    return E.metric_means(scores.withColumn("metric", F.concat(F.upper("metric"), F.lit("Evaluator"))))


@query("case_subset", f"SELECT id, uri FROM ({META}) WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def case_subset(spark, d):
    bad = V.table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").cast("string").alias("id"))
    return E.only_cases(V.meta(docs_of(spark, d)), bad).select("id", "uri")


@query("pictured_samples", "SELECT event_id FROM events WHERE CASE event_type WHEN 'view' THEN 'text-image' WHEN 'click' THEN 'image' ELSE 'text' END LIKE '%image%'")
def pictured_samples(spark, d):
    kind = F.expr("CASE event_type WHEN 'view' THEN 'text-image' WHEN 'click' THEN 'image' ELSE 'text' END")
    return E.only_pictured(V.table(spark, d, "events").withColumn("source_type", kind)).select("event_id")


@query("relevant_of_cases", """WITH c AS (SELECT conv_id, turn, role, 'q' || length(text) % 50 AS question FROM conversations),
s AS (SELECT 'q' || n_chars % 45 AS question, arg_max(doc_id, doc_id) AS relevant FROM documents WHERE lang IS DISTINCT FROM 'de' GROUP BY ALL) SELECT conv_id, turn, role, question, relevant FROM c LEFT JOIN s USING (question)""")
def relevant_of_cases(spark, d):
    name = lambda c, n: F.concat(F.lit("q"), (c % n).cast("string"))
    cases = V.table(spark, d, "conversations").select("conv_id", "turn", "role", name(F.length("text"), 50).alias("question"))
    samples = docs_of(spark, d).select(name(F.col("n_chars"), 45).alias("question"), F.array("doc_id").alias("uris"), F.col("doc_id").alias("seq"), (F.col("lang") == "de").alias("skip"))
    return E.attach_relevant(cases, samples).select("conv_id", "turn", "role", "question", F.get("relevant_uris", F.lit(0)).alias("relevant"))


@query("resume_plan", f"""SELECT id, action, CASE WHEN action = 'replace' THEN id END AS old_id FROM (SELECT id, CASE WHEN doc_id NOT IN (SELECT doc_id FROM labels) THEN 'import' WHEN doc_id IN (SELECT vec_id FROM embeddings) THEN 'skip' ELSE 'replace' END AS action FROM ({META}))""")
def resume_plan(spark, d):
    all_docs = V.meta(docs_of(spark, d)).select("id", "uri")
    known = all_docs.join(V.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id")), "id", "left_semi")
    chunks = vectors_of(spark, d).select(F.col("vec_id").cast("string").alias("document_id"))
    return E.resume_plan(all_docs, known, chunks).select("id", "action", "old_id")


LABEL = "CASE conv_id % 3 WHEN 0 THEN 'ANSWERABLE' WHEN 1 THEN 'UNANSWERABLE' ELSE 'PARTIAL' END"
#: Judged turns of an assistant; a long text passes, and every second turn has relevant documents.
JUDGED = {"passed": "length(text) > 80", "label": LABEL, "refused": "length(text) % 5 = 0", "cited_ap": "CASE WHEN turn % 4 = 1 THEN CAST(length(text) % 3 AS DOUBLE) / 2 END"}
TURNS = f"""SELECT conv_id, turn, {", ".join(f"{v} AS {k}" for k, v in JUDGED.items())} FROM conversations WHERE role = 'assistant'"""


@query("turn_rates", f"""WITH t AS (SELECT *, 'turn_' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, CASE WHEN label <> 'PARTIAL' THEN refused END AS r FROM ({TURNS})),
keys AS (SELECT conv_id, string_agg(k || '=' || v, ',' ORDER BY k) AS keys FROM (SELECT conv_id, k || '_pass' AS k, CAST(passed AS VARCHAR) AS v FROM t UNION ALL SELECT conv_id, k || '_refused', CAST(r AS VARCHAR) FROM t UNION ALL SELECT conv_id, k || '_cited_ap', CAST(cited_ap AS VARCHAR) FROM t) WHERE v IS NOT NULL GROUP BY conv_id)
SELECT g.*, coalesce(keys, '') AS keys FROM (SELECT conv_id, count(*) FILTER (WHERE passed) AS turns_passed, count(passed) AS turns_judged, count(*) AS turns_total, count(cited_ap) AS cited_eligible, round(avg(cited_ap), 6) AS cited_map,
count(*) FILTER (WHERE r AND label = 'UNANSWERABLE') AS true_refusals, count(*) FILTER (WHERE r AND label <> 'UNANSWERABLE') AS false_refusals, count(r) FILTER (WHERE label = 'UNANSWERABLE') AS unanswerable_turns,
round(coalesce(count(*) FILTER (WHERE passed) / nullif(CAST(count(passed) AS DOUBLE), 0), 0), 6) AS turn_pass_rate FROM t GROUP BY conv_id) g LEFT JOIN keys USING (conv_id)""")
def turn_rates(spark, d):
    t = V.table(spark, d, "conversations").where("role = 'assistant'")
    rates = E.turn_rates(t.select("conv_id", "turn", *[F.expr(v).alias(k) for k, v in JUDGED.items()]))
    pairs = F.array_sort(F.transform(F.map_entries("keys"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return rates.withColumn("keys", F.array_join(pairs, ","))


@query("tool_traffic", """SELECT user_id AS run, count(*) FILTER (WHERE event_type = 'click' AND event_id % 3 = 0) AS n_search_calls, count(*) FILTER (WHERE event_type = 'error' AND event_id % 3 = 0) AS n_rejected_searches,
count(*) FILTER (WHERE event_type IN ('error', 'signup') AND event_id % 3 < 2) AS n_failed_tools, count(*) FILTER (WHERE event_type NOT IN ('error', 'signup')) AS n_requests FROM events GROUP BY user_id""")
def tool_traffic(spark, d):
    e = V.table(spark, d, "events")
    kind = F.expr("CASE event_type WHEN 'click' THEN 'call' WHEN 'error' THEN 'return' WHEN 'signup' THEN 'retry' END")
    tool = F.element_at(F.array(*[F.lit(x) for x in ("rag_search", "rag_cite", "host_tool")]), (F.col("event_id") % 3 + 1).cast("int"))
    side = F.when(F.col("event_type").isin("error", "signup"), "request").otherwise("response")
    parts = e.select(F.col("user_id").alias("run"), F.col("event_id").alias("message"), side.alias("side"), kind.alias("kind"), tool.alias("tool"), F.when(F.col("event_type") == "error", "failed").alias("outcome"))
    return E.tool_traffic(parts, "rag", ["rag_search", "rag_cite"])


@query("submission_rows", f"""WITH r AS ({BM25}), q AS (SELECT text, min(item_id) AS query_id FROM benchmark GROUP BY text), l AS (SELECT text, string_agg(doc_id, ',' ORDER BY rank) AS ids FROM r JOIN q USING (query_id) WHERE rank <= 3 GROUP BY text)
SELECT item_id AS id, 'all' AS subset, coalesce(ids, '') AS context_id, CASE WHEN item_id % 4 = 0 THEN CAST(item_id AS VARCHAR) ELSE CAST(1000 + item_id AS VARCHAR) END AS prediction FROM benchmark LEFT JOIN l USING (text)""")
def submission_rows(spark, d):
    items = V.table(spark, d, "benchmark")
    i = F.col("item_id")
    said = F.when(i % 4 == 0, F.concat(F.lit("Of 7.\nAnswer: $"), i.cast("string"), F.lit(" million"))).otherwise(F.concat(F.lit("about 1,"), F.lpad(i.cast("string"), 3, "0"), F.lit(" in all")))
    said = F.when((i % 4 != 0) & (i > 999), (1000 + i).cast("string")).otherwise(said)
    first = items.groupBy(F.col("text").alias("question")).agg(F.min("item_id").alias("query_id"))
    hits = R.bm25(docs_of(spark, d), bench_queries(spark, d), 5).join(first, "query_id").select("question", F.col("doc_id").alias("context_id"), "rank")
    rows = E.submission_rows(items.select(i.alias("id"), F.col("text").alias("question"), said.alias("output")), hits, "all", X.submission(F.col("output")), 3)
    return rows.withColumn("context_id", F.array_join(F.col("context_id").cast("array<string>"), ","))


@rows_only("nearest_ids")
def nearest_ids(spark, d):
    """Ids of a conversation's turns, damaged by a dropped and a doubled character, against all of that conversation."""
    t = V.table(spark, d, "conversations").select("conv_id", "turn", "role", F.md5(F.concat_ws("/", "conv_id", "turn", "role")).alias("id"))
    known = t.groupBy("conv_id").agg(F.sort_array(F.collect_set("id")).alias("known"))
    damaged = F.when(F.col("turn") == 0, F.col("id")).otherwise(F.concat(F.substring("id", 1, 7), F.substring("id", 9, 12), F.substring("id", 20, 13)))
    return E.nearest_ids(t.join(known, "conv_id").withColumn("chunk_id", damaged)).select("conv_id", "turn", "role", "id", "chunk_id", "known", "resolved")


@query("citation_policy", """WITH u AS (SELECT conv_id AS conv, max(turn) AS last, min(turn) AS first FROM conversations WHERE role = 'user' GROUP BY conv_id),
a AS (SELECT conv, last, max(turn) FILTER (WHERE turn > last AND length(text) % 3 = 0) AS e, max(turn) FILTER (WHERE turn > last AND length(text) % 3 = 1) AS c, coalesce(bool_or(turn > first AND length(text) % 3 = 1), false) AS cites FROM u JOIN conversations ON conv = conv_id AND role = 'assistant' GROUP BY ALL),
s AS (SELECT u.conv, u.last + 1 AS question, u.last, coalesce(e IS NOT NULL OR cites, false) AND NOT (c IS NOT NULL AND c > coalesce(e, -1)) AS owed FROM u LEFT JOIN a USING (conv))
SELECT conv, question, CASE WHEN NOT owed OR last = 2 THEN 'none' WHEN conv % 4 <> 0 THEN 'redirect' ELSE 'violation' END AS action, owed AS violated FROM s""")
def citation_policy(spark, d):
    t = V.table(spark, d, "conversations").where("role = 'user' or (role = 'assistant' and length(text) % 3 < 2)")
    at = F.col("turn") + 1
    kind = F.when(F.col("role") == "user", "begin").when(F.length("text") % 3 == 0, "evidence").otherwise("declare")
    e = t.select(F.col("conv_id").alias("conv"), F.lit("rag").alias("capability"), F.col("turn").alias("seq"), kind.alias("kind"), at.alias("question"), at.alias("epoch"), F.array(F.md5("text")).alias("chunk_ids"))
    begun = F.min(F.when(F.col("kind") == "begin", F.col("seq"))).over(Window.partitionBy("conv"))
    e = e.withColumn("_b", begun).where("seq >= _b").drop("_b")
    asked = e.where("kind = 'begin' and seq = 2").select("conv", "question")
    return E.citation_policy(e, asked, e.where("conv % 4 <> 0").select("conv"))


TITLED = f"""SELECT doc_id, position, text, CASE WHEN label = 'section_header' AND length(text) <= 25 THEN 'title' ELSE label END AS label, CASE WHEN length(text) <= 12 THEN 'furniture' ELSE 'body' END AS layer FROM ({ITEMS})"""


@query("structural_title", f"""SELECT doc_id, title FROM (SELECT doc_id, coalesce(arg_max(trim(text), position) FILTER (WHERE label = 'title' AND layer = 'furniture'), arg_min(trim(text), position) FILTER (WHERE label = 'title' AND layer = 'body'),
arg_min(trim(text), position) FILTER (WHERE label = 'section_header')) AS title FROM ({TITLED}) WHERE label IN ('title', 'section_header') AND trim(text) <> '' GROUP BY doc_id)""")
def structural_title(spark, d):
    n = F.length("text")
    label = F.when((F.col("label") == "section_header") & (n <= 25), "title").otherwise(F.col("label"))
    return S.structural_title(V.items(docs_of(spark, d)).withColumns({"layer": F.when(n <= 12, "furniture").otherwise("body"), "label": label}))


@query("citation_texts", f"""SELECT doc_id, md5('## Citations' || chr(10) || chr(10) || string_agg(t, chr(10) ORDER BY ord)) AS text_md5 FROM (SELECT doc_id, ord,
'[' || (ord + 1) || '] ' || CASE WHEN ord = 0 THEN uri ELSE title END || ' ' || uri || CASE ord % 3 WHEN 0 THEN ' - p. 1, Section: ' || lang WHEN 1 THEN ' - pp. 1-3' ELSE '' END || chr(10) ||
CASE WHEN ord % 2 = 1 THEN '[Figure: #/pictures/' || ord || ']' || chr(10) ELSE '' END || content || chr(10) AS t FROM ({CHUNKS}) JOIN ({META}) USING (doc_id)) GROUP BY doc_id""")
def citation_texts(spark, d):
    docs, o = docs_of(spark, d), F.col("ord")
    c = V.chunks(docs).join(V.meta(docs), "doc_id")
    pages = F.when(o % 3 == 0, F.array(F.lit(1))).when(o % 3 == 1, F.array(*map(F.lit, (1, 2, 3))))
    pictures = F.when(o % 2 == 1, F.array(F.concat(F.lit("#/pictures/"), o.cast("string"))))
    one = X.citation_text(o + 1, F.when(o > 0, F.col("title")), F.col("uri"), pages, F.when(o % 3 == 0, F.array("source", "lang")), pictures, F.col("content"))
    g = c.select("doc_id", "ord", one.alias("t")).where("t is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "t"))).alias("a"))
    return g.select("doc_id", F.md5(X.cited_texts(F.transform("a", lambda s: s["t"]))).alias("text_md5"))


@query("meta_options", "SELECT event_id, json(props) AS p, to_json(event_type || '=x') AS t, CAST(event_id AS VARCHAR) AS n, '\"\"' AS e FROM events")
def meta_options(spark, d):
    o = lambda k, c: F.concat(F.lit(f"{k}="), c)
    m = X.meta_options(F.array(o("n", F.lit("first")), o("p", F.col("props")), o("t", F.concat("event_type", F.lit("=x"))), F.lit("e="), o("n", F.col("event_id").cast("string"))))
    return V.table(spark, d, "events").select("event_id", m.alias("m")).select("event_id", *[F.col("m")[k].alias(k) for k in "pten"])


@query("data_uris", "SELECT doc_id, 'data:image/png;base64,' || to_base64(encode(coalesce(text, ''))) = uri AS same, md5(uri) AS uri_md5, octet_length(encode(coalesce(text, ''))) AS n FROM (SELECT doc_id, text, 'data:image/png;base64,' || to_base64(encode(coalesce(text, ''))) AS uri FROM documents)")
def data_uris(spark, d):
    data = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    u = docs_of(spark, d).select("doc_id", data.alias("data"), X.data_uri(data).alias("uri"))
    back = X.decoded_uri(F.col("uri"))
    return u.select("doc_id", (back == F.col("data")).alias("same"), F.md5("uri").alias("uri_md5"), F.octet_length(back).cast("long").alias("n"))


@query("documents_page", f"SELECT id, title, 2 AS page, CAST(greatest(ceil((SELECT count(*) FROM documents) / 50.0), 1) AS BIGINT) AS total_pages, (SELECT count(*) FROM documents) AS total_documents FROM ({META}) ORDER BY id LIMIT 50 OFFSET 50")
def documents_page(spark, d):
    return T.document_page(V.meta(docs_of(spark, d)).select("id", "title"), 2)


@query("migration_split", f"SELECT id, title, coalesce(lang, '{{}}') AS lang FROM ({META}) WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def migration_split(spark, d):
    done = V.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return T.split_columns(V.meta(docs_of(spark, d)), done, ["title", "lang", "gone"], {"lang": "{}"})[0]


@query("drain_report", f"""WITH j AS (SELECT * FROM ({JOBS}) WHERE status IN ('queued', 'claimed') OR ts >= TIMESTAMP '2024-01-10'), n AS (SELECT count(*) FILTER (WHERE status = 'succeeded') AS succeeded, count(*) FILTER (WHERE status = 'dead') AS dead,
count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'claimed') AS claimed FROM j) SELECT greatest(100, succeeded + dead + queued + claimed) AS total, succeeded + dead AS completed, * FROM n""")
def drain_report(spark, d):
    jobs = jobs_of(spark, d).withColumn("completed_at", F.when(~Q.live(), F.col("ts")))
    return Q.drain_report(jobs, F.expr("timestamp_ntz'2024-01-10 00:00:00'"), 100)


@query("source_stats", f"""SELECT source_id, count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'claimed') AS claimed, count(*) FILTER (WHERE status = 'dead') AS dead,
{", ".join(f"count(*) FILTER (WHERE status = 'succeeded' AND ts >= TIMESTAMP '2024-01-20' - INTERVAL {s} SECOND) AS done_{n}" for s, n in ((300, "5m"), (1800, "30m"), (3600, "1h")))},
CAST(trunc(epoch_us(TIMESTAMP '2024-01-20') / 1e6 - epoch_us(min(ts) FILTER (WHERE status = 'queued')) / 1e6) AS BIGINT) AS oldest_s FROM ({JOBS}) GROUP BY source_id""")
def source_stats(spark, d):
    jobs = jobs_of(spark, d).withColumns({"completed_at": F.when(~Q.live(), F.col("ts")), "scheduled_at": F.col("ts")})
    return Q.source_stats(jobs, F.expr("timestamp_ntz'2024-01-20 00:00:00'"))


@query("duplicate_export", f"""WITH RECURSIVE {NV}, p AS ({PAIRS}), e AS (SELECT a, b, similarity FROM p UNION ALL SELECT b, a, similarity FROM p), r AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
c AS (SELECT id, min(root) AS family FROM r GROUP BY id), n AS (SELECT doc_id AS id, CAST(ceil(len(string_split(text, ' ')) / 50.0) AS BIGINT) AS n FROM documents),
m AS (SELECT c.family, c.id, coalesce(n, 0) AS n, (SELECT round(max(similarity), 3) FROM e WHERE e.a = c.id) AS similarity FROM c LEFT JOIN n USING (id)),
k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, id) = 1 AS keep FROM m)
SELECT family, CAST(max(id) FILTER (WHERE keep) AS BIGINT) AS keep, string_agg(id || ':' || n || ':' || similarity || ':' || keep, ',' ORDER BY id) AS members FROM k GROUP BY family""")
def duplicate_export(spark, d):
    docs = docs_of(spark, d)
    counts = docs.select(F.col("doc_id").alias("id"), F.ceil(F.size(F.split("text", " ")) / 50).alias("n")).where("n > 0")
    blocks = I.family_blocks(I.families(V.stored(SJ.near_edges(vectors_of(spark, d), NEAR), "near-edges"), counts), counts, V.meta(docs).select(F.col("doc_id").alias("id"), F.col("uri").alias("label")))
    told = F.from_json("block", "group long, keep long, documents array<struct<document_id: long, document: string, chunks: long, similarity: double, keep_suggested: boolean>>")
    members = F.transform("b.documents", lambda m: F.concat_ws(":", m["document_id"], m["chunks"], m["similarity"], m["keep_suggested"]))
    return blocks.select("family", told.alias("b")).select("family", F.col("b.keep").alias("keep"), F.array_join(members, ",").alias("members"))


HYBRID_ROOM = 64


@query("hybrid_chunks", f"""WITH RECURSIVE i AS (SELECT *, CAST(count(*) FILTER (WHERE label = 'section_header') OVER w AS INTEGER) AS section, last_value(CASE WHEN label = 'section_header' THEN text END IGNORE NULLS) OVER w AS heading FROM ({ITEMS}) WINDOW w AS (PARTITION BY doc_id ORDER BY position ROWS UNBOUNDED PRECEDING)),
t AS (SELECT *, list_filter(string_split(text, ' '), lambda x: x <> '') AS w, greatest({HYBRID_ROOM} - coalesce(len(list_filter(string_split(heading, ' '), lambda x: x <> '')), 0), 1) AS room FROM i WHERE label <> 'section_header' AND trim(text) <> ''),
c AS (SELECT *, unnest(range(0, greatest(CAST(ceil(len(w) / CAST(room AS DOUBLE)) AS BIGINT), 1))) AS piece FROM t),
p AS (SELECT doc_id, section, position, room, len(w[piece * room + 1:piece * room + room]) AS n, CASE WHEN len(w) <= room THEN text ELSE array_to_string(w[piece * room + 1:piece * room + room], ' ') END AS text, row_number() OVER (PARTITION BY doc_id, section ORDER BY position, piece) AS rn FROM c),
r AS (SELECT doc_id, section, rn, n AS used, 0 AS part FROM p WHERE rn = 1 UNION ALL SELECT p.doc_id, p.section, p.rn, CASE WHEN r.used + p.n <= p.room THEN r.used + p.n ELSE p.n END, CASE WHEN r.used + p.n <= p.room THEN r.part ELSE r.part + 1 END FROM r JOIN p ON p.doc_id = r.doc_id AND p.section = r.section AND p.rn = r.rn + 1)
SELECT doc_id, section, part, CAST(sum(n) AS BIGINT) AS n_tokens, min(position) AS first_pos, max(position) AS last_pos, count(DISTINCT position) AS n_refs, md5(string_agg(text, chr(10) ORDER BY rn)) AS content_md5 FROM r JOIN p USING (doc_id, section, rn) GROUP BY ALL""")
def hybrid_chunks(spark, d):
    i = V.items(docs_of(spark, d)).withColumn("self_ref", F.concat(F.lit("#/texts/"), F.col("position").cast("string")))
    c = K.hybrid_chunks(i, HYBRID_ROOM)
    longs = [F.col(x).cast("long").alias(x) for x in ("n_tokens", "first_pos", "last_pos")]
    return c.select("doc_id", "section", "part", *longs, F.size("refs").cast("long").alias("n_refs"), F.md5("content").alias("content_md5"))


@query("vector_index_topk", VECTOR)
def vector_index_topk(spark, d):
    v = vectors_of(spark, d)
    index = VI.build(v.select("vec_id", "embedding"), V.scratch(spark, "vector-index"))
    return VI.search(index, v.where("vec_id % 100 = 0"), 10)


@rows_only("vector_pq_topk")
def vector_pq_topk(spark, d):
    """Three quarters of the lists are read: these vectors are random, so a query's neighbours lie in many lists."""
    v = vectors_of(spark, d)
    index = QI.build(v.select("vec_id", "embedding"), V.scratch(spark, "quantised-index"))
    return QI.search(index, v.where("vec_id % 100 = 0"), 10, probes=None if index.centres is None else -(-3 * len(index.centres) // 4))


#: First words of the documents that are asked for beside the vectors of the same id.
ASKED = "SELECT vec_id AS query_id, array_to_string(string_split(text, ' ')[1:6], ' ') AS query FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 100 = 0"
ASKED_BM25 = BM25.replace("item_id AS query_id", "query_id").replace("lower(text), '[^a-z0-9]+'), lambda x: x <> ''))) AS term FROM benchmark", f"lower(query), '[^a-z0-9]+'), lambda x: x <> ''))) AS term FROM ({ASKED})").replace("rank <= 5", "rank <= 10")


@query("hybrid_search", f"""WITH v AS ({VECTOR}), f AS ({ASKED_BM25}), s AS (SELECT query_id, doc_id, round(sum(1 / (CAST(60 AS DOUBLE) + rank)), 6) AS score FROM (SELECT query_id, vec_id AS doc_id, rank FROM v UNION ALL SELECT query_id, doc_id, rank FROM f) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def hybrid_search(spark, d):
    v, docs = vectors_of(spark, d), docs_of(spark, d)
    asked = v.where("vec_id % 100 = 0")
    words = asked.select(F.col("vec_id").alias("doc_id")).join(docs, "doc_id").select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("query"))
    near = R.vector_search(v, asked, 10).withColumnRenamed("vec_id", "doc_id")
    return R.fuse([near, R.bm25(docs, words, 10)], "doc_id", 10)


@query("store_checks", """SELECT 'settings row' AS name, CASE WHEN count(*) = 1 THEN 'ok' ELSE 'fail' END AS severity, count(*) AS n, '' AS details FROM region WHERE r_regionkey = 1
UNION ALL SELECT 'embedding drift', 'warn', 1, 'provider: ' || r_name || ' -> local' FROM region WHERE r_regionkey = 1
UNION ALL SELECT 'pending migrations', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warn' END, count(*), coalesce(string_agg('0.' || n_nationkey || '.0: ' || n_name, ', ' ORDER BY n_nationkey), '') FROM nation WHERE n_nationkey > 9
UNION ALL SELECT 'vector index', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warn' END, count(*), '' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)""")
def store_checks(spark, d):
    """A region as the settings of a store, nations as its migrations, and an index of the labelled vectors."""
    key = F.col("r_regionkey").cast("string")
    settings = V.table(spark, d, "region").select(F.when(key == "1", "settings").otherwise(key).alias("id"), F.col("r_name").alias("provider"), F.lit(None).cast("string").alias("name"), F.lit(64).alias("vector_dim"), F.lit("0.9.0").alias("version"))
    steps = V.table(spark, d, "nation").select(F.concat(F.lit("0."), F.col("n_nationkey").cast("string"), F.lit(".0")).alias("version"), F.col("n_name").alias("description"))
    return I.store_checks(settings, {"provider": "local", "name": "m", "vector_dim": 64}, steps, vectors_of(spark, d).select(F.col("vec_id").alias("id")), V.table(spark, d, "labels").select(F.col("doc_id").alias("id")))
