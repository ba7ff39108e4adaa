"""Named queries on context, evidence, duplicates and numbers; see ``registry`` for the others."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import scalars as X
from lodestone.functions import views as V
from lodestone.operators import context as C
from lodestone.operators import integrity as I
from lodestone.operators import ledger as L
from lodestone.operators import metrics as M
from lodestone.operators import queue as Q
from lodestone.operators import retrieval as R
from lodestone.operators import similarity as SJ
from lodestone.operators import text_index as TI
from lodestone.plans.registry import BM25, ITEMS, QUERIES, VECTOR, bench_queries, docs_of, query, searched, vectors_of
from lodestone.sources import files

#: Cosine similarity from which the test vectors count as near; they hold no closer copies.
NEAR = 0.38
PAIRS = f"""SELECT * FROM (SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (a.n * b.n), 6) AS similarity
FROM nv a JOIN nv b ON a.vec_id < b.vec_id) WHERE similarity >= {NEAR}"""
NV = "nv AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings))"
LONG_REFS = f"SELECT doc_id, greatest(0, min(position) - 100) AS lo, max(position) + 100 AS hi FROM ({ITEMS}) WHERE length(text) > 300 GROUP BY doc_id"


def rows_only(name: str):
    """Register a query that SQL can't express."""

    def put(f):
        QUERIES[name] = f
        return f

    return put


def items_of(spark, d, found=None):
    """Items of the documents, or of those with rows in ``found``, with a reference each, and pages of ten lines."""
    docs = docs_of(spark, d)
    if found is not None:  # before the texts are cut into items
        docs = docs.join(V.sized(found.select("doc_id").distinct()), "doc_id", "left_semi")
    i = V.items(docs)
    return i.withColumns({"self_ref": F.concat(F.lit("#/texts/"), F.col("position").cast("string")), "pages": F.array((F.col("position") / 10).cast("int") + 1)})


def item_hits(spark, d):
    """Results for the context operators: the longest line of each document found by full-text search."""
    run = V.stored(R.bm25(docs_of(spark, d), bench_queries(spark, d), 5).select("query_id", "doc_id", "score", "rank"), "hits")  # read by many steps
    longest = R.top(items_of(spark, d, run), ["doc_id"], [F.desc(F.length("text")), "position"], 1).drop("rank")
    hits = run.join(longest, "doc_id")
    result = F.concat_ws("/", F.col("query_id").cast("string"), F.col("doc_id").cast("string"))
    return V.stored(hits.select("doc_id", result.alias("result_id"), F.col("rank").alias("seq"), "score", F.col("text").alias("content"), F.array("self_ref").alias("refs"), "pages", F.array("label").alias("labels")), "item-hits")


@query("text_index_topk", BM25)
def text_index_topk(spark, d):
    """An index of the documents as they were, some shorter and some not there yet, then updated to what they are."""
    docs = docs_of(spark, d).select("doc_id", "text")
    late, changed = F.col("doc_id") % 11 == 0, F.col("doc_id") % 7 == 0
    before = docs.where(~late).withColumn("text", F.when(changed, F.concat(F.substring("text", 1, 40), F.lit(" the old text"))).otherwise(F.col("text")))
    index = TI.build(before, V.scratch(spark, "text-index")).update(docs.where(late | changed))
    return TI.search(index, bench_queries(spark, d), 5).hits


@query("cosine_pairs_threshold", f"WITH {NV} {PAIRS}")
def cosine_pairs_threshold(spark, d):
    return SJ.near_pairs(vectors_of(spark, d), NEAR)


@query("near_duplicate_components", f"WITH RECURSIVE {NV}, p AS ({PAIRS}), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id) SELECT id, min(root) AS component FROM r GROUP BY id")
def near_duplicate_components(spark, d):
    return I.components(SJ.near_edges(vectors_of(spark, d), NEAR))


@query("multi_query_merge", f"SELECT doc_id, query_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY query_id, rank) AS rn FROM ({BM25})) WHERE rn = 1")
def multi_query_merge(spark, d):
    return R.first_seen(R.bm25(docs_of(spark, d), bench_queries(spark, d), 5), "doc_id", ["query_id", "rank"]).select("doc_id", "query_id", "rank")


@query("ranked_uri_dedup", f"SELECT query_id, label, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (SELECT r.*, e.label, row_number() OVER (PARTITION BY query_id, e.label ORDER BY rank) AS rn FROM ({VECTOR}) r JOIN embeddings e USING (vec_id)) WHERE rn = 1")
def ranked_uri_dedup(spark, d):
    hits = searched(spark, d).join(vectors_of(spark, d).select("vec_id", "label"), "vec_id")
    return R.distinct_ranked(hits, "label").select("query_id", "label", "score", "rank")


@query("rerank_overfetch", f"""WITH c AS ({BM25.replace("rank <= 5", "rank <= 50")}), t AS (SELECT query_id, doc_id, list_distinct(list_filter(string_split_regex(lower(b.text), '[^a-z0-9]+'), lambda x: x <> '')) AS q,
  list_distinct(list_filter(string_split_regex(lower(d.text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM c JOIN benchmark b ON b.item_id = c.query_id JOIN documents d USING (doc_id)),
s AS (SELECT query_id, doc_id, round(CAST(len(list_intersect(q, w)) AS DOUBLE) / len(q), 6) AS score FROM t)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5""")
def rerank_overfetch(spark, d):
    docs, queries = docs_of(spark, d), bench_queries(spark, d)
    return R.rerank(R.bm25(docs, queries, 50), docs, queries, 5)


@query("contextualize", f"SELECT doc_id, position, md5(CASE WHEN h IS NULL THEN text ELSE h || chr(10) || text END) AS content_md5 FROM (SELECT *, last_value(CASE WHEN label = 'section_header' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS h FROM ({ITEMS})) WHERE label = 'text'")
def contextualize(spark, d):
    order = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    i = V.items(docs_of(spark, d)).withColumn("h", F.last(F.when(F.col("label") == "section_header", F.col("text")), True).over(order)).where("label = 'text'")
    headings = F.when(F.col("h").isNotNull(), F.array("h"))
    return i.select("doc_id", F.col("position").cast("long").alias("position"), F.md5(X.contextualised(headings, F.col("text"))).alias("content_md5"))


@query("primary_label", f"SELECT doc_id, CASE WHEN bool_or(label = 'section_header') THEN 'section_header' ELSE arg_min(label, position) END AS label FROM ({ITEMS}) GROUP BY doc_id")
def primary_label(spark, d):
    g = V.items(docs_of(spark, d)).groupBy("doc_id", "label").agg(F.min("position").alias("p")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("p", "label"))).alias("a"))
    return g.select("doc_id", X.primary_label(F.transform("a", lambda s: s["label"])).alias("label"))


@query("resolve_ref_windows", f"SELECT i.doc_id, w.lo, w.hi, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM ({ITEMS}) i JOIN ({LONG_REFS}) w ON w.doc_id = i.doc_id AND i.position BETWEEN w.lo AND w.hi GROUP BY ALL")
def resolve_ref_windows(spark, d):
    items = items_of(spark, d)
    hits = items.where(F.length("text") > 300).select("doc_id", F.col("self_ref").alias("result_id"), F.array("self_ref").alias("refs"))
    near = C.in_ranges(items, C.windows(C.resolve(hits, items)))
    g = near.groupBy("doc_id", "lo", "hi").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))
    return g.withColumns({c: F.col(c).cast("long") for c in ("lo", "hi")})


#: Characters that an expanded result may have.
BUDGET = 3000
#: The walk from the longest line of each document found: an item below, then one above, turn by turn.
GROWTH = f"""run AS ({BM25}), items AS ({ITEMS}),
hit AS (SELECT doc_id, position, text AS content, label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, position) AS rn FROM items WHERE doc_id IN (SELECT doc_id FROM run)) WHERE rn = 1),
near AS (SELECT i.*, row_number() OVER d AS idx, count(*) FILTER (WHERE i.label = 'section_header') OVER d AS section, bool_or(i.label = 'section_header') OVER (PARTITION BY i.doc_id) AS structured
  FROM items i JOIN hit h ON h.doc_id = i.doc_id AND i.position BETWEEN h.position - 100 AND h.position + 100 WINDOW d AS (PARTITION BY i.doc_id ORDER BY i.position)),
cost AS (SELECT *, CASE WHEN structured AND label = 'page_footer' THEN 0 ELSE length(text) END AS cost FROM near),
sec AS (SELECT doc_id, section, sum(cost) AS chars, min(position) AS sec_lo, max(position) AS sec_hi FROM cost GROUP BY ALL),
centre AS (SELECT doc_id, idx AS mid, structured AND chars <= {BUDGET} AND chars >= {BUDGET // 5} AS fits, structured AND chars > {BUDGET} AS bounded, sec_lo, sec_hi FROM hit JOIN cost USING (doc_id, position) JOIN sec USING (doc_id, section)),
free AS (SELECT c.doc_id, c.idx, c.position, c.cost, mid, min(c.idx) OVER (PARTITION BY c.doc_id) AS first, max(c.idx) OVER (PARTITION BY c.doc_id) AS last FROM cost c JOIN centre USING (doc_id) WHERE NOT fits AND (NOT bounded OR c.position BETWEEN sec_lo AND sec_hi)),
walk AS (SELECT doc_id, mid AS lo, mid AS hi, CAST(cost AS BIGINT) AS spent, 0 AS turn, first, last FROM free WHERE idx = mid UNION ALL
  SELECT w.doc_id, CASE WHEN turn % 2 = 0 AND lo > w.first THEN lo - 1 ELSE lo END, CASE WHEN turn % 2 = 1 AND hi < w.last THEN hi + 1 ELSE hi END, spent + coalesce(f.cost, 0), turn + 1, w.first, w.last
  FROM walk w LEFT JOIN free f ON f.doc_id = w.doc_id AND f.idx = CASE WHEN turn % 2 = 0 THEN lo - 1 ELSE hi + 1 END WHERE spent < {BUDGET} AND (lo > w.first OR hi < w.last)),
grown AS (SELECT doc_id, sec_lo AS lo, sec_hi AS hi FROM centre WHERE fits UNION ALL SELECT doc_id, min(position), max(position) FROM (SELECT doc_id, min(lo) AS lo, max(hi) AS hi FROM walk GROUP BY doc_id) w JOIN free f USING (doc_id) WHERE f.idx BETWEEN w.lo AND w.hi GROUP BY doc_id)"""


@query("context_outward_growth", f"WITH RECURSIVE {GROWTH} SELECT doc_id, query_id || '/' || doc_id AS result_id, lo, hi FROM run JOIN grown USING (doc_id)")
def context_outward_growth(spark, d):
    hits = item_hits(spark, d)
    items = items_of(spark, d, hits)
    matched = C.resolve(hits, items)
    grown = C.expansion_ranges(matched, C.fetched(items, matched), BUDGET)
    return grown.withColumns({c: F.col(c).cast("long") for c in ("lo", "hi")})


#: All results of a document hit the same line, so they are one result, unless the clip leaves that line out: then each stands alone.
@query("expanded_results", f"""WITH RECURSIVE {GROWTH},
spans AS (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM near JOIN grown USING (doc_id) WHERE position BETWEEN lo AND hi AND length(text) > 0 AND NOT (structured AND label = 'page_footer')),
whole AS (SELECT doc_id, content, position AS own, coalesce(base, '') AS base, CASE WHEN length(content) <= {BUDGET} THEN content ELSE substring(content, length(content) // 2 - {BUDGET // 4} + 1, {BUDGET // 2}) END AS anchor
  FROM hit LEFT JOIN (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY position) AS base FROM spans GROUP BY doc_id) USING (doc_id)),
win AS (SELECT *, CASE WHEN length(base) <= {BUDGET} OR anchor = '' OR instr(base, anchor) = 0 THEN least(length(base), {BUDGET}) ELSE least(length(base), greatest(0, instr(base, anchor) - 1 + length(anchor) // 2 - {BUDGET // 2}) + {BUDGET}) END AS z FROM whole),
kept AS (SELECT s.doc_id, s.position, s.label FROM spans s JOIN win w USING (doc_id) WHERE length(base) <= {BUDGET} OR (s.a < w.z AND s.a + length(s.text) > greatest(0, w.z - {BUDGET}))),
parts AS (SELECT w.doc_id, CASE WHEN length(base) > {BUDGET} THEN substring(base, greatest(0, z - {BUDGET}) + 1, {BUDGET}) ELSE base END AS content, w.own,
  (SELECT string_agg('#/texts/' || position, ',' ORDER BY position) FROM kept k WHERE k.doc_id = w.doc_id) AS refs, (SELECT bool_or(position = w.own) FROM kept k WHERE k.doc_id = w.doc_id) AS holds,
  (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT position // 10 + 1 AS p FROM kept k WHERE k.doc_id = w.doc_id)) AS pages, (SELECT string_agg(label, ',' ORDER BY label) FROM (SELECT DISTINCT label FROM kept k WHERE k.doc_id = w.doc_id)) AS labels FROM win w),
told AS (SELECT doc_id, query_id || '/' || doc_id AS result_id, rank AS seq, score, coalesce(refs IS NOT NULL AND NOT holds, false) AND count(*) OVER (PARTITION BY doc_id) > 1 AS alone FROM run JOIN parts USING (doc_id))
SELECT doc_id, result_id, result_ids, seq, score, md5(content) AS content_md5, coalesce(refs, '#/texts/' || own) AS refs, coalesce(pages, CAST(own // 10 + 1 AS VARCHAR)) AS pages, coalesce(labels, '') AS labels FROM (
  SELECT doc_id, result_id, result_id AS result_ids, seq, score FROM told WHERE alone UNION ALL
  SELECT t.doc_id, (array_agg(result_id ORDER BY score DESC, seq, result_id))[1], string_agg(result_id, ',' ORDER BY seq, result_id), min(seq), max(score) FROM told t WHERE NOT alone GROUP BY t.doc_id) JOIN parts USING (doc_id)""")
def expanded_results(spark, d):
    hits = item_hits(spark, d)
    r = C.expand(hits, items_of(spark, d, hits), BUDGET)
    joined = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("result_ids", "refs", "pages", "labels")}
    return r.withColumns(joined).withColumn("content_md5", F.md5("content")).drop("content")


KIND = "CASE event_type WHEN 'error' THEN 'http' WHEN 'click' THEN 'not_found' ELSE 'io' END"


@query("error_classification", f"SELECT event_id, CASE WHEN k = 'http' THEN CASE WHEN s IN (408, 429) OR s >= 500 THEN 'transient' ELSE 'permanent' END WHEN k = 'not_found' THEN 'permanent' ELSE 'transient' END AS class, least(5 * pow(2, event_id % 12), 600) AS wait FROM (SELECT event_id, {KIND} AS k, 400 + event_id % 130 AS s FROM events)")
def error_classification(spark, d):
    e = V.table(spark, d, "events")
    return e.select("event_id", Q.error_class(F.expr(KIND), 400 + F.col("event_id") % 130).alias("class"), Q.backoff(F.col("event_id") % 12 + 1).alias("wait"))


@query("map_merge_metadata", "SELECT event_id, CASE WHEN event_type = 'view' THEN user_id ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_id AS n FROM events")
def map_merge_metadata(spark, d):
    e = V.table(spark, d, "events")
    m = X.merge_maps(F.from_json("props", "map<string,bigint>"), F.when(F.col("event_type") == "view", F.create_map(F.lit("k"), F.col("user_id"))), F.create_map(F.lit("n"), F.col("event_id")))
    return e.select("event_id", m.alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.col("m")["n"].alias("n"))


@query("freshness_action", "SELECT doc_id, CASE WHEN o IS NULL THEN 'create' WHEN md5(text) = o OR lang = 'en' THEN 'refresh' ELSE 'ingest' END AS action FROM (SELECT doc_id, text, lang, CASE WHEN lang = 'de' THEN NULL WHEN n_chars > 500 THEN md5(text) ELSE 'other' END AS o FROM documents)")
def freshness_action(spark, d):
    docs = docs_of(spark, d).withColumn("uri", F.col("doc_id").cast("string"))
    known = docs.where("lang <> 'de'").select("uri", F.when(F.col("lang") == "en", "same").alias("revision"), F.when(F.col("n_chars") > 500, F.md5("text")).otherwise("other").alias("md5"))
    return Q.freshness(known, docs.select("uri", F.lit("same").alias("revision"), F.md5("text").alias("md5"))).select(F.col("uri").cast("long").alias("doc_id"), "action")


@query("unchunked_classification", f"SELECT doc_id, CASE WHEN bool_or(label = 'text') THEN 'text' ELSE 'expected' END AS kind FROM ({ITEMS}) WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id")
def unchunked_classification(spark, d):
    docs = docs_of(spark, d)
    return I.unchunked(docs, V.table(spark, d, "labels").select(F.col("doc_id").alias("document_id")), V.items(docs), ["text"])


VALUE = r"CAST(regexp_replace(x, '[^0-9.]', '', 'g') AS DOUBLE) * CASE WHEN regexp_matches(x, '^[(-]') THEN -1 ELSE 1 END"
ALL_NUMBERS = f"regexp_extract_all(text, '{X.NUMBER}')"


FACTOR = "CASE lower(regexp_extract(x, '([A-Za-z]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in X.SCALE.items()) + " END"
READINGS = f"""list_concat(list_transform({ALL_NUMBERS}, lambda x: {VALUE}), list_transform(list_filter({ALL_NUMBERS}, lambda x: contains(x, '%')), lambda x: {VALUE} / 100),
list_transform(regexp_extract_all(text, '{X.SCALED}'), lambda x: {VALUE} * {FACTOR}))"""
#: Every document, and a sentence of scaled and other numbers about each.
NUMBERED = """SELECT doc_id, 'text' AS part, coalesce(text, '') AS text FROM documents
UNION ALL SELECT doc_id, 'sentence', 'Up ' || n_chars / 10 || '% to $' || n_chars || ' million (or ' || doc_id || '.5 Thousand), not (' || n_chars || ') billion: -' || doc_id || '  trillion.' FROM documents"""


@query("number_readings", f"SELECT doc_id, part, len(n) AS n, len(list_filter(n, lambda x: x < 0)) AS n_negative, round(coalesce(list_sum(list_transform(n, lambda x: log10(1 + abs(x)))), 0), 6) AS magnitude FROM (SELECT doc_id, part, {READINGS} AS n FROM ({NUMBERED}))")
def number_readings(spark, d):
    docs, n, i = docs_of(spark, d), F.col("n_chars"), F.col("doc_id")
    said = F.concat(F.lit("Up "), (n / 10).cast("string"), F.lit("% to $"), n.cast("string"), F.lit(" million (or "), i.cast("string"), F.lit(".5 Thousand), not ("), n.cast("string"), F.lit(") billion: -"), i.cast("string"), F.lit("  trillion."))
    parts = docs.select("doc_id", F.lit("text").alias("part"), F.coalesce("text", F.lit("")).alias("text")).unionByName(docs.select("doc_id", F.lit("sentence").alias("part"), said.alias("text")))
    found = parts.select("doc_id", "part", X.numbers(F.col("text")).alias("n"))
    magnitude = F.aggregate("n", F.lit(0.0), lambda s, x: s + F.log10(1 + F.abs(x)))  # card numbers pass the digits of a double, so no plain sum
    return found.select("doc_id", "part", F.size("n").cast("long").alias("n"), F.size(F.filter("n", lambda x: x < 0)).cast("long").alias("n_negative"), F.round(magnitude, 6).alias("magnitude"))


CLOSE = "CASE WHEN g = 0 THEN c * s = 0 ELSE abs(abs(c) * s - g) / g <= 0.01 END"


@query("number_match", f"""WITH a AS (SELECT row_number() OVER () AS r, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CAST(l_quantity AS BIGINT) * CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 1000 ELSE 7 END AS said, l_linestatus = 'O' AS declared FROM lineitem),
n AS (SELECT r, l_orderkey, l_linenumber, CAST(q AS DOUBLE) AS g, CASE WHEN declared THEN [CAST(said AS DOUBLE)] ELSE [CAST(3 AS DOUBLE), CAST(said AS DOUBLE), CAST(said AS DOUBLE) / 100] END AS c FROM a),
h AS (SELECT r, l_orderkey, l_linenumber, bool_or({CLOSE}) AS hit FROM (SELECT r, l_orderkey, l_linenumber, g, unnest(c) AS c FROM n), (SELECT unnest([1.0, 0.01, 100.0, 0.001, 1000.0]::DOUBLE[]) AS s) GROUP BY ALL)
SELECT l_orderkey, l_linenumber, CAST(hit AS INTEGER) AS score FROM h""")
def number_match(spark, d):
    q = F.col("l_quantity").cast("long")
    said = (q * F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 1000).otherwise(7)).cast("string")
    body = F.concat(F.lit("It was 3, then "), said, F.when(F.col("l_linestatus") == "O", F.concat(F.lit(".\nFinal answer: "), said)).otherwise("%"))
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.number_match(body, F.concat(F.lit("$"), q.cast("string"))).alias("score"))


@query("citation_resolve", """WITH c AS (SELECT conv_id AS conv, turn AS seq, 'c' || length(text) % 7 AS chunk_id FROM conversations WHERE role = 'user'), r AS (SELECT conv_id AS conv, 'c' || length(text) % 7 AS chunk_id, arg_max(md5(text), turn) AS content FROM conversations WHERE role = 'assistant' GROUP BY ALL),
f AS (SELECT conv, chunk_id, seq, content, min(seq) OVER (PARTITION BY conv, chunk_id) AS o FROM c JOIN r USING (conv, chunk_id)) SELECT conv, chunk_id, seq, content, dense_rank() OVER (PARTITION BY conv ORDER BY o, chunk_id) AS number FROM f""")
def citation_resolve(spark, d):
    t = V.table(spark, d, "conversations").select(F.col("conv_id").alias("conv"), F.col("turn").alias("seq"), "role", F.concat(F.lit("c"), (F.length("text") % 7).cast("string")).alias("chunk_id"), F.md5("text").alias("content"))
    return L.resolve_citations(t.where("role = 'user'"), t.where("role = 'assistant'").withColumnRenamed("seq", "rank"))


@query("evidence_capsule", "SELECT *, dense_rank() OVER (PARTITION BY conv ORDER BY question DESC) AS grp FROM (SELECT conv_id AS conv, role AS capability, 'c' || length(text) % 5 AS chunk_id, max(turn) AS question FROM conversations GROUP BY ALL)")
def evidence_capsule(spark, d):
    t = V.table(spark, d, "conversations")
    return L.capsule(t.select(F.col("conv_id").alias("conv"), F.col("role").alias("capability"), F.concat(F.lit("c"), (F.length("text") % 5).cast("string")).alias("chunk_id"), F.col("turn").alias("question")))


@query("evidence_status", """WITH u AS (SELECT conv_id AS conv, max(turn) + 1 AS question FROM conversations WHERE role = 'user' GROUP BY conv_id),
a AS (SELECT conv_id AS conv, max(turn) + 1 AS d, max(CASE WHEN length(text) % 3 = 0 THEN turn + 1 END) AS e FROM conversations JOIN u ON u.conv = conv_id WHERE role = 'assistant' AND turn + 1 > u.question GROUP BY conv_id)
SELECT conv, question, CASE WHEN a.d > coalesce(a.e, 0) THEN 'grounded' ELSE 'missing' END AS status FROM u LEFT JOIN a USING (conv)""")
def evidence_status(spark, d):
    t = V.table(spark, d, "conversations").where("role in ('user', 'assistant')")
    at, short = F.col("turn") + 1, F.length("text") % 3 == 0
    kinds = F.when(F.col("role") == "user", F.array(F.lit("begin"))).when(short, F.array(F.lit("evidence"), F.lit("declare"))).otherwise(F.array(F.lit("declare")))
    e = t.select(F.col("conv_id").alias("conv"), F.lit("rag").alias("capability"), (F.col("turn") * 2).alias("seq"), at.alias("question"), at.alias("epoch"), F.array(F.md5("text")).alias("chunk_ids"), F.posexplode(kinds).alias("o", "kind"))
    begun = F.min(F.when(F.col("kind") == "begin", F.col("seq"))).over(Window.partitionBy("conv"))
    e = e.withColumn("seq", F.col("seq") + F.col("o")).withColumn("b", begun).where("seq >= b").drop("b", "o")
    return L.citation_status(e)


@query("conversation_transcripts", "SELECT conv_id, turn, md5(t) AS transcript_md5 FROM (SELECT conv_id, turn, role, string_agg(role || ': ' || coalesce(text, ''), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS t FROM conversations) WHERE role = 'user'")
def conversation_transcripts(spark, d):
    return L.transcripts(V.table(spark, d, "conversations")).select("conv_id", "turn", F.md5("transcript").alias("transcript_md5"))


@query("metric_micro_macro", "SELECT round(CAST(sum(ok) AS DOUBLE) / sum(n), 6) AS micro, round(avg(ok / CAST(n AS DOUBLE)), 6) AS macro FROM (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE length(text) > 80) AS ok FROM conversations WHERE role = 'assistant' AND text IS NOT NULL GROUP BY conv_id)")
def metric_micro_macro(spark, d):
    t = V.table(spark, d, "conversations").where("role = 'assistant'")
    return M.micro_macro(t.select("conv_id", (F.length("text") > 80).alias("passed")))


@query("metric_refusals", "SELECT round(CAST(sum(CASE WHEN r AND NOT a THEN 1 ELSE 0 END) AS DOUBLE) / sum(CASE WHEN r THEN 1 ELSE 0 END), 6) AS precision, round(CAST(sum(CASE WHEN r AND NOT a THEN 1 ELSE 0 END) AS DOUBLE) / sum(CASE WHEN NOT a THEN 1 ELSE 0 END), 6) AS recall FROM (SELECT quality = 0 AS r, toxic = 0 AS a FROM labels)")
def metric_refusals(spark, d):
    return M.refusals(V.table(spark, d, "labels").select((F.col("quality") == 0).alias("refused"), (F.col("toxic") == 0).alias("answerable")))


@rows_only("html_to_items")
def html_to_items(spark, d):
    return files.html_items(V.table(spark, d, "pages"))
