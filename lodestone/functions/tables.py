"""Table functions: a corpus called from SQL.

``list_documents``, ``items``, ``toc`` and ``search`` are SQL functions over views, so Catalyst inlines them: an id given
to ``items`` is a filter of its scan, and each may stand after ``LATERAL``. ``outline`` is a Python function over a table,
for what needs a walk: it is analysed against its input, reads three of its columns, asks for its rows by document in
order, and keeps the open headers only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn, udtf
from pyspark.sql.types import IntegerType, StructType

#: Constants of the ranking of ``search``: saturation of counts, weight of lengths.
K1, B = 1.2, 0.75
#: Levels that ``toc`` tells apart; deeper ones nest like the last.
DEEPEST = 9


class Outline:
    """``outline(TABLE(items))``: ``doc_id, position, level, parent_pos, end_pos`` of headers that have a level.

    As ``structure.outline``, with levels as deep as they come: a section ends at the next header that is not deeper, or
    after the last item; its parent is the nearest earlier header that is less deep. Items need ``doc_id``, ``position``,
    ``label`` and ``level``; other columns are not read. Documents of null id are one document; of items that share a
    position, each header is one, in order of level; an empty table gives no rows.
    """

    @staticmethod
    def analyze(items: AnalyzeArgument) -> AnalyzeResult:
        if not items.isTable:
            raise ValueError("outline takes a table: outline(TABLE(items))")
        types = {f.name: f.dataType for f in items.dataType.fields}
        if missing := {"doc_id", "position", "label", "level"} - set(types):
            raise ValueError(f"the table lacks {', '.join(sorted(missing))}")
        schema = StructType().add("doc_id", types["doc_id"]).add("position", types["position"]).add("level", IntegerType()).add("parent_pos", types["position"]).add("end_pos", types["position"])
        header = SelectedColumn("case when label = 'section_header' and level > 0 then cast(level as int) end", alias="head_level")
        return AnalyzeResult(
            schema, partitionBy=[PartitioningColumn("doc_id")], orderBy=[OrderingColumn("position"), OrderingColumn("level")],
            select=[SelectedColumn("doc_id"), SelectedColumn("position"), header],
        )

    def __init__(self):
        self.open: list[tuple] = []
        self.last = None

    def eval(self, row):
        doc, self.last, level = row[0], row[1], row[2]
        if level is not None:
            yield from self._closed(level, self.last)
            self.open.append((doc, self.last, level, self.open[-1][1] if self.open else None))

    def _closed(self, level, end):
        while self.open and self.open[-1][2] >= level:
            yield (*self.open.pop(), end)

    def terminate(self):
        if self.open:
            yield from self._closed(0, self.last + 1)


def register(spark: SparkSession, meta: DataFrame, items: DataFrame, chunks: DataFrame, prefix: str = "") -> None:
    """Register the functions, named with ``prefix``, over ``meta`` (``id, uri, title, ...``), ``items`` (``doc_id, position,
    label, level, text``) and ``chunks`` (``chunk_id, document_id, content``) as temporary functions of the session.

    - ``list_documents(title_like, after_id, page_size)``: the page of metadata after an id; a null pattern or id is none.
    - ``items(id)`` and ``toc(id)``: a document's items, and its headers with depth and parent; an unknown id gives no rows.
    - ``search(asked, n)``: ``chunk_id, document_id, score, rank`` of the best chunks by BM25; blank or null text gives no rows.
    - ``outline(TABLE(t))``: see ``Outline``.
    """
    ids = items.schema["doc_id"].dataType.simpleString()
    for name, df in (("meta", meta), ("items", items), ("chunks", chunks)):
        df.createOrReplaceTempView(f"{prefix}{name}_view")
    columns = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    doc_type, chunk_type = chunks.schema["document_id"].dataType.simpleString(), chunks.schema["chunk_id"].dataType.simpleString()
    own = ", ".join(f"`{c}`" for c in meta.columns)
    define = lambda name, args, returns, body: spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({args}) RETURNS TABLE ({returns}) RETURN {body}")
    define("list_documents", f"title_like STRING, after_id {meta.schema['id'].dataType.simpleString()}, page_size INT", columns(meta), f"""
SELECT {own} FROM (SELECT *, row_number() OVER (ORDER BY id) AS _n FROM {prefix}meta_view m
  WHERE (title_like IS NULL OR m.title LIKE title_like) AND (after_id IS NULL OR m.id > after_id)) WHERE _n <= page_size""")  # fmt: skip
    define("items", f"id {ids}", columns(items), f"SELECT {', '.join(f'i.`{c}`' for c in items.columns)} FROM {prefix}items_view i WHERE i.doc_id = {prefix}items.id")
    before, after = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING", "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"
    order = "OVER (PARTITION BY doc_id ORDER BY position"
    parents = " ".join(f"WHEN depth = {n} THEN max(CASE WHEN depth < {n} THEN position END) {order} {before})" for n in range(1, DEEPEST + 1))
    ends = " ".join(f"WHEN depth = {n} THEN min(CASE WHEN depth <= {n} THEN position END) {order} {after})" for n in range(1, DEEPEST + 1))
    define("toc", f"id {ids}", "position INT, level INT, text STRING, parent_pos INT, end_pos INT", f"""
SELECT position, level, text, CASE {parents} END, coalesce(CASE {ends} END, stop) FROM
  (SELECT doc_id, position, level, text, least(level, {DEEPEST}) AS depth, stop FROM
    (SELECT *, max(position) OVER (PARTITION BY doc_id) + 1 AS stop FROM {prefix}items_view i WHERE i.doc_id = {prefix}toc.id)
  WHERE label = 'section_header' AND level > 0)""")  # fmt: skip
    words = lambda column: f"filter(split(lower({column}), '[^a-z0-9]+'), x -> x <> '')"
    sized = f"(SELECT size({words('content')}) AS len FROM {prefix}chunks_view)"
    define("search", "asked STRING, n INT", f"chunk_id {chunk_type}, document_id {doc_type}, score DOUBLE, rank INT", f"""
WITH told AS (SELECT chunk_id, document_id, size(w) AS len, w FROM (SELECT chunk_id, document_id, {words("content")} AS w FROM {prefix}chunks_view)),
wanted AS (SELECT DISTINCT term FROM (SELECT explode({words(f"{prefix}search.asked")}) AS term)),
counted AS (SELECT chunk_id, document_id, len, term, count(*) AS tf FROM (SELECT chunk_id, document_id, len, explode(w) AS term FROM told) JOIN wanted USING (term) GROUP BY ALL),
known AS (SELECT term, count(*) AS df FROM counted GROUP BY term),
scored AS (SELECT chunk_id, document_id, round(sum(ln(1 + ((SELECT count(*) FROM {sized}) - df + 0.5D) / (df + 0.5D)) * tf * {1 + K1}D
    / (tf + {K1}D * ({1 - B}D + {B}D * len / (SELECT avg(len) FROM {sized})))), 5) AS score
  FROM counted JOIN known USING (term) GROUP BY chunk_id, document_id)
SELECT chunk_id, document_id, score, rank FROM (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, chunk_id) AS INT) AS rank FROM scored) WHERE rank <= n""")  # fmt: skip
    spark.udtf.register(f"{prefix}outline", udtf(Outline))
