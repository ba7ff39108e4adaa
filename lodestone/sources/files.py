"""Listings of files, filters on their names, revisions, and plain-text converters.

A listing never reads contents: Spark's ``binaryFile`` source prunes that column. Bodies are read only where they are
hashed or converted.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.queue import snapshot_diff

# Content types and the suffix each stands for, tried in this order.
CONTENT_TYPES = (
    ("text/html", ".html"), ("text/plain", ".txt"), ("text/markdown", ".md"), ("application/pdf", ".pdf"),
    ("application/json", ".json"), ("text/csv", ".csv"),
    ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".docx"),
    ("application/vnd.openxmlformats-officedocument.presentationml.presentation", ".pptx"),
    ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".xlsx"),
)
# Suffixes of code and the language of their fenced block.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".c": "c", ".cpp": "cpp", ".go": "go", ".rs": "rust",
    ".rb": "ruby", ".sh": "bash", ".sql": "sql", ".scala": "scala", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".xml": "xml",
}


def glob_regex(pattern: str) -> str:
    """Regular expression of a pattern as in ignore files: ``*`` within a folder, ``**`` across; no slash, any folder."""
    folder, anchored = pattern.endswith("/"), "/" in pattern.strip("/") or pattern.startswith("/")
    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?|\[!?[^\]]*\])", pattern.strip("/")):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or (part.replace("[!", "[^") if part.startswith("[") else re.escape(part))
    return f"^{'' if anchored else '(?:.*/)?'}{out}{'/.*' if folder else '(?:/.*)?'}$"


def included(path: Column, extensions: list[str] | None = None, include: list[str] | None = None, ignore: list[str] | None = None) -> Column:
    """Whether a path relative to its root passes: a known suffix, some include pattern if any, no ignore pattern."""
    ok = F.lit(True)
    if extensions is not None:
        ok &= F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*[e.lower() for e in extensions])
    if include:
        ok &= path.rlike("|".join(glob_regex(p) for p in include))
    if ignore:
        ok &= ~path.rlike("|".join(glob_regex(p) for p in ignore))
    return ok


def listing(spark: SparkSession, root: str, **patterns) -> DataFrame:
    """``uri, path, revision, length`` of the files below a folder; the revision is the time of change."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    base = files.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    local = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    relative = F.substring(local, F.lit(len(base) + 2), F.length(local))
    rows = files.select(F.col("path").alias("uri"), relative.alias("path"), F.unix_micros("modificationTime").cast("string").alias("revision"), "length")
    return rows.where(included(F.col("path"), **patterns))


def bodies(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """``uri, content, content_hash`` of files up to a size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files if max_bytes is None else files.where(F.col("length") <= max_bytes)
    return files.select(F.col("path").alias("uri"), "content", F.md5("content").alias("content_hash"))


def discover(found: DataFrame, known: DataFrame) -> DataFrame:
    """``uri, action`` from a listing against the known ``uri, revision``."""
    return snapshot_diff(known, found, "uri", "revision")


def http_action(status: Column, etag: Column, last_modified: Column, known: Column) -> Column:
    """``action, revision`` of an answered request; ``known`` says that the address was ingested before.

    410 deletes; other errors, and no answer (a null status), are tried again, without a revision; a known address without one is taken as unchanged.
    """
    revision = F.coalesce(F.trim(F.replace(F.regexp_replace(etag, "^W/", ""), F.lit('"'), F.lit(""))), last_modified)
    action = F.when(status == 410, "DELETE").when(status.isNull() | (status >= 400), "UPSERT").when(revision.isNull() & known, "UNCHANGED").otherwise("UPSERT")
    return F.struct(action.alias("action"), F.when(status < 400, revision).alias("revision"))


def extension(content_type: Column, url: Column) -> Column:
    """The suffix by content type, else of the address, else ``.html``."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    out = F.when(F.lit(False), "")
    for name, suffix in CONTENT_TYPES:
        out = out.when(F.contains(kind, F.lit(name)), suffix)
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    tail = F.lower(F.regexp_extract(path, r"[^/](\.[A-Za-z0-9]+)$", 1))
    return out.otherwise(F.when(tail != "", tail).otherwise(".html"))


def local_path(uri: Column) -> Column:
    """The path of ``file:`` addresses and bare paths; null for other schemes."""
    bare = ~uri.rlike(r"^[A-Za-z][A-Za-z0-9+.-]+:")
    return F.when(uri.rlike("(?i)^file:"), F.url_decode(F.replace(F.regexp_replace(uri, r"(?i)^file:(//(localhost)?)?(?=/)", ""), F.lit("+"), F.lit("%2B")))).when(bare, uri)


def fenced(text: Column, suffix: Column) -> Column:
    """Code as a fenced block of its language; other text unchanged."""
    language = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[F.lower(suffix)]
    return F.when(language.isNotNull(), F.concat(F.lit("```"), language, F.lit("\n"), text, F.lit("\n```"))).otherwise(text)


def markdown_items(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, position, label, level, text`` of paragraphs, headings, lists and fenced code, in reading order.

    A fenced block is one item; null and empty texts have none.
    """
    block = F.regexp_extract_all("text", F.lit(r"(?ms)(^```[^\n]*\n.*?(?:^```[ \t]*$|\z)|^#{1,6}[ \t][^\n]*|^[ \t]*(?:[-*+]|\d+\.)[ \t][^\n]*|^(?:(?!```|#{1,6}[ \t]|[ \t]*(?:[-*+]|\d+\.)[ \t])[^\n]*\S[^\n]*\n?)+)"), 1)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(block).alias("position", "raw"))
    label = F.when(F.col("raw").startswith("```"), "code").when(F.col("raw").rlike(r"^#{1,6}[ \t]"), "section_header").when(F.col("raw").rlike(r"^[ \t]*(?:[-*+]|\d+\.)[ \t]"), "list_item").otherwise("text")
    level = F.when(F.col("raw").rlike(r"^#{1,6}[ \t]"), F.length(F.regexp_extract("raw", "^(#+)", 1)))
    text = F.when(label == "code", F.regexp_replace("raw", r"(?s)^```[^\n]*\n|\n?```[ \t]*$", "")).otherwise(F.trim(F.regexp_replace(F.regexp_replace("raw", r"^(#{1,6}|[ \t]*(?:[-*+]|\d+\.))[ \t]+", ""), r"\s+$", "")))
    return rows.select("doc_id", "position", label.alias("label"), level.alias("level"), text.alias("text"))


def html_items(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, position, label, level, text``: headings, paragraphs, list items and cells of a page, in order.

    Scripts, styles, comments and navigation are dropped first; entities of mark-up are decoded last. Null pages have no items.
    """
    clean = F.regexp_replace(html_col, r"(?is)<!--.*?-->|<(script|style|nav|header|footer|aside|template)\b[^>]*>.*?</\1\s*>", " ")
    block = r"(?is)<(h[1-6]|p|li|td|th|pre|title|blockquote)\b[^>]*>.*?(?=<(?:/?(?:h[1-6]|p|li|td|th|pre|title|blockquote|tr|ul|ol|table|div|body|html))\b|\z)"
    rows = pages.select(F.col(id_col).alias(id_col), F.posexplode(F.regexp_extract_all(clean, F.lit(block), 0)).alias("position", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"^<(\w+)", 1))
    text = F.regexp_replace("raw", r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    label = F.when(tag == "title", "title").when(tag.startswith("h"), "section_header").when(tag == "li", "list_item").when(tag.isin("td", "th"), "table").when(tag == "pre", "code").otherwise("text")
    return rows.select(id_col, "position", label.alias("label"), F.when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int")).alias("level"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text")).where("text <> ''")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ``query_id, doc_id`` of a TREC-like TSV with a header; scores are not used."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="query_id string, doc_id string, score string")
    return rows.select("query_id", "doc_id").distinct()
