"""Checks of a corpus, near-duplicate families and their report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import version_key
from lodestone.functions.views import dot, scratch


def sample(df: DataFrame, name: str, id_col: str, severity: str = "warn", most: int = 5) -> DataFrame:
    """One line ``name, severity, n, details``: ok for no row, else the first ids and how many more."""
    ids = df.select(F.col(id_col).cast("string").alias("x"))
    first = F.array_join(F.array_agg(F.when(F.col("r") <= most, F.col("x"))), ", ")
    ranked = ids.orderBy("x").limit(most).withColumn("r", F.lit(1))
    n = ids.agg(F.count("*").alias("n"))
    shown = ranked.agg(first.alias("shown"))
    more = F.when(F.col("n") > most, F.format_string("... (+%d more)", F.col("n") - most)).otherwise("")
    return n.crossJoin(F.broadcast(shown)).select(F.lit(name).alias("name"), F.when(F.col("n") == 0, "ok").otherwise(severity).alias("severity"), "n", F.concat_ws(" ", "shown", F.when(more != "", more)).alias("details"))


def missing(left: DataFrame, right: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    return left.select(key).distinct().join(right.select(F.col(other or key).alias(key)), key, "left_anti")


def dangling_refs(chunks: DataFrame, items: DataFrame) -> DataFrame:
    """Chunks that name an item their document lacks; chunks are ``id, document_id, refs``."""
    refs = chunks.select("id", "document_id", F.explode("refs").alias("self_ref"))
    return refs.join(items.select(F.col("doc_id").alias("document_id"), "self_ref"), ["document_id", "self_ref"], "left_anti").select("id").distinct()


def unchunked(docs: DataFrame, chunks: DataFrame, items: DataFrame, body: list[str], supports_images: bool = False) -> DataFrame:
    """``doc_id, kind`` of documents without chunks: text if they have a body, picture, or expected."""
    none = docs.select("doc_id").join(chunks.select(F.col("document_id").alias("doc_id")), "doc_id", "left_anti")
    flags = items.groupBy("doc_id").agg(F.max(F.col("label").isin(*body)).alias("b"), F.max(F.col("label") == "picture").alias("p"))
    kind = F.when(F.col("b"), "text").when(F.col("p") & F.lit(supports_images), "picture").otherwise("expected")
    return none.join(flags, "doc_id", "left").select("doc_id", kind.alias("kind"))


def report(docs: DataFrame, meta: DataFrame, chunks: DataFrame, items: DataFrame, dim: int) -> DataFrame:
    """One line for each check of documents, metadata, chunks (``id, document_id, refs, vector``) and items."""
    zero = F.forall("vector", lambda x: x == 0)
    picture = (F.col("label") == "picture") & F.col("picture_data").isNull() if "picture_data" in items.columns else F.lit(False)
    lines = [
        sample(missing(docs, meta, "doc_id"), "documents without metadata", "doc_id", "fail"), sample(missing(meta, docs, "doc_id"), "metadata without documents", "doc_id", "fail"),
        sample(missing(chunks, docs, "document_id", "doc_id"), "chunks without documents", "document_id"), sample(missing(items, docs, "doc_id"), "items without documents", "doc_id"),
        sample(missing(chunks.join(docs.select(F.col("doc_id").alias("document_id")), "document_id", "left_semi"), items, "document_id", "doc_id"), "chunked documents without items", "document_id"),
        sample(dangling_refs(chunks, items), "chunks with dangling references", "id"), sample(chunks.where(F.size("vector") != dim), "vectors of another size", "id", "fail"),
        sample(chunks.where(zero), "chunks without an embedding", "id"), sample(items.where(picture), "pictures without bytes", "self_ref"),
    ]
    out = lines[0]
    for x in lines[1:]:
        out = out.unionByName(x)
    return out


#: Chunks from which a search without an index is worth a warning.
LARGE = 100_000


def store_checks(settings: DataFrame, config: dict, migrations: DataFrame, chunks: DataFrame, indexed: DataFrame | None = None) -> DataFrame:
    """Lines as ``report`` gives them on a store itself: its one row of settings, the embedding it was made with, migrations it lacks, and its vector index.

    ``settings`` is ``id, provider, name, vector_dim, version``, the row with the id ``settings`` counts; ``config`` holds the
    first three of these; ``migrations`` is ``version, description``; ``chunks`` and ``indexed`` are ``id``. What the settings
    leave null is not compared; another ``vector_dim`` fails, another provider or name is a warning.
    """
    own = settings.where("id = 'settings'")
    rows = own.agg(F.count("*").alias("n")).select(F.lit("settings row").alias("name"), F.when(F.col("n") == 1, "ok").otherwise("fail").alias("severity"), "n", F.lit("").alias("details"))
    differs = [F.when(F.col(c) != F.lit(config[c]), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"), F.lit(f" -> {config[c]}"))) for c in ("vector_dim", "provider", "name")]
    size, others = differs[0], F.filter(F.array(*differs[1:]), lambda x: x.isNotNull())
    found = F.when(size.isNotNull(), F.array(size)).otherwise(others)
    one = own.orderBy(*own.columns).limit(1)
    told = one.select(found.alias("d"), size.isNotNull().alias("bad"))
    drift = told.agg(F.coalesce(F.max(F.size("d")), F.lit(0)).cast("long").alias("n"), F.max("bad").alias("bad"), F.max(F.array_join("d", ", ")).alias("d"))
    drift = drift.select(F.lit("embedding drift").alias("name"), F.when(F.col("n") == 0, "ok").when(F.col("bad"), "fail").otherwise("warn").alias("severity"), "n", F.coalesce("d", F.lit("")).alias("details"))
    at = one.where("version is not null").select(version_key(F.col("version")).alias("_at"))
    late = migrations.withColumn("_v", version_key(F.col("version"))).join(F.broadcast(at), F.col("_v") > F.col("_at"))
    pending = late.agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("_v", F.concat_ws(": ", "version", F.coalesce("description", F.lit(""))).alias("t")))).alias("a"))
    pending = pending.select(F.lit("pending migrations").alias("name"), F.when(F.col("n") == 0, "ok").otherwise("warn").alias("severity"), "n", F.array_join(F.transform("a", lambda s: s["t"]), ", ").alias("details"))
    bare = chunks.select("id") if indexed is None else chunks.select("id").join(indexed.select("id"), "id", "left_anti")
    fine = (F.col("n") < LARGE) if indexed is None else (F.col("n") == 0)
    index = bare.agg(F.count("*").alias("n")).select(F.lit("vector index").alias("name"), F.when(fine, "ok").otherwise("warn").alias("severity"), "n", F.lit("no index" if indexed is None else "").alias("details"))
    return rows.unionByName(drift).unionByName(pending).unionByName(index)


def centroids(vectors: DataFrame, key: str = "label") -> DataFrame:
    """``key, embedding, n``: means of the vectors that are not zero, by component, so no group meets one task."""
    x = vectors.where(F.exists("embedding", lambda v: v != 0)).select(key, F.posexplode("embedding").alias("i", "v"))
    mean = x.groupBy(key, "i").agg(F.avg(F.col("v").cast("double")).alias("m"), F.count("*").alias("n"))
    g = mean.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("a"), F.max("n").alias("n"))
    return g.select(key, F.transform("a", lambda s: s["m"]).alias("embedding"), "n")


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """``id, component``: the smallest id reachable through pairs ``a, b``.

    Rounds of neighbours' minima and of pointer jumping, each checkpointed, until no label changes.
    """
    spark = pairs.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch(spark, "components"))
    edges = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")).checkpoint()
    for _ in range(rounds):
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("n"))
        new = labels.join(near, "id").select("id", F.least("component", "n").alias("c"), F.col("component").alias("old"))
        up = labels.select(F.col("id").alias("c"), F.col("component").alias("up"))
        new = new.join(up, "c", "left").select("id", F.least("c", F.coalesce("up", "c")).alias("component"), "old").checkpoint()
        labels = new.select("id", "component")
        if new.where("component <> old").isEmpty():
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")


def families(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """``family, id, keep, similarity``: of each component the document with most chunks stays, of equals the first.

    ``similarity`` is the best of the member's own pairs, to three places. ``counts`` is ``id, n``.
    """
    best = pairs.select(F.explode(F.array("a", "b")).alias("id"), "similarity").groupBy("id").agg(F.round(F.max("similarity"), 3).alias("similarity"))
    sized = components(pairs).join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    keep = sized.groupBy("component").agg(F.max(F.struct("n", (-F.col("id")).alias("i"))).alias("k"))
    return sized.join(keep, "component").join(best, "id").select(F.col("component").alias("family"), "id", (F.col("id") == -F.col("k.i")).alias("keep"), "similarity")


def family_blocks(found: DataFrame, counts: DataFrame, labels: DataFrame) -> DataFrame:
    """``family, block``: one JSON object, which is YAML too, for each family of ``families``, for an export as text.

    It names the document to keep and lists members by id, with ``labels`` (``id, label``; the id where it is null) and
    chunks. Members of a family meet in one task.
    """
    m = found.join(counts, "id", "left").join(labels, "id", "left")
    member = F.struct(F.col("id").alias("document_id"), F.coalesce("label", F.col("id").cast("string")).alias("document"), F.coalesce("n", F.lit(0)).cast("long").alias("chunks"), "similarity", F.col("keep").alias("keep_suggested"))
    g = m.groupBy("family").agg(F.max(F.when(F.col("keep"), F.col("id"))).alias("keep"), F.sort_array(F.collect_list(member)).alias("documents"))
    return g.select("family", F.to_json(F.struct(F.col("family").alias("group"), "keep", "documents")).alias("block"))


def common_prefix(texts: Column, least: int = 16) -> Column:
    """The longest common folder of an array of paths, if longer than ``least`` characters, else empty."""
    lo, hi = F.array_min(texts), F.array_max(texts)
    n = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.length(lo), F.length(hi)), F.lit(1))), lambda i: F.substring(lo, F.lit(1), i) == F.substring(hi, F.lit(1), i)))
    cut = F.regexp_extract(F.substring(lo, F.lit(1), n), "^(.*/)", 1)
    return F.when(F.length(cut) > least, cut).otherwise("")
