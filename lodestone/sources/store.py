"""A versioned store of Parquet tables: one manifest names the files of every table, so a commit covers several tables.

A writer puts new files first and then creates the next manifest, which fails if another writer made it before; the
loser's files are garbage for ``vacuum``. Appends add files and rewrite nothing. Tags name versions and keep them
from ``vacuum``. Only manifests, which list folders and not files, meet the driver.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer committed first."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._io = jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        p = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _load(self, name: str) -> dict | None:
        """A small JSON file; None for one whose writer was lost before it was filled."""
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            text = self._io.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text.endswith("}\n") else None

    def _create(self, name: str, value: dict) -> None:
        """A file that is there whole or not at all: written aside, then renamed; raises ``Conflict`` if the name is taken.

        The rename is atomic in file systems such as HDFS; stores of objects need a lock of their own.
        """
        folder, _, file = name.rpartition("/")
        aside, p = self._path(f"{self.root}/{folder}/.{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        stream = self._fs.create(aside, False)
        self._io.write(json.dumps(value, sort_keys=True) + "\n", stream, "UTF-8")
        stream.close()
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        none = sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), sc._jsc.hadoopConfiguration()).rename(aside, p, none)
        except Exception as e:  # the JVM's error when the name is taken
            self._fs.delete(aside, False)
            if self._fs.exists(p):
                raise Conflict(name) from e
            raise

    def versions(self) -> dict[int, dict]:
        """All manifests by version."""
        found = {int(n.split(".")[0]): self._load(f"_manifest/{n}") for n in self._names("_manifest") if n.endswith(".json") and not n.startswith(".")}
        return {v: m for v, m in found.items() if m is not None}

    def version(self) -> int:
        """The newest committed version; 0 for an empty store."""
        return max(self.versions(), default=0)

    def _tables(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {}
        m = self._load(f"_manifest/{version:012d}.json")
        if m is None:
            raise KeyError(version)
        return m["tables"]

    def read(self, table: str, version: int | None = None) -> DataFrame:
        t = self._tables(version)[table]
        schema = StructType.fromJson(t["schema"])
        return self.spark.read.schema(schema).parquet(*t["paths"]) if t["paths"] else self.spark.createDataFrame([], schema)

    def _write(self, table: str, df: DataFrame) -> dict:
        path = f"{self.root}/{table}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return {"paths": [path], "schema": json.loads(df.schema.json())}

    def _publish(self, base: int, tables: dict, note: str) -> int:
        # the name first, then the check: of writers on one base, one gets the name
        new = 1 + max((int(n.split(".")[0]) for n in self._names("_manifest") if n.endswith(".json") and not n.startswith(".")), default=0)
        if self.version() != base:
            raise Conflict(f"version {base} is not the newest")
        self._create(f"_manifest/{new:012d}.json", {"version": new, "at": datetime.now(UTC).isoformat(), "note": note, "tables": tables})
        return new

    def mark(self, name: str) -> bool:
        """Set a lasting mark; whether it was not there yet."""
        try:
            self._create(f"_marks/{name}.json", {"at": datetime.now(UTC).isoformat()})
        except Conflict:
            return False
        return True

    def marked(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/_marks/{name}.json"))

    def commit(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, note: str = "", base: int | None = None) -> int:
        """Replace and append whole tables in one version; all or nothing. Returns the version."""
        base = self.version() if base is None else base
        tables = dict(self._tables(base))
        for name, df in (replace or {}).items():
            tables[name] = self._write(name, df)
        for name, df in (append or {}).items():
            old = tables.get(name)
            new = self._write(name, df.select(*StructType.fromJson(old["schema"]).names) if old else df)
            tables[name] = {"paths": (old["paths"] if old else []) + new["paths"], "schema": old["schema"] if old else new["schema"]}
        return self._publish(base, tables, note)

    # changes of one table, each a new version

    def replace_scope(self, table: str, scope: Column, rows: DataFrame) -> int:
        """Rows in the scope become ``rows``; others stay."""
        return self.commit({table: self.read(table).where(~F.coalesce(scope, F.lit(False))).unionByName(rows)}, note="replace_scope")

    def delete(self, table: str, where: Column) -> int:
        return self.commit({table: self.read(table).where(~F.coalesce(where, F.lit(False)))}, note="delete")

    def update(self, table: str, rows: DataFrame, keys: list[str]) -> int:
        """Replace rows whose key is known; unknown keys are not added."""
        old = self.read(table)
        known = rows.join(old.select(*keys), keys, "left_semi").select(*old.columns)
        return self.commit({table: old.join(known.select(*keys), keys, "left_anti").unionByName(known)}, note="update")

    def upsert(self, table: str, rows: DataFrame, keys: list[str]) -> int:
        old = self.read(table)
        return self.commit({table: old.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*old.columns))}, note="upsert")

    def cascade_delete(self, uri: str, tables: dict[str, str], meta: str = "document_meta") -> int:
        """Delete a document and all below it by ``parent_uri`` from ``meta`` and the other tables (name: column of the document's id)."""
        m = self.read(meta)
        gone = descendants(m, uri).select("id")
        changed = {t: self.read(t).join(gone.withColumnRenamed("id", c), c, "left_anti") for t, c in tables.items()}
        return self.commit({meta: m.join(gone, "id", "left_anti")} | changed, note=f"delete {uri}")

    # tags, history, retention

    def tag(self, name: str, version: int | None = None) -> None:
        version = self.version() if version is None else version
        self._tables(version)
        self._create(f"_tags/{name}.json", {"version": version})

    def tags(self) -> dict[str, int]:
        found = {n.removesuffix(".json"): self._load(f"_tags/{n}") for n in self._names("_tags") if n.endswith(".json") and not n.startswith(".")}
        return {n: t["version"] for n, t in found.items() if t}

    def untag(self, name: str) -> bool:
        return self._fs.delete(self._path(f"{self.root}/_tags/{name}.json"), False)

    def restore(self, tag: str) -> int:
        """Make the tagged tables current again, after tagging the present state."""
        tables = self._tables(self.tags()[tag])
        stem = "before-restore-" + datetime.now(UTC).strftime("%Y%m%dT%H%M%S")
        taken, n, name = self.tags(), 0, stem
        while name in taken:
            n += 1
            name = f"{stem}-{n}"
        self.tag(name)
        return self._publish(self.version(), tables, f"restore {tag}")

    def history(self, limit: int = 20) -> DataFrame:
        """``table_name, version, at, note, tags`` of the newest versions that changed each table."""
        named: dict[int, list[str]] = {}
        for t, v in self.tags().items():
            named.setdefault(v, []).append(t)
        rows, before, seen = [], {}, {}
        for v, m in sorted(self.versions().items()):
            rows += [(t, v, m["at"], m["note"], sorted(named.get(v, []))) for t, x in m["tables"].items() if before.get(t) != x["paths"]]
            before = {t: x["paths"] for t, x in m["tables"].items()}
        kept = []
        for r in sorted(rows, key=lambda r: (r[0], -r[1])):
            seen[r[0]] = seen.get(r[0], 0) + 1
            if seen[r[0]] <= limit:
                kept.append(r)
        return self.spark.createDataFrame(kept, "table_name string, version long, at string, note string, tags array<string>")

    def vacuum(self, retention_seconds: float) -> list[str]:
        """Delete the files that no kept version names: the newest, the tagged and those within the retention are kept.

        Folders younger than the retention stay too, since a writer may be about to commit them.
        """
        known, now = self.versions(), datetime.now(UTC)
        kept = {v for v, m in known.items() if (now - datetime.fromisoformat(m["at"])).total_seconds() < retention_seconds}
        kept |= set(self.tags().values()) | ({max(known)} if known else set())
        live = {p for v in kept if v in known for t in known[v]["tables"].values() for p in t["paths"]}
        gone = []
        for table in sorted({t for m in known.values() for t in m["tables"]}):
            for s in self._fs.listStatus(self._path(f"{self.root}/{table}")):
                path = f"{self.root}/{table}/{s.getPath().getName()}"
                if path not in live and now.timestamp() - s.getModificationTime() / 1000 >= retention_seconds:
                    self._fs.delete(self._path(path), True)
                    gone.append(path)
        for v in set(known) - kept:
            self._fs.delete(self._path(f"{self.root}/_manifest/{v:012d}.json"), False)
        return gone

    def info(self) -> DataFrame:
        """``table_name, n_rows, n_parts`` of the newest version."""
        out = None
        for name, t in sorted(self._tables().items()):
            line = self.read(name).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(t["paths"])).alias("n_parts"))
            out = line if out is None else out.unionByName(line)
        return self.spark.createDataFrame([], "table_name string, n_rows long, n_parts int") if out is None else out


def descendants(meta: DataFrame, uri: str) -> DataFrame:
    """``id, uri`` of a document and all whose ``parent_uri`` leads to it; cycles end where they close."""
    view = f"_tree_{uuid.uuid4().hex}"
    meta.select("id", "uri", "parent_uri").createOrReplaceTempView(view)
    try:
        return meta.sparkSession.sql(
            f"""WITH RECURSIVE t AS (SELECT id, uri, array(uri) AS path FROM {view} WHERE uri = :uri
            UNION ALL SELECT m.id, m.uri, array_append(t.path, m.uri) FROM {view} m JOIN t ON m.parent_uri = t.uri AND NOT array_contains(t.path, m.uri))
            SELECT DISTINCT id, uri FROM t""",
            args={"uri": uri},
        )
    finally:
        meta.sparkSession.catalog.dropTempView(view)


def resolve_document(meta: DataFrame, text: str) -> DataFrame:
    """The document whose id, else title, else uri is ``text``."""
    x = F.lit(text)
    rank = F.when(F.col("id") == x, 0).when(F.col("title") == x, 1).when(F.col("uri") == x, 2)
    return meta.withColumn("_rank", rank).where("_rank is not null").orderBy("_rank", "id").limit(1).drop("_rank")


def find_document(meta: DataFrame, text: str) -> DataFrame:
    """The best match: uri, then part of the uri, then part of the title; case and blanks aside."""
    bare = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit(""))
    q = F.lit(text)
    within = lambda c: F.contains(F.lower(c), F.lower(q)) | F.contains(bare(c), bare(q))
    rank = F.when(F.col("uri") == q, 0).when(within(F.col("uri")), 1).when(within(F.col("title")), 2)
    return meta.withColumn("_rank", rank).where("_rank is not null").orderBy("_rank", "id").limit(1).drop("_rank")


#: Columns that a filter given as text may name.
FILTERABLE = ("id", "uri", "title", "created_at", "updated_at", "metadata")


def list_documents(meta: DataFrame, where: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Documents that pass a filter given as text, by id; an unknown column is an error."""
    rows = meta.select(*[c for c in FILTERABLE if c in meta.columns])
    if where:
        try:  # an empty table of the same columns, since a filter may reach columns below a projection
            meta.sparkSession.createDataFrame([], rows.schema).where(where).schema  # noqa: B018
        except PySparkException as e:
            raise ValueError(f"bad filter: {where}") from e
        rows = rows.where(where)
    rows = rows.orderBy("id").offset(offset)
    return rows if limit is None else rows.limit(limit)


def document_page(meta: DataFrame, page: int = 1, size: int = 50) -> DataFrame:
    """The rows of one page of documents by id, each with ``page, total_pages, total_documents``; at least one page is counted."""
    n = meta.agg(F.count("*").alias("total_documents"))
    pages = F.greatest(F.ceil(F.col("total_documents") / size), F.lit(1)).cast("long")
    rows = meta.orderBy("id").offset((page - 1) * size).limit(size)
    return rows.crossJoin(F.broadcast(n)).withColumns({"page": F.lit(page), "total_pages": pages})


def split_columns(wide: DataFrame, moved: DataFrame, columns: list[str], defaults: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows ``id`` and ``columns`` that ``moved`` lacks yet, with defaults for nulls, and ``wide`` without these columns.

    A second run after a broken one moves only the rest; columns that are gone from ``wide`` are left out.
    """
    there = [c for c in columns if c in wide.columns]
    rows = wide.select("id", *[F.coalesce(c, F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in there])
    return rows.join(moved.select("id"), "id", "left_anti"), wide.drop(*there)
