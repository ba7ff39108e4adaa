"""Size-tiered compaction of immutable shards under a versioned manifest.

``append`` writes an arrival as small Parquet shards; ``compact`` merges shards
of a similar size into files of the target size; both end by committing a new
manifest version. A manifest is a Parquet table of live files, written to a
temporary folder and renamed to its version number; the rename fails if that
number exists, so of two writers one wins and the other raises. Readers take the
highest version; files are never changed, and a version stays readable until
``vacuum`` drops it.

A merge reads the shards of one tier and narrows the scan to as many tasks as
files shall come out, without a shuffle: the shards of a tier differ in size by
the fan-out at most, so the tasks are even, and rows stream through in bounded
memory. Merged files rise to the next tier until they reach the target; each row
is rewritten at most once a tier.

Defined results: rows are kept as they are, with all columns, nulls and repeats;
an empty arrival adds no shard but commits a version; an empty set reads as an
empty table with the schema of its last arrival.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.llm.text import crc_mod
from lodestone.llm.workspace import scratch, table

MANIFEST = "path string, bytes bigint, run string, note string"


class ShardSet:
    """A folder of shards with its manifests.

    target_bytes: size of a finished file. base_bytes: upper end of tier 0.
    fanout: ratio of sizes between tiers, and the number of files that triggers a merge.
    merge_files: most files that one merge job takes; more are merged in further jobs.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 64 << 20, base_bytes: int = 1 << 20, fanout: int = 4, merge_files: int = 4096):
        self.spark, self.root, self.target, self.base, self.fanout, self.merge_files = spark, root.rstrip("/"), target_bytes, base_bytes, fanout, merge_files
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        """Committed versions in ascending order."""
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(x[1:]) for x in names if x.startswith("v") and x[1:].isdigit())

    def manifest(self, version: int | None = None) -> DataFrame:
        """Live files of a version, the latest by default."""
        have = self.versions()
        if not have:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v{have[-1] if version is None else version:010d}")

    def _commit(self, entries: DataFrame, schema: str, after: int) -> int:
        """Write the manifest that follows version ``after``; raises if another writer was first."""
        temporary = f"{self.root}/manifest/_{uuid.uuid4().hex}"
        note = self.spark.createDataFrame([("", 0, "", schema)], MANIFEST)
        entries.where("path <> ''").unionByName(note).coalesce(1).write.parquet(temporary)
        final = f"{self.root}/manifest/v{after + 1:010d}"
        jvm = self.spark.sparkContext._jvm
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf).rename(self._path(temporary), self._path(final), none)
        return after + 1

    def _written(self, folder: str, run: str) -> DataFrame:
        rows = [(str(s.getPath().toString()), int(s.getLen()), run, "") for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().startswith("part-")]
        return self.spark.createDataFrame(rows, MANIFEST)

    def _write(self, df: DataFrame) -> DataFrame:
        run = uuid.uuid4().hex
        folder = f"{self.root}/data/{run}"
        df.write.option("compression", "zstd").parquet(folder)
        return self._written(folder, run)

    def append(self, df: DataFrame) -> int:
        """Add the rows of ``df`` as small shards, one of each of its partitions, and commit."""
        have = self.versions()
        new = self._write(df)
        return self._commit(self.manifest().unionByName(new), df.schema.json(), have[-1] if have else 0)

    def tier(self, size: int) -> int:
        """Tier of a file; -1 for a file that has reached half the target."""
        return -1 if 2 * size >= self.target else max(0, math.ceil(math.log(max(size, 1) / self.base, self.fanout)))

    def compact(self) -> int:
        """Merge until no tier holds ``fanout`` files; commit each round and return the version."""
        while True:
            have = self.versions()
            if not have:
                return 0
            listed = self.manifest().collect()  # one row a file, as the driver of any scan holds
            schema = next(r["note"] for r in listed if not r["path"])
            tiers: dict[int, list] = {}
            for r in listed:
                if r["path"]:
                    tiers.setdefault(self.tier(r["bytes"]), []).append(r)
            merged = None
            gone: set[str] = set()
            for level, files in sorted(tiers.items()):
                if level < 0 or len(files) < self.fanout:
                    continue
                files.sort(key=lambda r: (r["bytes"], r["path"]))
                for at in range(0, len(files), self.merge_files):
                    part = files[at : at + self.merge_files]
                    if len(part) < self.fanout:
                        continue
                    n = max(1, round(sum(r["bytes"] for r in part) / self.target))
                    if n >= len(part):
                        continue
                    rows = self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*[r["path"] for r in part])
                    new = self._write(rows.coalesce(n))
                    merged = new if merged is None else merged.unionByName(new)
                    gone |= {r["path"] for r in part}
            if merged is None:
                return have[-1]
            kept = self.spark.createDataFrame([tuple(r) for r in listed if r["path"] and r["path"] not in gone], MANIFEST)
            self._commit(kept.unionByName(merged), schema, have[-1])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest by default."""
        rows = self.manifest(version).collect()
        if not rows:
            raise ValueError(f"no version of {self.root}")
        schema = StructType.fromJson(json.loads(next(r["note"] for r in rows if not r["path"])))
        paths = [r["path"] for r in rows if r["path"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 1, abandoned_s: float = 86_400.0) -> None:
        """Drop all but the last ``keep`` versions and the files that only they name.

        What a writer left that was lost before its commit goes as well: folders that no kept version names, untouched for
        ``abandoned_s`` seconds, which must be longer than any write takes.
        """
        have = self.versions()
        named = [r for v in have[-keep:] for r in self.manifest(v).collect()]
        live, runs = {r["path"] for r in named}, {r["run"] for r in named}
        for v in have[:-keep]:
            for r in self.manifest(v).collect():
                if r["path"] and r["path"] not in live:
                    self._fs.delete(self._path(r["path"]), False)
            self._fs.delete(self._path(f"{self.root}/manifest/v{v:010d}"), True)
        for parent, lost in (("data", lambda n: n not in runs), ("manifest", lambda n: n.startswith("_"))):
            folder = self._path(f"{self.root}/{parent}")
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else ():
                if lost(s.getPath().getName()) and time.time() - s.getModificationTime() / 1000 >= abandoned_s:
                    self._fs.delete(s.getPath(), True)


#: Arrivals that the query and the pipeline stage split a table into.
ARRIVALS = 4


def ingest(docs: DataFrame, arrivals: int = ARRIVALS, **sizes) -> ShardSet:
    """Append ``docs`` in arrivals dealt by the crc32 of ``doc_id``, compact and vacuum."""
    spark = docs.sparkSession
    shards = ShardSet(spark, scratch(spark, "shards"), **sizes)
    for k in range(arrivals):
        shards.append(docs.where(crc_mod(F.col("doc_id"), arrivals) == k))
    shards.compact()
    shards.vacuum()
    return shards


def op2_sharding(spark, sf_dir):
    """All documents through arrivals, compaction and the manifest, read back and digested."""
    back = ingest(table(spark, sf_dir, "documents")).read()
    return back.select("doc_id", "lang", "source", "n_chars", F.char_length("text").cast("long").alias("text_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


ORACLE = "SELECT doc_id, lang, source, n_chars, length(text) AS text_chars, md5(text) AS text_md5 FROM documents"
