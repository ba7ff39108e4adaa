"""Shared scratch folder, materialisation and size-checked broadcasts.

On a cluster the driver and the executors share one folder only, the one named
by ``spark.checkpoint.dir``; every intermediate table is written below it. The
setting is read from the session, and set by us only where it is absent and the
master is local (tests).
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only when its estimated size is under this bound.
BROADCAST_BYTES = 48 * 1024 * 1024


#: Rows of one key from which its partner is broadcast, at least, and most of such keys: no other key has more than that part of all rows.
HOT_ROWS, HOT_KEYS = 256, 8_192

_made = threading.local()  # folders of the tables made inside each open ``settled``


def shared_root(spark: SparkSession) -> str:
    """Folder that all executors see; a temporary one only for a local master."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by the executors")
        root = tempfile.mkdtemp(prefix="lodestone-")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; cuts the lineage."""
    path = scratch(df.sparkSession, tag)
    for made in getattr(_made, "stack", [])[-1:]:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, tag: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``materialise(build())``; the tables that ``build`` made by ``materialise`` are deleted then, or if it fails."""
    stack = _made.stack = getattr(_made, "stack", [])
    stack.append([])
    path = scratch(spark, tag)
    try:
        df = build()
        df.write.option("compression", "zstd").parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    finally:
        for made in stack.pop():
            remove(spark, made)
    for made in stack[-1:]:
        made.append(path)
    return out


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialised table that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` (materialised, so counting is cheap) fits a broadcast."""
    return df.count() * row_bytes <= limit


def least_count(df: DataFrame, count: str, most: int) -> int:
    """The least count such that at most ``most`` rows of ``df`` (materialised) have it or a greater one.

    Counts are whole numbers. A count whose rows don't all fit is left out, and so are the smaller ones.
    """
    least, kept = (1 << 63) - 1, 0
    for r in df.groupBy(F.col(count).alias("c")).agg(F.count("*").alias("v")).orderBy(F.desc("c")).limit(most).collect():
        kept += r["v"]
        if kept > most:
            break
        least = r["c"]
    return least


def hinted(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` when its counted size is in bounds, else ``df`` for a shuffled join."""
    return F.broadcast(df) if small(df, row_bytes, limit) else df


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``classes``, which is materialised, has each of ``keys`` once, and in ``c`` how many rows have them.

    A key of many rows would be one task, so the classes of such keys are broadcast.
    By ``c`` these are ``HOT_KEYS`` at most; the other keys are joined after a shuffle.
    """
    found = classes.agg(F.sum("c"), F.max("c")).first()
    if (found[1] or 0) < HOT_ROWS:
        return rows.join(classes.drop("c"), keys, how)
    hot = F.col("c") >= max(HOT_ROWS, -(-found[0] // HOT_KEYS))
    often = F.broadcast(classes.where(hot).drop("c"))
    rest = rows.join(F.broadcast(classes.where(hot).select(*keys)), keys, "left_anti").join(classes.where(~hot).drop("c"), keys, how)
    return rows.join(often, keys).unionByName(rest)


def bound_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Let Python workers get few rows and bytes at a time, since texts may be very long.

    A setting of the session, since it is read when a plan runs; a smaller one stays.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).rstrip("bB")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_sample(rows: DataFrame, by: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """About ``most`` rows of each value of ``by`` at most, chosen by a hash of the id.

    The share of each value comes from its count, so no value is sorted or gathered in one task.
    """
    counts = materialise(rows.groupBy(by).agg(F.count("*").alias("_n")), "sample_counts").withColumnRenamed(by, "_by")
    u = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    return rows.join(hinted(counts, 64), F.col(by).eqNullSafe(F.col("_by"))).where(u < most / F.col("_n")).drop("_by", "_n")
