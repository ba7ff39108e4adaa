"""Corpus views over the test tables, and small helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a side that may be broadcast, about.
BROADCAST_BYTES = 48 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(df: DataFrame) -> Column:
    """Bytes of a row, about: those of texts, eight for each element of other arrays and each other column, and some for the row."""
    out = F.lit(32)
    for f in df.schema:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        size = F.octet_length(c) if kind in ("string", "binary") else F.octet_length(F.to_json(F.struct(c))) if "string" in kind else 8 * F.size(c) if kind.startswith("array") else F.lit(8)
        out = out + F.coalesce(F.greatest(size, F.lit(0)), F.lit(0))
    return out


def sized(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` when its measured size is at most ``most`` bytes, else ``df``."""
    return F.broadcast(df) if (df.agg(F.sum(width(df))).first()[0] or 0) <= most else df


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; below a temporary one only for a local master."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by the executors")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written below the shared folder and read back, for a small result that several steps read."""
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def meta(docs: DataFrame) -> DataFrame:
    """One row of mutable metadata for each document."""
    return docs.select(
        "doc_id", F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("doc://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("uri"),
        F.concat("lang", F.lit(" document "), F.col("doc_id").cast("string")).alias("title"), "lang", "source", "n_chars",
    )


def items(docs: DataFrame) -> DataFrame:
    """Reading-order items: a line each, labelled by its length."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "text"))
    label = F.when(F.trim("text") == "", "page_footer").when(F.length("text") <= 60, "section_header").otherwise("text")
    return lines.withColumn("label", label)


def chunks(docs: DataFrame, size: int = 50) -> DataFrame:
    """Chunks of ``size`` blank-separated words, numbered from 0."""
    words = docs.select("doc_id", F.split("text", " ").alias("w"))
    n = F.ceil(F.size("w") / size).cast("int")
    cut = words.select("doc_id", "w", F.explode(F.sequence(F.lit(0), n - 1)).alias("ord"))
    return cut.select("doc_id", "ord", F.array_join(F.slice("w", F.col("ord") * size + 1, F.lit(size)), " ").alias("content"))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two float arrays, summed from the left in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def tokens(text: Column) -> Column:
    """Lower-cased runs of a to z and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")
