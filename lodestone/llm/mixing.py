"""Temperature mixing of sources to target weights.

Each source's share of tokens is raised to an exponent between 0 and 1 and
normalised. The exponent is bisected to meet a limit on repetition (the smallest
one under which no source is passed over more than ``max_repeats`` times) or a
target entropy (the largest one whose weights reach it). A budget of tokens then
becomes whole epochs of each source and one partial epoch.

Every epoch passes over the documents of a source in another order: the source is
cut into blocks by the leading bits of a hash, about ``BLOCK`` documents each; an
epoch permutes the blocks, and the documents inside each, by hashes that contain
its number. The partial epoch takes the documents that come first in its order
and fit in its remaining budget. Block sums are pre-aggregated and summed over
blocks, and only inside one block are documents summed, so a source with a third
of all rows is as many small tasks; one task orders the blocks of a source.

A drawn copy has its epoch, its block, the tokens of its source drawn before that
block and its position in the block. Taking blocks by these tokens, as a share of
the source's budget, interleaves the sources at their weights all along.

Defined results: a null source is a source of its own; a null text has no
tokens; a source without tokens is passed over once; repeated rows are drawn
each by itself, so equal rows come as often as all of them together are drawn.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType

from lodestone.llm.text import split_words
from lodestone.llm.workspace import fresh, hinted, join_classes, materialise, settled, table

#: Documents a block, about.
BLOCK = 256
#: Sources that the driver may plan for; more raise an error.
MAX_SOURCES = 1_000_000


def weights(tokens: list[int], exponent: float) -> list[float]:
    """Normalised powers of the token shares; a source without tokens gets none."""
    n = sum(tokens)
    powers = [(t / n) ** exponent if t else 0.0 for t in tokens]
    return [x / sum(powers) for x in powers]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def least_budget(tokens: list[int], w: list[float]) -> float:
    """The smallest budget that passes over every source once at least."""
    return max(t / x for t, x in zip(tokens, w, strict=True) if t)


def exponent_for(tokens: list[int], max_repeats: float | None = None, target_entropy: float | None = None, budget: int | None = None) -> float:
    """Bisect the exponent, rounded to six places."""
    if (max_repeats is None) == (target_entropy is None):
        raise ValueError("give max_repeats or target_entropy")
    if not any(tokens):
        return 1.0

    def fits(a: float) -> bool:
        w = weights(tokens, a)
        if target_entropy is not None:
            return entropy(w) < target_entropy
        b = budget or least_budget(tokens, w)
        return max(x * b / t for t, x in zip(tokens, w, strict=True) if t) <= max_repeats

    low, high = 0.0, 1.0
    if fits(low):
        return 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    if target_entropy is not None:
        return math.floor(low * 1e6) / 1e6
    return math.ceil(high * 1e6) / 1e6


def _without_maps(value: Column, kind: DataType) -> Column:
    """``value`` with every map in it, at any depth, as its sorted entries, so that it can be hashed."""
    if "map<" not in kind.simpleString():
        return value
    if isinstance(kind, MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(_without_maps(e["key"], kind.keyType).alias("key"), _without_maps(e["value"], kind.valueType).alias("value")))
        return F.array_sort(entries)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _without_maps(x, kind.elementType))
    fields = [_without_maps(value.getField(f.name), f.dataType).alias(f"f{k}") for k, f in enumerate(kind.fields)]
    return F.when(value.isNotNull(), F.struct(*fields))


def _row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row; the entries of maps count in sorted order."""
    cols = [_without_maps(F.col(f"`{f.name}`"), f.dataType) for f in docs.schema]
    return F.xxhash64(*cols, F.concat(*[F.isnull(c).cast("int").cast("string") for c in cols]))


def _text_md5(docs: DataFrame) -> Column:
    return F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))


def mix(docs: DataFrame, max_repeats: float | None = 1.5, target_entropy: float | None = None, budget: int | None = None, seed: int = 42) -> DataFrame:
    """``doc_id, source, n_tokens, text_md5, row_hash, equal, epoch, block, block_start, position, budget``, one row a drawn copy.

    block_start: tokens of the source drawn before the block. position: from 1 in the block.
    equal: how many equal rows there are. budget, of the result: tokens of the source to draw.
    budget, as an argument: tokens to draw; None for the least that passes over every source once.
    """
    spark = docs.sparkSession
    return settled(spark, "mixed", lambda: _mix(docs, max_repeats, target_entropy, budget, seed))


def _mix(docs: DataFrame, max_repeats: float | None, target_entropy: float | None, budget: int | None, seed: int) -> DataFrame:
    spark, name = docs.sparkSession, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    sized = docs.select("doc_id", "source", F.size(split_words(F.col("text"))).cast("long").alias("n_tokens"), _text_md5(docs).alias("text_md5"), _row_hash(docs).alias("row_hash"))
    sized = materialise(sized, "sized")
    totals = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r["source"] is not None, r["source"] or ""))
    tokens = [r["tokens"] for r in totals]
    a = exponent_for(tokens, max_repeats, target_entropy, budget)
    w = weights(tokens, a) if any(tokens) else [0.0] * len(tokens)
    total = (budget or least_budget(tokens, w)) if any(tokens) else 0
    rows = []
    for number, (r, x) in enumerate(zip(totals, w, strict=True)):
        want = math.floor(x * total + 0.5)
        epochs, rest = divmod(want, r["tokens"]) if r["tokens"] else (1, 0)
        rows.append((r["source"], number, r["tokens"], want, epochs, rest, max(0, math.ceil(math.log2(max(1, r["n_docs"] / BLOCK))))))
    plan = spark.createDataFrame(rows, "plan_source string, number int, tokens bigint, want bigint, epochs bigint, rest bigint, bits int")
    placed = sized.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")  # MAX_SOURCES bounds the plan
    # the leading bits of the key; integer arithmetic on its first eight hex digits
    lead = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), 1, 8), 16, 10).cast("long")
    placed = placed.withColumn("block", F.floor(lead / F.pow(F.lit(2.0), 32 - F.col("bits"))).cast("long"))
    many = F.col("epochs") + F.when(F.col("rest") > 0, 1).otherwise(0)
    sums = placed.groupBy("number", "block", "tokens", "epochs", "rest").agg(F.sum("n_tokens").alias("block_tokens")).where(many > 0)
    sums = sums.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("block").cast("string")).cast("binary"))
    run = Window.partitionBy("number", "epoch").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.withColumn("before", F.coalesce(F.sum("block_tokens").over(run), F.lit(0)))
    blocks = blocks.where((F.col("epoch") < F.col("epochs")) | (F.col("before") <= F.col("rest"))).select("number", "block", "epoch", "before")
    drawn = placed.join(hinted(materialise(blocks, "blocks"), 64), ["number", "block"])
    inner = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), name).cast("binary"))
    inside = Window.partitionBy("number", "block", "epoch").orderBy("inner", "text_md5", "row_hash")
    drawn = drawn.withColumn("inner", inner).withColumns({"upto": F.col("before") + F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "position": F.row_number().over(inside).cast("long")})
    drawn = drawn.where((F.col("epoch") < F.col("epochs")) | (F.col("upto") <= F.col("rest")))
    equal = materialise(sized.groupBy("text_md5", "row_hash").agg(F.count("*").alias("c")).where("c > 1"), "equal").withColumn("equal", F.col("c"))
    drawn = join_classes(drawn, equal, ["text_md5", "row_hash"], "left") if equal.limit(1).count() else drawn.withColumn("equal", F.lit(1).cast("long"))
    start = (F.col("epoch") * F.col("tokens") + F.col("before")).alias("block_start")
    return drawn.select("doc_id", "source", "n_tokens", "text_md5", "row_hash", F.coalesce("equal", F.lit(1).cast("long")).alias("equal"), "epoch", "block", start, "position", F.col("want").alias("budget"))


def draw(docs: DataFrame, mixed: DataFrame, ordered: bool = False) -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` says.

    ordered: sorted over all partitions by the share of its source's budget at which a
    copy's block begins, then by source, block and position.
    """
    md5, row = fresh(docs, "text_md5"), fresh(docs, "row_hash")
    keyed = docs.withColumns({md5: _text_md5(docs), row: _row_hash(docs)})
    copy = F.struct((F.col("block_start") / F.greatest(F.col("budget"), F.lit(1))).alias("share"), "source", "epoch", "block", "position")
    times = mixed.groupBy(F.col("text_md5").alias("key_md5"), F.col("row_hash").alias("key_row")).agg(F.max("equal").alias("equal"), F.collect_list(copy).alias("copies") if ordered else F.count("*").alias("copies"))
    times = times.select(F.struct("key_md5", "key_row", "equal", "copies").alias(fresh(keyed, "drawn")))
    t = fresh(keyed, "drawn")
    joined = keyed.join(times, (F.col(md5) == F.col(f"{t}.key_md5")) & (F.col(row) == F.col(f"{t}.key_row")))
    if mixed.where("equal > 1").limit(1).count():  # one of equal rows stands for all their copies
        joined = joined.where(F.col(f"{t}.equal") == 1).unionByName(joined.where(F.col(f"{t}.equal") > 1).dropDuplicates([md5, row]))
    c = fresh(joined, "copy")
    joined = joined.withColumn(c, F.explode(F.col(f"{t}.copies") if ordered else F.sequence(F.lit(1).cast("long"), F.col(f"{t}.copies"))))
    if ordered:
        joined = joined.repartitionByRange(c).sortWithinPartitions(c)
    return joined.select(*[F.col(f"`{x}`") for x in docs.columns])


def op4_mixing(spark, sf_dir):
    """Every drawn copy and its place in the permuted blocks, when sources are mixed at most 1.5 times over."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_tokens", "epoch", "block", "block_start", "position")


ORACLE = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens,
         coalesce(CAST(doc_id AS VARCHAR), '') AS name, md5(coalesce(text, '')) AS text_md5 FROM documents
), totals AS (SELECT source, CAST(sum(n_tokens) AS DOUBLE) AS tokens, CASE WHEN count(*) <= 256 THEN 0 ELSE CAST(ceil(log2(count(*) / 256.0)) AS INTEGER) END AS bits FROM sized GROUP BY source
), shares AS (SELECT source, tokens, tokens / (SELECT sum(tokens) FROM totals) AS p FROM totals WHERE tokens > 0
), edge AS (SELECT max(p) AS top, min(p) AS low FROM shares
), bisect(k, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT k + 1, CASE WHEN pow(top / low, 1 - (lo + hi) / 2) <= 1.5 THEN lo ELSE (lo + hi) / 2 END,
         CASE WHEN pow(top / low, 1 - (lo + hi) / 2) <= 1.5 THEN (lo + hi) / 2 ELSE hi END
  FROM bisect, edge WHERE k < 60
), chosen AS (SELECT CASE WHEN top / low <= 1.5 THEN CAST(0 AS DOUBLE) ELSE ceil(hi * 1000000) / 1000000 END AS a FROM bisect, edge WHERE k = 60
), powers AS (SELECT source, tokens, pow(p, a) AS x FROM shares, chosen
), w AS (SELECT source, tokens, x / (SELECT sum(x) FROM powers) AS w FROM powers
), plan AS (
  SELECT t.source, t.tokens, t.bits, CASE WHEN t.tokens > 0 THEN floor(w.w * (SELECT max(tokens / w) FROM w) + CAST(0.5 AS DOUBLE)) ELSE 0 END AS want
  FROM totals t LEFT JOIN w ON t.source IS NOT DISTINCT FROM w.source
), cut AS (
  SELECT source, CAST(tokens AS BIGINT) AS tokens, bits, CASE WHEN tokens > 0 THEN CAST(floor(want / tokens) AS BIGINT) ELSE 1 END AS epochs,
         CASE WHEN tokens > 0 THEN CAST(want - floor(want / tokens) * tokens AS BIGINT) ELSE 0 END AS rest FROM plan
), placed AS (
  SELECT s.*, c.tokens, c.epochs, c.rest, CAST(floor(CAST('0x' || substr(md5('42:' || name), 1, 8) AS BIGINT) / pow(2, 32 - bits)) AS BIGINT) AS block,
         unnest(range(0, c.epochs + CASE WHEN c.rest > 0 THEN 1 ELSE 0 END)) AS epoch
  FROM sized s JOIN cut c ON s.source IS NOT DISTINCT FROM c.source
), ranked AS (
  SELECT *, md5('42:' || epoch || ':' || block) AS outer_key, md5('42:' || epoch || ':' || name) AS inner_key FROM placed
), summed AS (
  SELECT *, row_number() OVER (PARTITION BY source, epoch, block ORDER BY inner_key, text_md5) AS position,
         sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY outer_key, block, inner_key, text_md5 ROWS UNBOUNDED PRECEDING) AS upto,
         sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY outer_key, block) - sum(n_tokens) OVER (PARTITION BY source, epoch, block) AS before
  FROM ranked
)
SELECT doc_id, source, n_tokens, epoch, block, CAST(epoch * tokens + before AS BIGINT) AS block_start, position FROM summed WHERE epoch < epochs OR upto <= rest
"""
