"""Evidence of a conversation: declarations, their status, citations and the capsule of what was cited.

Events are ``conv, capability, seq, kind, question, epoch, chunk_ids`` with kind begin, evidence, declare or end. The
fold runs over the sorted events of one capability in one conversation, which is bounded by its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_START = "named_struct('question', cast(null as bigint), 'epoch', 0L, 'd_question', cast(null as bigint), 'd_epoch', 0L, 'refs', cast(array() as array<string>))"
_STEP = """CASE e.kind
  WHEN 'begin' THEN named_struct('question', e.question, 'epoch', 0L, 'd_question', cast(null as bigint), 'd_epoch', 0L, 'refs', cast(array() as array<string>))
  WHEN 'evidence' THEN named_struct('question', s.question, 'epoch', greatest(s.epoch, e.epoch), 'd_question', s.d_question, 'd_epoch', s.d_epoch, 'refs', s.refs)
  WHEN 'declare' THEN IF(s.d_question = s.question AND s.epoch <= s.d_epoch,
    named_struct('question', s.question, 'epoch', s.epoch, 'd_question', s.d_question, 'd_epoch', greatest(s.d_epoch, e.epoch), 'refs', array_union(s.refs, e.chunk_ids)),
    named_struct('question', s.question, 'epoch', s.epoch, 'd_question', s.question, 'd_epoch', e.epoch, 'refs', array_distinct(e.chunk_ids)))
  ELSE s END"""


def ledgers(events: DataFrame) -> DataFrame:
    """``conv, capability, question, epoch, d_question, d_epoch, refs`` after all events.

    A declaration merges into the standing one while no evidence followed that, else it replaces it.
    """
    refs = F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids")
    e = F.struct("seq", "kind", F.col("question").cast("long").alias("question"), F.coalesce(F.col("epoch").cast("long"), F.lit(0)).alias("epoch"), refs)
    folded = events.groupBy("conv", "capability").agg(F.sort_array(F.collect_list(e)).alias("es"))
    return folded.select("conv", "capability", F.expr(f"aggregate(es, {_START}, (s, e) -> {_STEP})").alias("s")).select("conv", "capability", "s.*")


def citation_status(events: DataFrame) -> DataFrame:
    """``conv, question, status``: grounded or ungrounded by declarations after the newest evidence of every capability, else missing."""
    state = ledgers(events)
    top = state.groupBy("conv").agg(F.max("question").alias("now"), F.max("epoch").alias("horizon"))
    current = (F.col("d_question") == F.col("now")) & (F.col("d_epoch") > F.col("horizon"))
    joined = state.join(top, "conv").groupBy("conv", "now").agg(F.max(current).alias("any"), F.max(current & (F.size("refs") > 0)).alias("refs"))
    status = F.when(F.col("refs"), "grounded").when(F.col("any"), "ungrounded").otherwise("missing")
    return joined.select("conv", F.col("now").alias("question"), status.alias("status"))


def regressions(events: DataFrame) -> DataFrame:
    """Events that an append-only history can't hold: a question not past the last, or an epoch behind its question's."""
    seen = Window.partitionBy("conv", "capability").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    e = events.withColumn("last_q", F.max(F.when(F.col("kind") == "begin", F.col("question"))).over(seen))
    e = e.withColumn("nth", F.sum((F.col("kind") == "begin").cast("int")).over(Window.partitionBy("conv", "capability").orderBy("seq")))
    before = Window.partitionBy("conv", "capability", "nth").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("last_e", F.max(F.when(F.col("kind").isin("evidence", "declare"), F.col("epoch"))).over(before))
    bad = F.when(F.col("kind") == "begin", F.col("question") <= F.col("last_q")).otherwise(F.col("epoch") < F.col("last_e"))
    return e.where(bad).select(*events.columns)


def capsule(cited: DataFrame) -> DataFrame:
    """``conv, grp, capability, chunk_id, question``: each cited chunk once, in the group of its newest question, newest first."""
    newest = cited.groupBy("conv", "capability", "chunk_id").agg(F.max("question").alias("question"))
    return newest.withColumn("grp", F.dense_rank().over(Window.partitionBy("conv").orderBy(F.desc("question"))).cast("long"))


def resolve_citations(cited: DataFrame, results: DataFrame) -> DataFrame:
    """``conv, seq, chunk_id, content, number``: citations found among results; of results with one id the last counts.

    Numbers follow the first citation of each chunk.
    """
    last = results.withColumn("rn", F.row_number().over(Window.partitionBy("conv", "chunk_id").orderBy(F.desc("rank")))).where("rn = 1").select("conv", "chunk_id", "content")
    found = cited.select("conv", "seq", "chunk_id").join(last, ["conv", "chunk_id"])
    found = found.withColumn("first", F.min("seq").over(Window.partitionBy("conv", "chunk_id")))
    return found.withColumn("number", F.dense_rank().over(Window.partitionBy("conv").orderBy("first", "chunk_id")).cast("long")).drop("first")


def over_budget(searches: DataFrame, most: int) -> DataFrame:
    """Searches past the first ``most`` of their question."""
    nth = F.row_number().over(Window.partitionBy("conv", "question").orderBy("seq"))
    return searches.withColumn("nth", nth).where(F.col("nth") > most).drop("nth")


def compact(messages: DataFrame, boundary: int, owned: list[str], capsule_text: str) -> DataFrame:
    """Before ``boundary``, returns of owned tools become receipts, but the newest one carries the capsule."""
    mine = (F.col("seq") < boundary) & F.col("tool").isin(*owned)
    newest = F.max(F.when(mine, F.col("seq"))).over(Window.partitionBy("conv"))
    text = F.when(~F.coalesce(mine, F.lit(False)), F.col("text")).when(F.col("seq") == newest, F.lit(capsule_text)).otherwise(F.concat(F.lit("[compacted] "), "tool"))
    return messages.withColumn("text", text)


def transcripts(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, transcript``: all turns before each user turn, and that turn, a line each."""
    line = F.concat_ws(": ", "role", F.coalesce("text", F.lit("")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(Window.unboundedPreceding, 0)
    told = turns.withColumn("transcript", F.array_join(F.collect_list(line).over(order), "\n"))
    return told.where("role = 'user'").select("conv_id", "turn", "transcript")
