"""Chunks bounded by tokens that follow the structure of a document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: What ``hybrid_chunks`` returns, next to the document's id.
CHUNK = "section int, part int, n_tokens int, first_pos int, last_pos int, headings array<string>, refs array<string>, labels array<string>, content string"


def words(text: Column) -> Column:
    """Blank-separated words, the tokens where no others are given."""
    return F.filter(F.split(text, " "), lambda x: x != "")


def hybrid_chunks(items: DataFrame, most: int, merge: bool = True, tokens: Callable[[Column], Column] = words) -> DataFrame:
    """``doc_id`` and ``CHUNK`` of items ``doc_id, position, label, text, self_ref``, in reading order.

    A section is what follows a header; its chunks carry the header's text as heading and, with it, hold at most ``most``
    tokens (one at least, if the heading alone is longer). Longer items are cut into pieces; with ``merge``, pieces of one
    section are joined by newlines while they fit. Headers and blank items are no chunks of their own; a null text is blank.
    Merging depends on what was merged before, so it runs over the sorted pieces of whole documents in Arrow batches and
    holds one chunk at a time; one shuffle by document serves the windows and this.
    """
    order = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("label") == "section_header"
    i = items.repartition("doc_id").withColumns({"section": F.sum(head.cast("int")).over(order).cast("int"), "heading": F.last(F.when(head, F.col("text")), True).over(order)})
    i = i.where(~head & (F.trim("text") != "")).withColumn("w", tokens(F.col("text")))
    room = F.greatest(F.lit(most) - F.coalesce(F.size(tokens(F.col("heading"))), F.lit(0)), F.lit(1))
    room = F.when(F.col("heading").isNull(), F.lit(most)).otherwise(room)
    i = i.withColumn("room", room.cast("int"))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("w") / F.col("room")).cast("int") - 1, F.lit(0)))
    cut = i.withColumn("n_pieces", F.size(starts)).withColumn("piece", F.explode(starts))
    words_of = F.slice("w", F.col("piece") * F.col("room") + 1, F.col("room"))
    text = F.when(F.col("n_pieces") == 1, F.col("text")).otherwise(F.array_join(words_of, " "))
    pieces = cut.select("doc_id", "section", "position", "piece", F.size(words_of).alias("n"), "room", "heading", "self_ref", "label", text.alias("text")).sortWithinPartitions("doc_id", "section", "position", "piece")
    schema = StructType([items.schema["doc_id"], *StructType.fromDDL(CHUNK).fields])
    arrow = to_arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = None
        for batch in batches:
            done = []
            for doc, section, position, _, n, room, heading, ref, label, said in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                same = chunk is not None and (chunk["doc_id"], chunk["section"]) == (doc, section)
                if merge and same and chunk["n_tokens"] + n <= room:
                    chunk["n_tokens"] += n
                    chunk["last_pos"] = position
                else:
                    if chunk is not None:
                        done.append(_closed(chunk))
                    part = chunk["part"] + 1 if same else 0
                    chunk = {"doc_id": doc, "section": section, "part": part, "n_tokens": n, "first_pos": position, "last_pos": position, "headings": [] if heading is None else [heading], "refs": [], "labels": [], "content": []}
                for column, value in (("refs", ref), ("labels", label), ("content", said)):
                    chunk[column].append(value)
            if done:
                yield pa.RecordBatch.from_pylist(done, arrow)
        if chunk is not None:
            yield pa.RecordBatch.from_pylist([_closed(chunk)], arrow)

    return pieces.mapInArrow(pack, schema)


def _closed(chunk: dict) -> dict:
    return chunk | {"refs": list(dict.fromkeys(chunk["refs"])), "labels": list(dict.fromkeys(chunk["labels"])), "content": "\n".join(chunk["content"])}
