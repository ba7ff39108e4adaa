"""Streaming forms: watched folders, queue intake, rolling counts and the breaker as state.

File streams never report deletions; ``swept`` finds them in a stream of whole listings, ``sources.files.discover`` in two.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestone.operators.queue import error_class


#: States that the addresses of a sweep are dealt to; one of them is read and written whole.
BUCKETS = 1 << 14
#: What the ``binaryFile`` source gives.
FILE = "path string, modificationTime timestamp, length long, content binary"


def watched(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of ``uri, revision, length, content_hash`` of files that appear below a folder."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(root)
    return files.select(F.col("path").alias("uri"), F.unix_micros("modificationTime").cast("string").alias("revision"), "length", F.md5("content").alias("content_hash"))


def intake(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events ``source_id, uri, ts``, one of each key within the delay (any, of those in one batch); state older than the watermark is dropped."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["source_id", "uri"])


def rolling(stream: DataFrame, size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """``source_id, start, n, failures`` of windows of event time; rows later than the delay are left out."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    counted = stream.withWatermark("ts", delay).groupBy("source_id", w.alias("w")).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("failures"))
    return counted.select("source_id", F.col("w.start").alias("start"), "n", "failures")


def sessions(stream: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    """``source_id, start, end, n`` of runs of events with no pause as long as ``gap``."""
    g = stream.withWatermark("ts", delay).groupBy("source_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("source_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def breaker_states(stream: DataFrame, threshold: int, cooldown_seconds: float) -> DataFrame:
    """``source_id, failures, opened_at`` after each batch of ``source_id, seq, ts, ok, kind, http_status``.

    Only transient failures count; a success closes the breaker, a failure at or past the threshold opens it anew. The
    state of a source is two numbers, and its rows of a batch come in Arrow batches.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        failures, opened = state.get if state.exists else (0, None)
        rows = pd.concat(list(batches))[["seq", "ts", "ok"]].sort_values(["seq"])
        for ts, ok in zip(rows["ts"], rows["ok"]):
            if ok:
                failures, opened = 0, None
            else:
                failures += 1
                opened = ts.timestamp() if failures >= threshold else opened
        state.update((failures, opened))
        yield pd.DataFrame({"source_id": [key[0]], "failures": [failures], "opened_at": [opened], "open_until": [None if opened is None else opened + cooldown_seconds]})

    told = stream.where(F.col("ok") | (error_class(F.col("kind"), F.col("http_status")) == "transient"))
    return told.groupBy("source_id").applyInPandasWithState(
        step, "source_id string, failures long, opened_at double, open_until double", "failures long, opened_at double", "update", "NoTimeout"
    )


class _Sweep(StatefulProcessor):
    """State of the addresses of a bucket: the revision last listed, when, and the time at which it counts as gone.

    The timer is a millisecond before the first of these times. State and timers cost several calls of the JVM each time, so
    they are kept for a bucket and not for each address.
    """

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "held string, first long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held, first = self._held()
        listed: dict = {}
        for r in rows:
            if r["ms"] is not None:
                listed.setdefault(r["uri"], set()).add((r["ms"], r["revision"]))
        changed = False
        for uri, some in listed.items():
            now = before = held.get(uri)
            for at, revision in sorted(some, key=lambda x: (x[0], x[1] or "")):
                if now is not None and at < now[1]:
                    continue
                if now is not None and at > now[2]:
                    yield Row(uri=uri, action="DELETE", revision=now[0], at=now[2])
                    now = None
                if now is None or now[0] != revision:
                    yield Row(uri=uri, action="UPSERT", revision=revision, at=at)
                now = [revision, at, at + self.patience_ms]
            held[uri] = now
            changed = changed or now != before
        if changed:
            self._keep(held, first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        held, _ = self._held()
        over = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        for uri in [u for u, (_, _, due) in held.items() if due - 1 <= over]:
            revision, _, due = held.pop(uri)
            yield Row(uri=uri, action="DELETE", revision=revision, at=due)
        self._keep(held, None)  # the timer that went off is gone

    def _held(self) -> tuple[dict, int | None]:
        state = self.seen.get()
        return ({}, None) if state is None else ({u: [*x] for u, *x in json.loads(state[0])}, state[1])

    def _keep(self, held: dict, before: int | None) -> None:
        first = min((due for _, _, due in held.values()), default=None)
        if first != before:
            if before is not None:
                self.handle.deleteTimer(before - 1)
            if first is not None:
                self.handle.registerTimer(first - 1)
        if held:
            self.seen.update((json.dumps([[u, *x] for u, x in held.items()]), first))
        else:
            self.seen.clear()

    def close(self) -> None:
        pass


def swept(listings: DataFrame, every: float, lacking: int = 2, delay: float = 0) -> DataFrame:
    """A stream of ``uri, action, revision, ts`` from one of whole listings ``uri, revision, ts``, made ``every`` so many seconds.

    ``ts`` is the time of the listing. An address that is new or has another revision is an UPSERT; one that ``lacking``
    listings in a row don't have is a DELETE, at the time of the last of them, and new again if it returns. Addresses are kept in
    ``BUCKETS`` states by a hash, so a sweep touches the buckets with some that are due and reads no table of all. Listings come in order of
    time, also several in one batch. A batch holds whole listings; where one may be split over batches, ``delay`` is how many
    seconds of later listings may have been seen before its last row, and DELETEs wait as long. Older rows and rows without
    a time are left out, repeated rows count once, of two revisions in one listing both are told in order, a null revision is
    one of its own and a null address an address. Times are after 1970.
    """
    listings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = listings.select("uri", "revision", "ts", F.unix_millis("ts").alias("ms"), F.pmod(F.xxhash64("uri"), F.lit(BUCKETS)).alias("bucket"))
    rows = rows.withWatermark("ts", f"{int(delay * 1000) + 1} milliseconds").groupBy("bucket")
    told = rows.transformWithState(_Sweep(int(every * 1000) * lacking), "uri string, action string, revision string, at long", "Append", "EventTime")
    return told.select("uri", "action", "revision", F.timestamp_millis("at").alias("ts"))


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand all that is available to ``sink`` in micro-batches; a repeated batch has the same id."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def store_sink(store, table: str) -> Callable[[DataFrame, int], None]:
    """A sink that appends each batch to a table of the store once.

    The version's note names the batch, and so does a lasting mark, which a vacuum leaves.
    A batch whose writer was lost between the two has its note still in the newest versions.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        note = f"{table} batch {batch_id}"
        name = f"{table}-{batch_id}"
        if store.marked(name):
            return
        if all(m["note"] != note for m in store.versions().values()):
            store.commit(append={table: batch}, note=note)
        store.mark(name)

    return put
