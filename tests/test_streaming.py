from __future__ import annotations

import time

from pyspark.sql import functions as F

from lodestone.sources.files import discover
from lodestone.sources.store import Store
from lodestone.streaming import sync as Y

EVENTS = "source_id string, uri string, seq int, ts timestamp, ok boolean, kind string, http_status int"


def stream_of(spark, folder, rows, parts=1):
    df = spark.createDataFrame([(s, u, i, t, ok, k, h) for i, (s, u, t, ok, k, h) in enumerate(rows)], EVENTS.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts"))
    for p in range(parts):
        df.where(F.col("seq") % parts == p if parts > 1 else F.lit(True)).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder))


def gathered(stream, tmp_path, mode="append"):
    out = []
    q = stream.writeStream.outputMode(mode).foreachBatch(lambda b, i: out.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def test_watched_files_reach_the_store_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("one")
    store = Store(spark, str(tmp_path / "db"))
    sink = Y.store_sink(store, "files")
    Y.drain(Y.watched(spark, str(tmp_path / "in")), sink, str(tmp_path / "cp"))
    (tmp_path / "in" / "b.md").write_text("two")
    Y.drain(Y.watched(spark, str(tmp_path / "in")), sink, str(tmp_path / "cp"))
    assert store.read("files").count() == 2
    sink(store.read("files"), 1)
    assert store.read("files").count() == 2


def test_intake_rolling_and_sessions(spark, tmp_path):
    rows = [("s", "a", 0, True, None, None), ("s", "a", 10, True, None, None), ("s", "b", 20, False, "io", None), ("t", "a", 4000, True, None, None)]
    assert sorted((r[0], r[1]) for r in gathered(Y.intake(stream_of(spark, tmp_path / "e", rows)), tmp_path)) == [("s", "a"), ("s", "b"), ("t", "a")]
    got = gathered(Y.rolling(stream_of(spark, tmp_path / "f", rows), "1 minute", delay="1 second"), tmp_path / "r", "complete")
    assert sorted((r[0], r[2], r[3]) for r in got[-2:]) == [("s", 3, 1), ("t", 1, 0)]
    got = gathered(Y.sessions(stream_of(spark, tmp_path / "g", rows), "15 seconds"), tmp_path / "s", "complete")
    assert sorted((r[0], r[3]) for r in got[-2:]) == [("s", 3), ("t", 1)]


def test_breaker_state(spark, tmp_path):
    bad = lambda t: ("s", "u", t, False, "http", 503)
    rows = [bad(1), bad(2), ("s", "u", 3, True, None, None), bad(4), ("s", "u", 5, False, "http", 404), bad(6), bad(7), ("t", "u", 8, False, "io", None)]
    got = {r[0]: r[1:] for r in gathered(Y.breaker_states(stream_of(spark, tmp_path / "e", rows), 3, 30), tmp_path, "update")}
    assert got == {"s": (3, 7.0, 37.0), "t": (1, None, None)}


def listed(spark, folder, listings):
    """Append listings, a file each: (time, {uri: revision})."""
    for at, files in listings:
        rows = [(u, r, at) for u, r in files.items()]
        spark.createDataFrame(rows, "uri string, revision string, at long").select("uri", "revision", F.timestamp_seconds("at").alias("ts")).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)  # files are read in order of their times


def told_by_hand(listings, every, lacking):
    seen, out = {}, []
    for at, files in listings:
        for u in [u for u in seen if u not in files and at - seen[u][1] >= every * lacking]:
            out.append((u, "DELETE", seen.pop(u)[0], at))
        for u, r in files.items():
            if u not in seen or seen[u][0] != r:
                out.append((u, "UPSERT", r, at))
            seen[u] = (r, at)
    return sorted(out, key=repr)


def test_sweep_deletes_what_two_listings_lack(spark, tmp_path):
    listings = [
        (60, {"a": "1", "b": "1", "c": None, "d": "1", "é": ""}), (120, {"a": "1", "b": "2", "d": "1"}), (180, {"a": "1", "c": "9", "d": "1"}),
        (240, {"a": "1", "c": "9", "e": "1"}), (300, {"b": "3", "a": "2", "e": "1"}), (360, {"b": "3", "d": "1", "e": "1"}),
    ]
    sweep = lambda: Y.swept(spark.readStream.schema("uri string, revision string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 60).select("uri", "action", "revision", F.unix_seconds("ts").alias("at"))
    listed(spark, tmp_path / "in", listings[:4])
    got = gathered(sweep(), tmp_path)
    listed(spark, tmp_path / "in", listings[4:])
    got += gathered(sweep(), tmp_path)  # the stream is started again from its checkpoint
    assert sorted(got, key=repr) == told_by_hand(listings, 60, 2)


def test_sweep_of_three_listings_equals_the_batch_diff(spark, tmp_path):
    old, new = {f"u{i}": str(i) for i in range(40)}, {f"u{i}": str(i if i % 3 else -i) for i in range(10, 50)}
    listed(spark, tmp_path / "in", [(60, old), (120, new), (180, new)])
    got = gathered(Y.swept(spark.readStream.schema("uri string, revision string, ts timestamp").parquet(str(tmp_path / "in")), 60), tmp_path)
    frame = lambda files: spark.createDataFrame(list(files.items()), "uri string, revision string")
    want = {(r.uri, r.action) for r in discover(frame(new), frame(old)).collect() if r.action != "UNCHANGED"}
    assert {(r[0], r[1]) for r in got if r[3].minute > 1} == want


def test_sweep_of_listings_split_over_batches(spark, tmp_path):
    listed(spark, tmp_path / "in", [(60, {"a": "1"}), (60, {"b": "1"}), (120, {"a": "1"}), (120, {"b": "1"}), (180, {"c": "1"}), (180, {"b": "1"}), (240, {"c": "1"}), (240, {"b": "1"}), (300, {"b": "1", "c": "1"})])
    stream = spark.readStream.schema("uri string, revision string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = gathered(Y.swept(stream, 60, delay=60).select("uri", "action", F.unix_seconds("ts")), tmp_path)
    assert sorted(got) == [("a", "DELETE", 240), ("a", "UPSERT", 60), ("b", "UPSERT", 60), ("c", "UPSERT", 180)]


def test_sweep_keeps_addresses_of_a_bucket_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Y, "BUCKETS", 2)
    listings = {1: ["a", "b", "c", None, "d"], 2: ["a", "c", None], 3: ["a", None], 4: ["a", "d"], 5: ["a"]}
    for at, uris in listings.items():
        spark.createDataFrame([(u, "r") for u in uris], "uri string, revision string").withColumn("ts", F.timestamp_seconds(F.lit(60 * at))).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("uri string, revision string, ts timestamp").parquet(str(tmp_path / "in"))
    told = Y.swept(stream, 60).select("uri", "action", F.unix_seconds("ts").alias("at"))
    run = told.writeStream.format("memory").queryName("bucketed").option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted(map(repr, map(tuple, spark.table("bucketed").collect())))
    up, gone = {("a", 60), ("b", 60), ("c", 60), (None, 60), ("d", 60), ("d", 240)}, {("b", 180), ("d", 180), ("c", 240), (None, 300)}
    assert got == sorted(map(repr, [(u, "UPSERT", t) for u, t in up] + [(u, "DELETE", t) for u, t in gone]))
    assert 0 < run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * 3  # a state and a timer, held in two places, for each bucket
