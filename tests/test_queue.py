from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.operators import queue as Q

T0 = datetime(2024, 1, 1)


def at(seconds):
    return F.lit(T0 + timedelta(seconds=seconds)).cast("timestamp")


def job(i, status="queued", uri=None, op="UPSERT", attempts=0, by=None, claimed=None, due=0, done=None, source="s", revision=None):
    when = lambda s: None if s is None else T0 + timedelta(seconds=s)
    return (i, source, uri or f"u{i}", op, None, revision, status, attempts, 3, None, when(0), when(due), when(claimed), by, None, when(done))


@pytest.fixture(scope="module")
def make(spark):
    return lambda *rows: spark.createDataFrame(list(rows), Q.JOB)


def state(df, *cols):
    return {r["id"]: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_enqueue_keeps_one_live_job_a_key(make):
    queue = make(job(1, uri="a"), job(2, "dead", uri="b"), job(3, "succeeded", uri="c"))
    new = make(job(4, uri="a", op="DELETE"), job(5, uri="b"), job(6, uri="c"), job(7, uri="c"))
    assert sorted(state(Q.enqueue(queue, new), "uri")) == [1, 2, 3, 5, 6]


def test_claim_takes_the_oldest_due_and_skips_excluded(make):
    queue = make(job(1, due=50), job(2, due=10), job(3, due=5, source="x"), job(4, due=999))
    got = state(Q.claim(queue, "w", at(100), 2, ["x"]), "status", "attempts", "claimed_by")
    assert got == {1: ("claimed", 1, "w"), 2: ("claimed", 1, "w"), 3: ("queued", 0, None), 4: ("queued", 0, None)}


def test_transitions_ask_for_the_claim(make):
    queue = make(job(1, "claimed", by="w", attempts=1), job(2, "claimed", by="other", attempts=1), job(3, "queued"))
    for step, want in ((Q.succeed(queue, [1, 2, 3], "w", at(9)), "succeeded"), (Q.bury(queue, [1, 2, 3], "w", "e", at(9)), "dead"), (Q.release(queue, [1, 2, 3], "w"), "queued")):
        assert state(step, "status") == {1: want, 2: "claimed", 3: "queued"}
    assert state(Q.reschedule(queue, [1], "w", "e", at(60)), "status", "last_error")[1] == ("queued", "e")


def test_retry_cancel_reap_renew_and_prune(make, spark):
    queue = make(job(1, "dead", uri="a", attempts=3, done=5), job(2, "dead", uri="b", done=5), job(3, uri="b"), job(4, "claimed", by="w", claimed=0, attempts=1), job(5, "succeeded", done=90))
    assert state(Q.retry(queue, [1, 2], at(9)), "status") == {1: "queued", 2: "dead", 3: "queued", 4: "claimed", 5: "succeeded"}
    assert sorted(state(Q.cancel(queue, [1, 3, 4]), "id")) == [1, 2, 5]
    assert state(Q.reap(queue, 30, at(100)), "status", "attempts")[4] == ("queued", 0)
    claims = spark.createDataFrame([(4, "w"), (3, "w")], "id long, claimed_by string")
    renewed = Q.renew(queue, claims, at(95))
    assert state(Q.reap(renewed, 30, at(100)), "status")[4] == "claimed" and renewed.count() == 5
    assert sorted(state(Q.prune_terminal(queue, 50, at(100)), "id")) == [3, 4, 5]
    assert sorted(state(Q.prune_dead(queue, "s", "a"), "id")) == [2, 3, 4, 5]


def test_finish_follows_outcomes(make, spark):
    queue = make(*[job(i, "claimed", by="w" if i < 6 else "x", attempts=3 if i == 4 else 2) for i in range(1, 7)])
    rows = [(1, True, None, None, None), (2, False, "http", 404, "gone"), (3, False, "http", 503, "busy"), (4, False, "io", None, "t"), (5, False, "http", 429, "slow"), (6, True, None, None, None)]
    got = Q.finish(queue, spark.createDataFrame(rows, "id long, ok boolean, kind string, http_status int, error string"), "w", at(100))
    assert state(got, "status", "last_error", "claimed_by") == {
        1: ("succeeded", None, "w"), 2: ("dead", "gone", "w"), 3: ("queued", "busy", None), 4: ("dead", "t", "w"), 5: ("queued", "slow", None), 6: ("claimed", None, "x")
    }
    assert {r["id"]: r["scheduled_at"] for r in got.collect()}[3] == T0 + timedelta(seconds=110)


def test_delete_resolves_guards_freshness_and_breaker(make, spark):
    queue = make(job(1, "dead", uri="a"), job(2, "succeeded", uri="a", op="DELETE"), job(3, "dead", uri="a"))
    assert sorted(state(Q.resolved_by_delete(queue), "id")) == [2, 3]
    jobs = make(job(1, uri="a", op="DELETE"), job(2, uri="b", revision="r1"), job(3, uri="c", revision="r1"))
    listing = spark.createDataFrame([("a", "x"), ("b", "r2"), ("c", "r1")], "uri string, revision string")
    assert state(Q.guarded(jobs, listing), "verdict") == {1: "skip", 2: "fail", 3: "run"}
    docs = spark.createDataFrame([("a", "r", "m"), ("b", None, "m"), ("c", "r", "m")], "uri string, revision string, md5 string")
    new = spark.createDataFrame([("a", "r", "zz"), ("b", "q", "m"), ("c", "q", "n"), ("d", "r", "m")], "uri string, revision string, md5 string")
    assert {r["uri"]: r["action"] for r in Q.freshness(docs, new).collect()} == {"a": "refresh", "b": "refresh", "c": "ingest", "d": "create"}
    seen = [("t", i, i, ok) for i, ok in enumerate([False, True, False, False, False])] + [("u", 0, 0, False), ("v", 1, 1, True)]
    o = spark.createDataFrame(seen, "target string, seq int, s int, ok boolean").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["target"]: (r["failures"], r["opened_at"] is not None) for r in Q.breaker(o, 3, 30).collect()}
    assert got == {"t": (3, True), "u": (1, False), "v": (0, False)}


def test_state_merge_summary_and_manifest(make, spark):
    s = "source_id string, uri string, revision string, content_hash string, last_seen long"
    old = spark.createDataFrame([("s", "a", "r", "h", 1), ("s", "b", "r", "h", 1)], s)
    new = spark.createDataFrame([("s", "a", None, "h2", 2), ("s", "c", "r", None, 2)], s)
    got = {r["uri"]: tuple(r)[2:] for r in Q.merge_state(old, new, ["source_id", "uri"], ["last_seen"]).collect()}
    assert got == {"a": ("r", "h2", 2), "b": ("r", "h", 1), "c": ("r", None, 2)}
    diff = spark.createDataFrame([("a", "UPSERT"), ("b", "DELETE"), ("c", "UNCHANGED")], "uri string, action string")
    assert tuple(Q.sync_summary(diff, False).first()) == (1, 0, 1, 1)
    manifest = make(job(1, uri="a"), job(2, uri="a"), job(3, uri="b"))
    assert {(r["uri"], r["reason"]) for r in Q.manifest_conflicts(manifest, make(job(9, uri="z"), job(8, uri="b"))).collect()} == {("a", "duplicate"), ("z", "foreign")}
