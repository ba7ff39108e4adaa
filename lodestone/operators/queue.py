"""Job queue and source synchronisation as DataFrame transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def jobs(events: DataFrame) -> DataFrame:
    """Queue rows from events."""
    status = (
        F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "click", "claimed").when(F.col("event_type") == "error", "dead").otherwise("succeeded")
    )
    return events.select(F.col("event_id").alias("id"), F.col("user_id").alias("source_id"), status.alias("status"), "ts", "value")


def live() -> Column:
    return F.col("status").isin("queued", "claimed")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, revision: str) -> DataFrame:
    """``key, action``: UPSERT for new and changed rows, DELETE for gone ones, else UNCHANGED."""
    o, n = old.select(key, F.col(revision).alias("old_rev")), new.select(key, F.col(revision).alias("new_rev"))
    action = F.when(F.col("new_rev").isNull(), "DELETE").when(F.col("old_rev").eqNullSafe(F.col("new_rev")), "UNCHANGED").otherwise("UPSERT")
    return o.join(n, key, "full_outer").select(key, action.alias("action"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and of ``old`` whose key is not in ``new``."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def failure_streaks(rows: DataFrame) -> DataFrame:
    """Runs of consecutive dead jobs of a source."""
    order = Window.partitionBy("source_id").orderBy("ts", "id")
    run = rows.withColumn("bad", F.col("status") == "dead").withColumn("seq", F.row_number().over(order))
    gap = F.col("seq") - F.row_number().over(Window.partitionBy("source_id", "bad").orderBy("ts", "id"))
    return run.withColumn("gap", gap).where("bad").groupBy("source_id", "gap").agg(F.count("*").alias("streak"), F.min("id").alias("first_id")).drop("gap")


#: Columns of a job; ``now`` arguments are timestamps, so that a transition can be repeated.
JOB = (
    "id long, source_id string, uri string, op string, content_hash string, revision string, status string, attempts int, max_attempts int, last_error string, "
    "enqueued_at timestamp, scheduled_at timestamp, claimed_at timestamp, claimed_by string, last_heartbeat_at timestamp, completed_at timestamp"
)


def _set(df: DataFrame, when: Column, **to: Column) -> DataFrame:
    """Change columns of the rows that match; null conditions match nothing."""
    when = F.coalesce(when, F.lit(False))
    return df.withColumns({c: F.when(when, v).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in to.items()})


def enqueue(queue: DataFrame, new: DataFrame) -> DataFrame:
    """Add jobs whose source and uri have no live one, whatever its op; of new jobs with one key the first id stays."""
    first = new.withColumn("_rn", F.row_number().over(Window.partitionBy("source_id", "uri").orderBy("id"))).where("_rn = 1").drop("_rn")
    return queue.unionByName(first.join(queue.where(live()).select("source_id", "uri"), ["source_id", "uri"], "left_anti").select(*queue.columns))


def claim(queue: DataFrame, worker: str, now: Column, n: int = 1, exclude: list[str] | None = None) -> DataFrame:
    """Claim the ``n`` oldest queued jobs that are due, of sources not excluded; counts an attempt."""
    due = queue.where((F.col("status") == "queued") & (F.col("scheduled_at") <= now))
    if exclude:
        due = due.where(~F.col("source_id").isin(*exclude))
    picked = due.orderBy("scheduled_at", "id").limit(n).select("id", F.lit(True).alias("_mine"))
    q = queue.join(F.broadcast(picked) if n <= 100_000 else picked, "id", "left")
    return _set(q, F.col("_mine"), status=F.lit("claimed"), attempts=F.col("attempts") + 1, claimed_at=now, claimed_by=F.lit(worker), last_heartbeat_at=now).drop("_mine").select(*queue.columns)


def held(job_ids: list[int], worker: str) -> Column:
    """Jobs that the worker still holds; every transition by a worker asks for it."""
    return F.col("id").isin(*job_ids) & (F.col("status") == "claimed") & (F.col("claimed_by") == worker)


def succeed(queue: DataFrame, job_ids: list[int], worker: str, now: Column) -> DataFrame:
    return _set(queue, held(job_ids, worker), status=F.lit("succeeded"), completed_at=now, last_error=F.lit(None))


def bury(queue: DataFrame, job_ids: list[int], worker: str, error: str, now: Column) -> DataFrame:
    return _set(queue, held(job_ids, worker), status=F.lit("dead"), completed_at=now, last_error=F.lit(error))


def reschedule(queue: DataFrame, job_ids: list[int], worker: str, error: str, at: Column) -> DataFrame:
    none = F.lit(None)
    return _set(queue, held(job_ids, worker), status=F.lit("queued"), scheduled_at=at, last_error=F.lit(error), claimed_at=none, claimed_by=none, last_heartbeat_at=none)


def release(queue: DataFrame, job_ids: list[int], worker: str) -> DataFrame:
    """Back to the queue without the attempt."""
    none = F.lit(None)
    return _set(queue, held(job_ids, worker), status=F.lit("queued"), attempts=F.greatest(F.col("attempts") - 1, F.lit(0)), claimed_at=none, claimed_by=none, last_heartbeat_at=none)


def retry(queue: DataFrame, job_ids: list[int], now: Column) -> DataFrame:
    """Dead or queued jobs become due with no attempts, unless another job of their key is live."""
    others = queue.where(live()).select("source_id", "uri", F.col("id").alias("_other"))
    blocked = queue.join(others, ["source_id", "uri"]).where(F.col("id") != F.col("_other")).select("id").distinct().withColumn("_blocked", F.lit(True))
    may = F.col("id").isin(*job_ids) & F.col("status").isin("dead", "queued") & F.col("_blocked").isNull()
    none = F.lit(None)
    return _set(queue.join(blocked, "id", "left"), may, status=F.lit("queued"), attempts=F.lit(0), scheduled_at=now, last_error=none, completed_at=none).select(*queue.columns)


def cancel(queue: DataFrame, job_ids: list[int]) -> DataFrame:
    """Remove live jobs."""
    return queue.where(~(F.col("id").isin(*job_ids) & live()))


def reap(queue: DataFrame, ttl_seconds: int, now: Column) -> DataFrame:
    """Claims without a heartbeat for ``ttl_seconds`` go back to the queue without their attempt."""
    stale = (F.col("status") == "claimed") & (F.coalesce("last_heartbeat_at", "claimed_at") < now - F.make_interval(secs=F.lit(ttl_seconds)))
    none = F.lit(None)
    return _set(queue, stale, status=F.lit("queued"), attempts=F.greatest(F.col("attempts") - 1, F.lit(0)), claimed_at=none, claimed_by=none, last_heartbeat_at=none)


def renew(queue: DataFrame, claims: DataFrame, now: Column) -> DataFrame:
    """Heartbeats of the pairs ``id, claimed_by`` that still hold."""
    mine = claims.select(F.col("id").alias("_id"), F.col("claimed_by").alias("_by")).distinct()
    q = queue.join(mine, (F.col("id") == F.col("_id")) & (F.col("claimed_by") == F.col("_by")), "left")
    return _set(q, F.col("_by").isNotNull() & (F.col("status") == "claimed"), last_heartbeat_at=now).select(*queue.columns)


def prune_dead(queue: DataFrame, source_id: str, uri: str) -> DataFrame:
    return queue.where(~((F.col("status") == "dead") & (F.col("source_id") == source_id) & (F.col("uri") == uri)))


def prune_terminal(queue: DataFrame, max_age_seconds: int, now: Column) -> DataFrame:
    """Remove succeeded and dead jobs that ended before the age."""
    old = F.col("status").isin("succeeded", "dead") & (F.col("completed_at") < now - F.make_interval(secs=F.lit(max_age_seconds)))
    return queue.where(~F.coalesce(old, F.lit(False)))


def backoff(attempt: Column, base: float = 5.0, most: float = 600.0) -> Column:
    """Seconds before the next attempt: doubled each time, up to ``most``; jitter is the caller's."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(most))


def error_class(kind: Column, http_status: Column) -> Column:
    """``permanent`` or ``transient``; statuses 408, 429 and from 500 are transient, others of HTTP permanent."""
    http = F.when(http_status.isin(408, 429) | (http_status >= 500), "transient").otherwise("permanent")
    lasting = kind.isin("unsupported", "too_large", "not_found", "permission", "path", "object_store")
    return F.when(kind == "http", http).when(lasting, "permanent").otherwise("transient")


def finish(queue: DataFrame, outcomes: DataFrame, worker: str, now: Column) -> DataFrame:
    """One step of the life of claimed jobs from ``id, ok, kind, http_status, error``.

    Success ends a job and a permanent error or the last attempt buries it; else it waits for its backoff.
    Jobs that the worker no longer holds stay as they are.
    """
    o = outcomes.select("id", "ok", error_class(F.col("kind"), F.col("http_status")).alias("_class"), F.col("error").alias("_error"))
    q = queue.join(o, "id", "left")
    mine = F.col("ok").isNotNull() & (F.col("status") == "claimed") & (F.col("claimed_by") == worker)
    dead = (F.col("_class") == "permanent") | (F.col("attempts") >= F.col("max_attempts"))
    to = F.when(F.col("ok"), "succeeded").when(dead, "dead").otherwise("queued")
    ended, again = to != "queued", now + F.make_interval(secs=backoff(F.col("attempts")).cast("decimal(18,6)"))
    changed = _set(
        q.withColumn("_to", F.when(mine, to)).withColumn("_mine", F.coalesce(mine, F.lit(False))), F.col("_mine"),
        completed_at=F.when(ended, now).otherwise(F.col("completed_at")), scheduled_at=F.when(ended, F.col("scheduled_at")).otherwise(again), last_error=F.when(F.col("ok"), None).otherwise(F.col("_error")),
    )
    none = F.lit(None)
    changed = _set(changed, F.col("_mine") & (F.col("_to") == "queued"), claimed_at=none, claimed_by=none, last_heartbeat_at=none)
    return _set(changed, F.col("_mine"), status=F.col("_to")).select(*queue.columns)


def resolved_by_delete(queue: DataFrame) -> DataFrame:
    """The queue without dead jobs whose key has a later successful DELETE."""
    done = queue.where("status = 'succeeded' and op = 'DELETE'").groupBy("source_id", "uri").agg(F.max("id").alias("_done"))
    kept = queue.join(done, ["source_id", "uri"], "left").where(~((F.col("status") == "dead") & F.coalesce(F.col("_done") > F.col("id"), F.lit(False))))
    return kept.select(*queue.columns)


def guarded(jobs: DataFrame, listing: DataFrame) -> DataFrame:
    """Add ``verdict``: skip a DELETE whose resource is listed, fail an UPSERT whose revision moved since the manifest, else run."""
    here = listing.select("uri", F.col("revision").alias("_now"), F.lit(True).alias("_here"))
    j = jobs.join(here, "uri", "left")
    moved = F.col("_here").isNotNull() & F.col("revision").isNotNull() & F.col("_now").isNotNull() & (F.col("revision") != F.col("_now"))
    verdict = F.when((F.col("op") == "DELETE") & F.col("_here").isNotNull(), "skip").when((F.col("op") == "UPSERT") & moved, "fail").otherwise("run")
    return j.withColumn("verdict", verdict).drop("_now", "_here")


def merge_state(old: DataFrame, new: DataFrame, keys: list[str], latest: list[str]) -> DataFrame:
    """Upsert where a null in ``new`` keeps the old value, except in the ``latest`` columns, which are always replaced."""
    o, n = old.withColumn("_o", F.lit(1)).alias("o"), new.withColumn("_n", F.lit(1)).alias("n")
    both = o.join(n, keys, "full_outer")
    value = lambda c: F.when(F.col("_n").isNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}") if c in latest else F.coalesce(f"n.{c}", f"o.{c}")).alias(c)
    return both.select(*[c if c in keys else value(c) for c in old.columns])


def freshness(docs: DataFrame, fetched: DataFrame) -> DataFrame:
    """``uri, action``: refresh metadata when the revision or else the hash is equal, else ingest; create if unknown."""
    d = docs.select("uri", F.col("revision").alias("_r"), F.col("md5").alias("_m"), F.lit(True).alias("_known"))
    same = (F.col("revision") == F.col("_r")) | (F.col("md5") == F.col("_m"))
    action = F.when(F.col("_known").isNull(), "create").when(F.coalesce(same, F.lit(False)), "refresh").otherwise("ingest")
    return fetched.join(d, "uri", "left").select("uri", action.alias("action"))


def sync_summary(diff: DataFrame, delete_orphans: bool = True) -> DataFrame:
    """Counts of a dry run: ``upsert, delete, unchanged, ignored_delete``."""
    n = lambda a: F.count_if(F.col("action") == a)
    zero = F.lit(0).cast("long")
    gone = (n("DELETE"), zero) if delete_orphans else (zero, n("DELETE"))
    return diff.agg(n("UPSERT").alias("upsert"), gone[0].alias("delete"), n("UNCHANGED").alias("unchanged"), gone[1].alias("ignored_delete"))


def manifest_conflicts(manifest: DataFrame, queue: DataFrame) -> DataFrame:
    """``source_id, uri, reason``: keys that a manifest names twice, or whose live job is not of the manifest."""
    twice = manifest.groupBy("source_id", "uri").count().where("count > 1").select("source_id", "uri", F.lit("duplicate").alias("reason"))
    foreign = queue.where(live()).join(manifest.select("source_id", "uri").distinct(), ["source_id", "uri"], "left_anti")
    return twice.unionByName(foreign.select("source_id", "uri", F.lit("foreign").alias("reason")).distinct())


def breaker(outcomes: DataFrame, threshold: int, cooldown_seconds: float) -> DataFrame:
    """``target, failures, opened_at, open_until`` after the last of ``target, ts, ok``: failures since the last success.

    The breaker is open until the cooldown after the latest failure once their number reached the threshold.
    """
    good = Window.partitionBy("target").orderBy(F.desc("ts"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    tail = outcomes.withColumn("_goods", F.sum(F.col("ok").cast("int")).over(good))
    state = tail.groupBy("target").agg(F.count_if(F.col("_goods") == 0).alias("failures"), F.max(F.when(F.col("_goods") == 0, F.col("ts"))).alias("last"))
    opened = F.when(F.col("failures") >= threshold, F.col("last"))
    return state.select("target", "failures", opened.alias("opened_at"), (opened + F.make_interval(secs=F.lit(cooldown_seconds).cast("decimal(18,6)"))).alias("open_until"))


def drain_report(queue: DataFrame, since: Column, seen: int = 0) -> DataFrame:
    """One row ``total, completed, succeeded, dead, queued, claimed`` of a run that began at ``since``.

    Live jobs count whenever they were added, ended ones if the run ended them. ``seen`` is the total of the report before,
    under which ``total`` does not fall.
    """
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    counts = queue.where(live() | (F.col("completed_at") >= since)).agg(n("succeeded"), n("dead"), n("queued"), n("claimed"))
    done = F.col("succeeded") + F.col("dead")
    total = F.greatest(F.lit(seen).cast("long"), done + F.col("queued") + F.col("claimed"))
    return counts.select(total.alias("total"), F.least(done, total).alias("completed"), "succeeded", "dead", "queued", "claimed")


def source_stats(queue: DataFrame, now: Column) -> DataFrame:
    """``source_id, queued, claimed, dead, done_5m, done_30m, done_1h, oldest_s``: what waits, what ended lately, and the age of
    the oldest that waits in whole seconds, null if none does.
    """
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    done = lambda s: F.count_if((F.col("status") == "succeeded") & (F.col("completed_at") >= now - F.make_interval(secs=F.lit(s))))
    oldest = F.min(F.when(F.col("status") == "queued", F.col("scheduled_at")))
    return queue.groupBy("source_id").agg(n("queued"), n("claimed"), n("dead"), done(300).alias("done_5m"), done(1800).alias("done_30m"), done(3600).alias("done_1h"), F.timestamp_diff("SECOND", oldest, now).alias("oldest_s"))
