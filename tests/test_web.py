"""The stream of listed resources against a server of this process."""

from __future__ import annotations

import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lodestone.sources import web


class Site:
    """Pages of addresses that may grow, resources with tags, and a count of what was asked."""

    def __init__(self):
        self.pages: list[list[str]] = [[]]
        self.status, self.asked, self.broken = {}, Counter(), Counter()
        site = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                site.asked[(self.command, self.path)] += 1
                if site.broken[self.path] > 0:
                    site.broken[self.path] -= 1
                    return self.answer(503, b"")
                if self.path.startswith("/list/"):
                    k = int(self.path.rsplit("/", 1)[1])
                    more = [("Link", f'</list/{k + 1}>; title="a, b"; rel="next"')] if k + 1 < len(site.pages) else []
                    return self.answer(200, "\n".join(site.pages[k]).encode(), [("Content-Type", "text/plain"), *more])
                name = self.path.rsplit("/", 1)[1]
                tag = [] if name.startswith("plain") else [("ETag", f'W/"tag-{name}"')]
                return self.answer(site.status.get(name, 200), f"body of {name}".encode(), [("Content-Type", "text/html"), *tag])

            do_HEAD = do_GET  # noqa: N815

            def answer(self, status, body, headers=()):
                self.send_response(status)
                for k, v in [*headers, ("Content-Length", str(len(body)))]:
                    self.send_header(k, v)
                self.end_headers()
                if self.command == "GET":
                    self.wfile.write(body)

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.root = f"http://127.0.0.1:{self.server.server_port}"


@pytest.fixture
def site():
    s = Site()
    yield s
    s.server.shutdown()


def run(spark, site, path, fail_on=None, **options):
    """Take all that is there; the sizes of the batches, in pages."""
    sizes = []

    def put(batch, batch_id):
        batch = batch.drop("content").persist()
        sizes.append(batch.select("page").distinct().count())
        if fail_on is not None and batch.where(F.col("uri").endswith(fail_on)).count():
            raise RuntimeError("lost")
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    stream = web.events(web.resources(spark, f"{site.root}/list/0", pause=0.01, **options))
    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return sizes


def kept(spark, path):
    return sorted((r["uri"].rsplit("/", 1)[1], r["action"], r["revision"]) for r in spark.read.parquet(f"{path}/out").collect())


def test_each_resource_once_over_failures_and_restarts(spark, site, tmp_path):
    site.pages = [[f"/r/{p}-{k}" for k in range(3)] for p in range(5)]
    site.broken["/r/1-1"] = 2  # answered at the third try
    with pytest.raises(Exception, match="lost"):
        run(spark, site, tmp_path, fail_on="2-1", pagesPerBatch=2)
    sizes = run(spark, site, tmp_path, pagesPerBatch=2)  # the lost batch is repeated from its offsets
    assert max(sizes) <= 2
    want = [(f"{p}-{k}", "UPSERT", f"tag-{p}-{k}") for p in range(5) for k in range(3)]
    assert kept(spark, tmp_path) == want
    # the last page grows, an empty page follows, and a changed resource is named again after it
    site.pages[4] += ["/r/new"]
    site.pages += [[], ["/r/0-0", "#a comment", "/r/0-0", "http://elsewhere.invalid/x"]]
    before = site.asked[("GET", "/list/0")]
    run(spark, site, tmp_path, pagesPerBatch=2)
    assert kept(spark, tmp_path) == sorted([*want, ("new", "UPSERT", "tag-new"), ("0-0", "UPSERT", "tag-0-0")])
    assert site.asked[("GET", "/list/0")] == before  # pages that are behind the offset aren't read again
    assert run(spark, site, tmp_path) in ([], [0])
    assert kept(spark, tmp_path) == sorted([*want, ("new", "UPSERT", "tag-new"), ("0-0", "UPSERT", "tag-0-0")])


def test_answers(spark, site, tmp_path):
    site.pages = [["/r/gone", "/r/missing", "/r/plain", "/r/a", "http://127.0.0.1:1/dead"]]
    site.status = {"gone": 410, "missing": 404}
    run(spark, site, tmp_path, bodies=False, hosts="127.0.0.1:1", retries=1)
    assert kept(spark, tmp_path) == [("a", "UPSERT", "tag-a"), ("dead", "UPSERT", None), ("gone", "DELETE", None), ("missing", "UPSERT", None), ("plain", "UPSERT", None)]
    assert not any(m == "GET" and p.startswith("/r/") for m, p in site.asked)


def test_known_addresses_without_a_revision_are_unchanged(spark):
    rows = spark.createDataFrame([(200, None), (None, None), (200, '"x"')], "status int, etag string").withColumn("last_modified", F.lit(None).cast("string"))
    got = [r[0] for r in web.events(rows, F.lit(True)).select("action").collect()]
    assert sorted(got) == ["UNCHANGED", "UPSERT", "UPSERT"]


def test_bodies_over_the_limit_stay_as_rows(site):
    w = web.Web({"url": f"{site.root}/list/0", "maxBytes": "5"})
    assert w.resource(f"{site.root}/r/a")[-2:] == (len("body of a"), None)
    assert web.Web({"url": site.root, "maxBytes": "9"}).resource(f"{site.root}/r/a")[-1] == b"body of a"


def test_pages():
    assert web.named('<a href="x#f">1</a><a href="x">2</a><a href="mailto:a@b">3</a><a>4</a>', "text/html", "http://h/d/", {"h"}) == ["http://h/d/x"]
    assert web.following('</p?a=1,2>; rel="prev", </q>; rel="next last"', "http://h/d/") == "http://h/q"
    assert web.following('</q>; rel=nextish', "http://h/") is None
    assert web.following("", "http://h/") is None
