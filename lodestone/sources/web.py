"""Resources behind the pages of an HTTP listing, as a stream whose offsets are places in the listing.

A listing is a chain of pages: each names addresses (anchors of HTML, else one a line) and, by a ``Link`` header with
``rel="next"``, the page after it. Pages only grow at their end, as in a feed of changes: a resource that changed is
named again. The offset is the page reached and how many of its addresses were taken, so a batch that is repeated after a
failure asks for the same addresses. The driver reads the pages of one batch to find its end; executors read each page
again and ask for its resources, one task a page.
"""

from __future__ import annotations

import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lodestone.sources.files import http_action

NAME = "lodestone_web"
#: What a row holds: the place of the address in the listing, and the answer about it.
RESOURCE = "page long, position int, uri string, status int, etag string, last_modified string, content_type string, length long, content binary"


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        self.found += [v for k, v in attrs if tag == "a" and k == "href" and v]


def named(body: str, content_type: str, base: str, hosts: set[str]) -> list[str]:
    """Addresses on a page in order, each once, without fragments; those of other hosts are left out."""
    if "html" in content_type:
        anchors = _Anchors()
        anchors.feed(body)
        raw = anchors.found
    else:
        raw = [line.strip() for line in body.splitlines() if line.strip() and not line.startswith("#")]
    whole = dict.fromkeys(urldefrag(urljoin(base, a)).url for a in raw)
    return [a for a in whole if urlsplit(a).scheme in ("http", "https") and urlsplit(a).netloc in hosts]


def following(link: str, base: str) -> str | None:
    """The address with ``rel="next"`` in a ``Link`` header."""
    for address, rest in re.findall(r'<([^>]*)>((?:\s*;\s*[^\s=,;]+(?:\s*=\s*(?:"[^"]*"|[^",;\s]*))?)*)', link):
        if re.search(r';\s*rel\s*=\s*"?(?:[^";]*\s)?next(?:\s|"|;|$)', rest):
            return urljoin(base, address)
    return None


class Web:
    """Requests with retries; options are those of ``resources``."""

    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}  # as a source's options come
        self.url = options["url"]
        self.most = max(1, int(options.get("pagesperbatch", 100)))
        self.bodies = options.get("bodies", "true").lower() == "true"
        self.max_bytes = int(options.get("maxbytes", 64 << 20))
        self.retries, self.pause = int(options.get("retries", 3)), float(options.get("pause", 0.5))
        self.timeout = float(options.get("timeout", 30))
        self.hosts = {urlsplit(self.url).netloc, *filter(None, options.get("hosts", "").split(","))}
        self.headers = {k[7:]: v for k, v in options.items() if k.startswith("header.")}

    def ask(self, url: str, method: str, most: int | None = None) -> tuple[int | None, dict, bytes | None]:
        """Status, headers and body; no status if no answer came in all tries, no body beyond ``most`` bytes or of an error."""
        for n in range(self.retries + 1):
            if n:
                time.sleep(self.pause * 2 ** (n - 1))
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers=self.headers, method=method), timeout=self.timeout) as r:
                    body = None
                    if method == "GET" and (most is None or int(r.headers.get("Content-Length") or 0) <= most):
                        body = r.read(-1 if most is None else most + 1)
                    return r.status, dict(r.headers.items()), None if most is not None and body is not None and len(body) > most else body
            except urllib.error.HTTPError as e:
                if e.code < 500 and e.code != 429 or n == self.retries:
                    return e.code, dict(e.headers.items()), None
            except (OSError, ValueError) as e:
                if isinstance(e, ValueError) and not isinstance(e, OSError):
                    return None, {}, None  # no address that can be asked
        return None, {}, None

    def page(self, url: str) -> tuple[list[str], str | None]:
        """Addresses of a page and the next page; a page that can't be read is an error, and the batch is tried again."""
        status, headers, body = self.ask(url, "GET")
        if body is None:
            raise ConnectionError(f"no listing at {url}: {status}")
        low = {k.lower(): v for k, v in headers.items()}
        return named(body.decode("utf-8", "replace"), low.get("content-type", ""), url, self.hosts), following(low.get("link", ""), url)

    def resource(self, uri: str) -> tuple:
        status, headers, body = self.ask(uri, "GET" if self.bodies else "HEAD", self.max_bytes)
        low = {k.lower(): v for k, v in headers.items()}
        length = len(body) if body is not None else int(low["content-length"]) if low.get("content-length", "").isdigit() else None
        ok = status is not None and status < 400
        return (uri, status, low.get("etag") if ok else None, low.get("last-modified") if ok else None, low.get("content-type") if ok else None, length if ok else None, body)


class _Part(InputPartition):
    """Addresses from one place up to another on a page."""

    def __init__(self, page: int, url: str, first: int, last: int):
        super().__init__((page, url, first, last))
        self.page, self.url, self.first, self.last = page, url, first, last


class _Pages(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.web = Web(options)
        self.at: dict | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": 0, "url": self.web.url, "taken": 0}

    def _walk(self, start: dict, end: dict | None) -> tuple[list[_Part], dict]:
        """Parts after ``start``, up to ``end`` or for as many pages as a batch may have, and where they end."""
        parts, page, url, taken = [], start["page"], start["url"], start["taken"]
        while end is None and len(parts) < self.web.most or end is not None and page < end["page"]:
            addresses, after = self.web.page(url)
            if len(addresses) > taken:
                parts.append(_Part(page, url, taken, len(addresses)))
            if after is None:
                taken = len(addresses)
                break
            page, url, taken = page + 1, after, 0
        if end is not None and page == end["page"] and end["taken"] > taken:
            parts.append(_Part(page, url, taken, end["taken"]))
        return parts, end or {"page": page, "url": url, "taken": taken}

    def latestOffset(self) -> dict:  # noqa: N802
        self.at = self._walk(self.at or self.initialOffset(), None)[1]
        return self.at

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        self.at = self.at or end  # after a restart the last batch is planned before new ones are sought
        return self._walk(start, end)[0]

    def read(self, partition: _Part) -> Iterator[tuple]:
        addresses, _ = self.web.page(partition.url)
        if len(addresses) < partition.last:
            raise ConnectionError(f"{partition.url} names fewer addresses than before")
        for k in range(partition.first, partition.last):
            yield (partition.page, k, *self.web.resource(addresses[k]))

    def commit(self, end: dict) -> None:
        pass


class _WebSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return RESOURCE

    def streamReader(self, schema) -> _Pages:  # noqa: N802
        return _Pages({k: self.options[k] for k in self.options})


def resources(spark: SparkSession, url: str, **options: object) -> DataFrame:
    """A stream of ``RESOURCE`` rows from the listing that begins at ``url``.

    Options: ``pagesPerBatch`` (pages that a batch may take, 100), ``bodies`` (false asks by HEAD only), ``maxBytes`` (a longer body
    is null, its row stays), ``retries``, ``pause`` (seconds before the first retry, doubled each time), ``timeout``,
    ``hosts`` (others than the listing's own whose addresses are taken, comma-separated). Answers of 429 and 500 or more
    are tried again; a resource without any answer has a null status. Empty pages have no rows; an address named on two
    pages is two rows. A listing page that can't be read fails the batch, which is repeated from its offsets.
    """
    spark.dataSource.register(_WebSource)
    return spark.readStream.format(NAME).options(url=url, **{k: str(v) for k, v in options.items()}).load()


def events(rows: DataFrame, known: Column | None = None) -> DataFrame:
    """``rows`` with ``action, revision``; ``known`` says that an address was ingested before (never, by default)."""
    told = http_action(F.col("status"), F.col("etag"), F.col("last_modified"), F.lit(False) if known is None else known)
    return rows.withColumns({"action": told["action"], "revision": told["revision"]})
