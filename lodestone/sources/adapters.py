"""Sources outside Spark's file formats, as Python data sources that list ``uri, revision``.

An adapter is any class with ``prefixes()`` and ``entries(prefix)``; each prefix is one task, so a listing is split as
its adapter splits it. Adapters are found by scheme; a named source never falls back to another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote, urlsplit
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class Adapters:
    """Factories by scheme, and configured sources by name."""

    factories: dict[str, Callable[[str], object]] = field(default_factory=dict)
    sources: dict[str, object] = field(default_factory=dict)

    def register(self, scheme: str, factory: Callable[[str], object]) -> None:
        self.factories[scheme] = factory

    def configured(self, name: str) -> object:
        """The source of that name, or an error: another one would lack its credentials."""
        if name not in self.sources:
            raise LookupError(f"no source named {name}")
        return self.sources[name]

    def adhoc(self, uri: str) -> object:
        scheme = urlsplit(uri).scheme or "file"
        if scheme not in self.factories:
            raise LookupError(f"no source for {scheme}")
        return self.factories[scheme](uri)


class _Prefix(InputPartition):
    def __init__(self, prefix: str):
        super().__init__(prefix)
        self.prefix = prefix


class _Reader(DataSourceReader):
    def __init__(self, adapter):
        self.adapter = adapter

    def partitions(self):
        return [_Prefix(p) for p in self.adapter.prefixes()] or [_Prefix("")]

    def read(self, partition) -> Iterator[tuple]:
        if partition.prefix in self.adapter.prefixes():
            yield from self.adapter.entries(partition.prefix)


def listed(spark: SparkSession, name: str, adapter) -> DataFrame:
    """``uri, revision`` of an adapter, listed by the executors; registers the format ``name``."""

    class Listing(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "uri string, revision string"

        def reader(self, schema):
            return _Reader(adapter)

    spark.dataSource.register(Listing)
    return spark.read.format(name).load()


def multistatus(xml: str, base: str) -> list[tuple[str, str | None]]:
    """``uri, revision`` of the files in a WebDAV answer: the tag without its weak mark and quotes, else the date.

    An answer that names a collection other than the one asked for is an error, since it was redirected.
    """
    dav = "{DAV:}"
    out, collections = [], []
    origin = urlsplit(base)
    for r in ElementTree.fromstring(xml).iter(f"{dav}response"):
        href = unquote(urlsplit(r.findtext(f"{dav}href", "")).path)
        if r.find(f".//{dav}resourcetype/{dav}collection") is not None:
            collections.append(href.rstrip("/"))
            continue
        tag = r.findtext(f".//{dav}getetag")
        revision = tag.removeprefix("W/").strip('"') if tag else r.findtext(f".//{dav}getlastmodified")
        out.append((f"{origin.scheme}://{origin.netloc}{href}", revision))
    if collections and unquote(origin.path).rstrip("/") not in collections:
        raise ValueError(f"the answer is not about {base}")
    return out
