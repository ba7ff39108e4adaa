"""Commands on a corpus in a store: ``python -m lodestone.cli STORE COMMAND ...``; rows are printed as JSON lines."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.client import Corpus

#: Rows printed at most, unless ``--limit`` says otherwise.
LIMIT = 20


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("store")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("list", "history", "search"):
        sub.add_parser(name).add_argument("--limit", type=int, default=LIMIT)
    sub.choices["list"].add_argument("--filter")
    sub.choices["list"].add_argument("--offset", type=int, default=0)
    search = sub.choices["search"]
    search.add_argument("text")
    search.add_argument("--kind", choices=("hybrid", "vector", "fts"), default="hybrid")
    search.add_argument("--filter")
    add = sub.add_parser("add")
    add.add_argument("uri")
    add.add_argument("text")
    add.add_argument("--title", default="")
    sub.add_parser("add-files").add_argument("root")
    for name in ("get", "delete"):
        sub.add_parser(name).add_argument("uri")
    for name in ("tag", "untag", "restore"):
        sub.add_parser(name).add_argument("name")
    sub.add_parser("tags")
    sub.add_parser("info")
    sub.add_parser("vacuum").add_argument("--retention", type=float, default=86_400.0)
    sub.add_parser("rechunk").add_argument("words", type=int)
    sub.add_parser("reembed")
    return p


def execute(spark: SparkSession, args: Sequence[str]) -> DataFrame | str:
    """Rows to print, or a line that says what was done."""
    a = parser().parse_args(args)
    corpus = Corpus(spark, a.store)
    store = corpus.store
    match a.command:
        case "list":
            return corpus.documents(a.filter, a.limit, a.offset)
        case "history":
            return store.history(a.limit)
        case "search":
            return corpus.search(a.text, a.limit, a.kind, a.filter)
        case "get":
            ids = store.read("document_meta").where(F.col("uri") == a.uri)
            return ids.join(store.read("documents"), "id")
        case "info":
            return store.info()
        case "tags":
            return spark.createDataFrame(sorted(store.tags().items()), "tag string, version long")
        case "add":
            return f"version {corpus.add(spark.createDataFrame([(a.uri, a.title, a.text)], 'uri string, title string, content string'))}"
        case "add-files":
            files = spark.read.text(a.root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_name").alias("title"), F.col("value").alias("content"))
            return f"version {corpus.add(files if store.version() == 0 else corpus.changed(files))}"
        case "delete":
            return f"version {corpus.delete(a.uri)}"
        case "tag":
            store.tag(a.name)
            return f"tagged {a.name}"
        case "untag":
            return f"removed {a.name}" if store.untag(a.name) else f"no tag {a.name}"
        case "restore":
            return f"version {store.restore(a.name)}"
        case "vacuum":
            return f"removed {len(store.vacuum(a.retention))} folders"
        case "rechunk":
            return f"version {corpus.rechunk(a.words)}"
        case _:
            return f"version {corpus.reembed(corpus.embed)}"


def main(args: Sequence[str] | None = None) -> None:
    spark = SparkSession.builder.getOrCreate()
    done = execute(spark, args)
    if isinstance(done, str):
        print(done)
    else:
        for row in done.toJSON().toLocalIterator():
            print(row)


if __name__ == "__main__":
    main()
