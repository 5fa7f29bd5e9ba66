"""Command line: ``python -m notelake --root NOTES --store STORE COMMAND ...``; every result is one JSON line a row."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .model import DocumentFilter, parse_instant
from .operators import graph, population
from .plans import maintenance
from .plans.vault import Vault
from .session import build_session


def _filter(a: argparse.Namespace) -> DocumentFilter:
    tags = tuple(tuple(t.split("=", 1)) for t in a.tag or ())
    return DocumentFilter(
        query=a.query, scope=a.scope, path=a.path, folder=a.folder, path_glob=a.glob, path_prefix=a.prefix, path_contains=a.contains, tags=tags,
        modified_from=a.since and parse_instant(a.since), modified_to=a.until and parse_instant(a.until),
    )


COMMANDS: dict[str, Callable[[Vault, argparse.Namespace], object]] = {
    "build": lambda v, a: {"generation": v.build()},
    "reindex": lambda v, a: v.reindex(),
    "status": lambda v, a: v.status() | {"embeddings": maintenance.embedding_status(v)},
    "stats": lambda v, a: v.stats(),
    "list": lambda v, a: population.listing(v.documents, a.glob, a.folder).select("path", "title"),
    "recent": lambda v, a: population.recent(v.documents, a.limit, a.folder).select("path", "modified_at"),
    "folders": lambda v, a: population.distinct_folders(v.documents),
    "tags": lambda v, a: population.distinct_values(v.table("tags"), a.key or "tags"),
    "skipped": lambda v, a: population.skipped(v.documents),
    "query": lambda v, a: v.query_documents(_filter(a), a.limit, a.offset, a.order, a.sections)[0].drop("frontmatter", "path_folded"),
    "count": lambda v, a: {"total": v.count_documents(_filter(a))},
    "aggregate": lambda v, a: v.aggregate_documents(_filter(a), a.by, a.key, a.limit),
    "path": lambda v, a: v.search_paths(a.query or "", limit=a.limit),
    "search": lambda v, a: v.search(a.query or "", a.mode, a.limit, folder=a.folder),
    "similar": lambda v, a: v.similar(a.path, a.limit),
    "toc": lambda v, a: [{"level": n, "heading": h} for n, h in v.toc(a.path)],
    "read": lambda v, a: v.read(a.path),
    "backlinks": lambda v, a: graph.backlinks(v.links, v.documents, a.path),
    "outlinks": lambda v, a: graph.outlinks(v.links, v.documents, a.path),
    "broken": lambda v, a: graph.broken_links(v.links, v.documents, a.folder),
    "orphans": lambda v, a: graph.orphans(v.links, v.documents).select("path"),
    "hubs": lambda v, a: graph.most_linked(v.links, v.documents, a.limit),
    "connect": lambda v, a: {"path": graph.shortest_path(v.links, v.documents, a.path, a.to)},
    "neighbours": lambda v, a: graph.neighbourhood(v.links, v.documents, a.path, a.depth)[0],
    "citing": lambda v, a: v.citing(a.query),
    "audit": lambda v, a: v.okf_audit(),
}


def main(argv: list[str], spark: SparkSession | None = None, out=sys.stdout) -> None:
    p = argparse.ArgumentParser(prog="notelake")
    p.add_argument("--root", required=True)
    p.add_argument("--store", required=True)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("query", nargs="?")
    for name in ("path", "to", "folder", "glob", "prefix", "contains", "since", "until", "key"):
        p.add_argument(f"--{name}")
    p.add_argument("--tag", action="append", metavar="KEY=VALUE")
    p.add_argument("--scope", default="all", choices=("all", "metadata", "body"))
    p.add_argument("--by", default="folder", choices=("folder", "tag", "month"))
    p.add_argument("--order", default="auto", choices=("auto", "path", "folded_path"))
    p.add_argument("--mode", default="auto", choices=("auto", "keyword", "semantic", "hybrid"))
    for name, default in (("limit", 20), ("offset", 0), ("sections", 0), ("depth", 2)):
        p.add_argument(f"--{name}", type=int, default=default)
    a = p.parse_args(argv)
    found = COMMANDS[a.command](Vault(spark or build_session(), a.root, a.store), a)
    rows = (r.asDict(recursive=True) for r in found.toLocalIterator()) if isinstance(found, DataFrame) else found if isinstance(found, list) else [] if found is None else [found]
    for row in rows:
        print(json.dumps(row, ensure_ascii=False, default=str), file=out)


if __name__ == "__main__":
    main(sys.argv[1:])
