"""Command line: python -m quillgraph --store FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from . import models
from .plans.store import Store
from .session import local


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillgraph")
    p.add_argument("--store", default=".quillgraph")
    c = p.add_subparsers(dest="command", required=True)
    c.add_parser("init")
    add = c.add_parser("add")
    add.add_argument("path")
    add.add_argument("--domain")
    find = c.add_parser("search")
    find.add_argument("query")
    find.add_argument("--mode", default=None, choices=("keyword", "vector", "hybrid"))
    find.add_argument("--domain", default="")
    find.add_argument("--top", type=int)
    ask = c.add_parser("ask")
    ask.add_argument("question")
    ask.add_argument("--domain", default="")
    for name in ("neighbors", "trace"):
        c.add_parser(name).add_argument("node")
    link = c.add_parser("link")
    link.add_argument("source")
    link.add_argument("target")
    link.add_argument("--type", default="references")
    rel = c.add_parser("relate")
    rel.add_argument("--domain")
    rel.add_argument("--threshold", type=float)
    for name in ("graph", "quality", "verify", "repair", "gc", "optimize", "vacuum"):
        c.add_parser(name).add_argument("--domain", default="")
    c.add_parser("reindex").add_argument("what", nargs="?", default="all")
    web = c.add_parser("serve")
    web.add_argument("--port", type=int, default=8420)
    web.add_argument("--tools", action="store_true", help="JSON-RPC over standard input instead of HTTP")
    web.add_argument("--tool-prefix", default="", help="what clients put before the tools' names")
    setting = c.add_parser("config")
    setting.add_argument("key", nargs="?")
    setting.add_argument("value", nargs="?")
    a = p.parse_args(argv)

    store = models.connect(Store(local(), a.store))
    if a.command == "serve":
        from . import server

        server.serve_tools(store, prefix=a.tool_prefix) if a.tools else server.serve(store, port=a.port).serve_forever()
        return 0
    rows = lambda df: [r.asDict(True) for r in df.collect()]
    run = {
        "init": lambda: store.init() and "ready",
        "add": lambda: store.init().add(a.path, a.domain),
        "search": lambda: rows(store.search(a.query, a.mode, domain=a.domain, top=a.top)),
        "ask": lambda: asdict(store.ask(a.question, domain=a.domain)),
        "neighbors": lambda: rows(store.neighbors(a.node)),
        "trace": lambda: rows(store.trace(a.node)),
        "link": lambda: store.link(a.source, a.target, a.type) or "linked",
        "relate": lambda: {"edges": store.relate(a.domain, a.threshold)},
        "graph": lambda: rows(store.graph(a.domain)),
        "quality": lambda: rows(store.quality(a.domain)),
        "verify": lambda: rows(store.verify()),
        "repair": lambda: {"edges": store.repair()},
        "gc": store.gc,
        "optimize": lambda: store.optimize() or "done",
        "vacuum": lambda: store.vacuum() or "clean",
        "reindex": lambda: store.reindex(a.what) or "done",
        "config": lambda: store.set(a.key, a.value) or "set" if a.value is not None else store.config().get(a.key) if a.key else store.config(),
    }
    print(json.dumps(run[a.command](), default=str, indent=1))
    return 0


if __name__ == "__main__":
    sys.exit(main())
