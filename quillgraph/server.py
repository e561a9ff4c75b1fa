"""Thin adapters over a store: HTTP with JSON, and tools over JSON-RPC lines."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any, TextIO
from urllib.parse import parse_qs, quote, unquote, urlsplit

from .plans.store import Store


def _rows(df) -> list[dict]:
    return [r.asDict(True) for r in df.collect()]


def _hits(store: Store, query: str, mode: str, domain: str, top: int) -> list[dict]:
    found = sorted(_rows(store.search(query, mode, domain=domain, top=top)), key=lambda r: r["rank"])
    return [{"path": r["path"], "score": round(r["score"], 6), "content": r["content"], "domain": r["domain"], "explain": r["explain"]} for r in found]


class Api:
    """The nine calls of the HTTP interface."""

    def __init__(self, store: Store):
        self.store = store.init()
        self.posts: dict[str, Callable[[dict], Any]] = {
            "/add": lambda b: self.store.add(b["path"], b.get("domain")),
            "/search": lambda b: _hits(self.store, b["query"], b.get("mode"), b.get("domain") or "", b.get("top", 10)),
            "/ask": lambda b: asdict(self.store.ask(b["question"], domain=b.get("domain") or "")),
            "/link": lambda b: self.store.link(b["source"], b["target"], b.get("edge_type", "references")) or {"status": "ok"},
            "/relate": lambda b: {"status": "ok", "edges": self.store.relate(b.get("domain"), b.get("threshold"))},
        }
        self.gets: dict[str, Callable[[str, dict[str, str]], Any]] = {
            "/health": lambda _, q: {"status": "ok"},
            "/graph": lambda domain, q: _rows(self.store.graph(q.get("domain") or domain))[0],
            "/neighbors": lambda node, q: _rows(self.store.neighbors(q.get("node") or node)),
            "/trace": lambda node, q: sorted(_rows(self.store.trace(q.get("node") or node)), key=lambda r: r["step"]),
        }

    def call(self, method: str, path: str, body: dict | None = None) -> tuple[int, Any]:
        """(status, answer): 404 for an unknown call, 422 for a missing or wrong value."""
        url = urlsplit(path)
        asked = {k: v[-1] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
        head, _, rest = url.path.lstrip("/").partition("/")
        name = f"/{head}"
        try:
            if method == "GET" and name in self.gets:
                return 200, self.gets[name](unquote(rest), asked)
            if method == "POST" and name in self.posts:
                return 200, self.posts[name](body or {})
        except (KeyError, ValueError) as e:
            return 422, {"error": str(e)}
        return 404, {"error": f"no {method} {path}"}


def serve(store: Store, host: str = "127.0.0.1", port: int = 8420) -> ThreadingHTTPServer:
    """An HTTP server, not yet running; ``serve_forever`` runs it."""
    api = Api(store)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            n = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(n) or b"{}")
                status, said = api.call(self.command, self.path, body)
            except json.JSONDecodeError as e:
                status, said = 400, {"error": str(e)}
            raw = json.dumps(said, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _answer

        def log_message(self, *_: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def _text(name: str, said: Any, given: dict) -> str:
    """A tool's answer as text; search results as a preview of 200 characters each, with their scores if asked for."""
    if name != "search":
        return json.dumps(said, default=str, indent=1)
    told = lambda r: "\n" + ", ".join(f"{k}: {v:.4f}" for k, v in r["explain"].items()) if given.get("explain") else ""
    return "\n\n".join(f"{r['path']} ({r['score']:.4f}){told(r)}\n{r['content'][:200]}" for r in said) or "Nothing found."


#: The tools: name to (call, what it takes).
TOOLS = {
    "search": (("POST", "/search"), {"query": "string", "mode": "string", "domain": "string", "top": "integer", "explain": "boolean"}),
    "ask": (("POST", "/ask"), {"question": "string", "domain": "string"}),
    "add": (("POST", "/add"), {"path": "string", "domain": "string"}),
    "graph": (("GET", "/graph?domain={domain}"), {"domain": "string"}),
    "neighbors": (("GET", "/neighbors?node={node}"), {"node": "string"}),
    "trace": (("GET", "/trace?node={node}"), {"node": "string"}),
}


def answer(api: Api, request: dict, prefix: str = "") -> dict | None:
    """The answer to one JSON-RPC request; None for a notification. ``prefix``: what clients put before the tools' names."""
    if "id" not in request:
        return None
    method, p = request.get("method"), request.get("params") or {}
    said: dict = {"jsonrpc": "2.0", "id": request["id"]}
    if method == "initialize":
        return said | {"result": {"protocolVersion": p.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "quillgraph", "version": "0.1.0"}}}
    if method == "tools/list":
        return said | {"result": {"tools": [{"name": prefix + n, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in takes.items()}}} for n, (_, takes) in TOOLS.items()]}}
    name = (p.get("name") or "").removeprefix(prefix)
    if method == "tools/call" and name in TOOLS:
        (verb, path), takes = TOOLS[name]
        given = {k: "" for k in takes} | (p.get("arguments") or {}) if verb == "GET" else p.get("arguments") or {}
        status, result = api.call(verb, path.format(**{k: quote(str(v)) for k, v in given.items()}) if verb == "GET" else path, given)
        return said | {"result": {"content": [{"type": "text", "text": _text(name, result, given) if status == 200 else json.dumps(result)}], "isError": status != 200}}
    return said | {"error": {"code": -32601, "message": f"no method {method}"}}


def serve_tools(store: Store, lines: TextIO = sys.stdin, out: TextIO = sys.stdout, prefix: str = "") -> None:
    """Answer JSON-RPC requests, one a line."""
    api = Api(store)
    for line in lines:
        if line.strip():
            said = answer(api, json.loads(line), prefix)
            if said is not None:
                print(json.dumps(said, default=str), file=out, flush=True)
