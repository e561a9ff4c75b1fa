import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from quillgraph import server
from quillgraph.plans.store import Store


@pytest.fixture
def store(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.txt").write_text("the fox sleeps")
    s = Store(spark, str(tmp_path / "store")).init()
    s.add(str(tmp_path / "src"))
    return s


def test_http(store):
    web = server.serve(store, port=0)
    threading.Thread(target=web.serve_forever, daemon=True).start()

    def call(path, body=None):
        data = None if body is None else json.dumps(body).encode() if not isinstance(body, bytes) else body
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{web.server_port}{path}", data)) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert call("/health") == (200, {"status": "ok"})
        status, hits = call("/search", {"query": "fox", "mode": "keyword"})
        assert status == 200 and hits[0]["path"] == "a/01.txt" and hits[0]["content"] == "the fox sleeps"
        assert call("/link", {"source": "a/01.txt", "target": "b"})[0] == 200
        assert [r["node"] for r in call("/neighbors/b")[1]] == ["a/01.txt"]
        assert [r["etype"] for r in call("/trace/a%2F01.txt")[1]] == ["chunked_from", "origin"]
        assert call("/graph/")[1]["chunks"] == 1 and call("/graph?domain=x")[1]["chunks"] == 0 and call("/graph")[1]["edge_types"]["references"] == 1
        assert [r["node"] for r in call("/neighbors?node=b")[1]] == ["a/01.txt"]
        assert call("/search", {})[0] == 422 and call("/search", {"query": "x", "mode": "none"})[0] == 422
        assert call("/nothing")[0] == 404 and call("/search", b"{")[0] == 400
    finally:
        web.shutdown()
        web.server_close()


def test_tools(store):
    ask = [
        {"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "fox"}}},
        {"id": 4, "method": "tools/call", "params": {"name": "graph"}}, {"id": 5, "method": "nothing"}, {"id": 6, "method": "tools/call", "params": {"name": "ask"}},
    ]
    out = io.StringIO()
    server.serve_tools(store, io.StringIO("\n".join(map(json.dumps, ask))), out)
    said = {x["id"]: x for x in map(json.loads, out.getvalue().splitlines())}
    assert len(said) == 6 and len(said[2]["result"]["tools"]) == 6
    assert said[3]["result"]["content"][0]["text"].startswith("a/01.txt (") and '"chunks": 1' in said[4]["result"]["content"][0]["text"]
    renamed = server.answer(server.Api(store), {"id": 7, "method": "tools/call", "params": {"name": "my_search", "arguments": {"query": "fox", "mode": "keyword", "explain": True}}}, "my_")
    assert "bm25: " in renamed["result"]["content"][0]["text"]
    assert said[5]["error"]["code"] == -32601 and said[6]["result"]["isError"]
