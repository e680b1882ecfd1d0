"""HTTP and stdio front ends, and the cell index."""

import io
import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest

from corvane.api import Engine
from corvane.config import Config
from corvane.operators import ivf
from corvane.operators.search import top_k
from corvane.serve import http_server, serve_stdio


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("served")
    (root / "src").mkdir()
    (root / "src/a.md").write_text("# Pears\n" + "pear plum fig " * 30 + "\n# Cars\n" + "wheel motor " * 40)
    out = Engine(spark, Config(workspace_root=str(root), collection_path=str(root / ".c"), ledger_path=str(root / ".l"), embedding_dimensions=64))
    out.index()
    return out


@pytest.fixture(scope="module")
def call(engine):
    server = http_server(engine, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def one(path, body=None):
        data = None if body is None else body if isinstance(body, bytes) else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", data)) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    yield one
    server.shutdown()


def test_http(call):
    assert call("/health") == (200, '{"status": "ok"}')
    assert json.loads(call("/stats")[1])["data"] == {"count": 2}
    status, text = call("/search", {"query": "pear fig"})
    assert status == 200 and text.startswith("# Search") and "• Pears •" in text
    found = json.loads(call("/search", {"query": "pear fig", "format": "json", "top_k": "1", "include": ["module"]})[1])["data"]
    assert found["count"] == 1 and found["results"][0]["module"] == "src" and found["topK"] == 1 and "filters" not in found
    clip = json.loads(call(f"/clip/{found['results'][0]['id']}")[1])["data"]
    assert clip["filePath"] == "src/a.md" and clip["content"].startswith("# Pears")
    assert [call(p)[0] for p in ("/clip/99", "/clip/x", "/clips", "/clips?ids=1,x", "/nowhere")] == [404, 400, 400, 400, 404]
    batch = json.loads(call("/clips?ids=1&ids=99,1")[1])["data"]
    assert (batch["requested"], batch["succeeded"], batch["failed"]) == (3, 2, 1) and batch["results"][1]["success"] is False
    assert json.loads(call("/clips", {"ids": [1]})[1])["data"]["succeeded"] == 1
    read = json.loads(call("/read", {"filePath": "src/a.md", "startLine": 1, "endLine": 1})[1])["data"]
    assert read["content"] == "# Pears" and read["rangeRequested"] == {"startLine": 1, "endLine": 1}
    for path, body in (("/search", {}), ("/search", {"query": "a", "min_score": 0.1, "min_score_diff": 0.1}), ("/search", b"{"), ("/read", {"filePath": "src/a.md"}), ("/clips", {"ids": "1"}), ("/clips", {"ids": []})):
        assert call(path, body)[0] == 400
    assert call("/read", {"filePath": "../etc", "startLine": 1, "endLine": 1})[0] == 403


def test_stdio(engine):
    def tool(k, name, **arguments):
        return {"jsonrpc": "2.0", "id": k, "method": "tools/call", "params": {"name": name, "arguments": arguments}}

    asked = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {}}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        tool(3, "codebase_semantic_search", query="motor", format="json"), tool(4, "codebase_semantic_search", query="motor", top_k=500), tool(5, "codebase_clip", ids=[1, 1, 77]),
        tool(6, "codebase_clip"), tool(7, "codebase_read_file", filePath="src/a.md", startLine=3, endLine=9), tool(8, "codebase_stats"), {"jsonrpc": "2.0", "id": 9, "method": "x"}]
    out = io.StringIO()
    serve_stdio(engine, io.StringIO("\n".join(map(json.dumps, asked)) + "\nnot json\n"), out)
    got = {a["id"]: a for a in map(json.loads, out.getvalue().splitlines())}
    assert set(got) == {None, *range(1, 10)} and len(got[2]["result"]["tools"]) == 4
    text = {k: got[k]["result"]["content"][0]["text"] for k in range(3, 9)}
    assert json.loads(text[3])["results"][0]["symbolName"] == "Cars"
    assert got[4]["result"]["isError"] and got[6]["result"]["isError"]
    assert json.loads(text[5])["requested"] == 2 and json.loads(text[7])["totalLines"] == 4 and json.loads(text[8])["embeddingDimensions"] == 64
    assert got[9]["error"]["code"] == -32601 and got[None]["error"]["code"] == -32700


def test_cells_prune_and_find(spark, tmp_path, capsys):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(20, 16))
    x = centres[rnd.integers(0, 20, 1500)] + 0.3 * rnd.normal(size=(1500, 16))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(9999, [0.0] * 16)], "id long, embedding array<float>")
    index = ivf.fit_cells(table, 32)
    ivf.write_cells(table, index, str(tmp_path / "cells"))
    stored = spark.read.parquet(str(tmp_path / "cells"))
    hit = 0
    for q in range(0, 100, 10):
        found = ivf.search_cells(stored, index, x[q].tolist(), 10, probes=6)
        hit += len({r["id"] for r in found.collect()} & {r["id"] for r in top_k(table, x[q].tolist(), 10).collect()})
    assert hit >= 90
    found.explain("formatted")
    assert "PartitionFilters" in capsys.readouterr().out
    full = ivf.search_cells(stored, index, x[0].tolist(), 10, probes=32)
    assert [r["id"] for r in full.collect()] == [r["id"] for r in top_k(table, x[0].tolist(), 10).collect()]
