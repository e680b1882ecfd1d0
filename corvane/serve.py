"""The engine behind HTTP and behind JSON-RPC tools on standard input and output."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import IO, Any
from urllib.parse import parse_qs, urlparse

from .api import Engine
from .functions.requests import MESSAGES, RequestError, parse_ids
from .sources.embedders import EmbedError

PORT, MOST_BODY = 7700, 10 << 20


def _slice_fields(row: dict[str, Any]) -> dict[str, Any]:
    names = (("filePath", "file_path"), ("startLine", "start_line"), ("endLine", "end_line"), ("totalLines", "total_lines"), ("content", "content"))
    return {n: row[c] for n, c in names}


def batch_payload(engine: Engine, ids: Any, *, distinct: bool = False) -> dict[str, Any]:
    """Slices by id, each with success or error, and the counts."""
    got = engine.clip_batch(ids, distinct=distinct)
    items = [{"id": r["id"], "success": True, **_slice_fields(r)} if r["success"] else {"id": r["id"], "success": False, "error": r["error"]} for r in got["results"]]
    return {"results": items} | {k: got[k] for k in ("requested", "succeeded", "failed", "clipStoreSize")}


def read_payload(engine: Engine, body: dict[str, Any]) -> dict[str, Any]:
    start, end = body.get("startLine"), body.get("endLine")
    if any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in (start, end)):
        raise RequestError(MESSAGES["lines"])
    if not isinstance(body.get("filePath"), str) or not body["filePath"]:
        raise RequestError(MESSAGES["file_path"])
    return _slice_fields(engine.read_slice(body["filePath"], start, end)) | {"rangeRequested": {"startLine": start, "endLine": end}}


def respond(engine: Engine, method: str, target: str, body: Any) -> tuple[int, str, str]:
    """(status, content type, text) of one request."""
    at = urlparse(target)
    route, body = (method, at.path.rstrip("/") or "/"), body if isinstance(body, dict) else {}
    try:
        if route == ("GET", "/health"):
            return _json(200, engine.health())
        if route == ("GET", "/stats"):
            return _json(200, {"success": True, "data": {"count": engine.stats()["chunkCount"]}})
        if route == ("POST", "/search"):
            options = {k: v for k, v in body.items() if k != "query"}
            known = ("top_k", "module", "language", "chunk_type", "min_score", "min_score_diff", "include", "format")
            found = engine.search(body.get("query"), **{k: options[k] for k in known if k in options})
            if "markdown" in found:
                return 200, "text/markdown; charset=utf-8", found["markdown"]
            return _json(200, {"success": True, "data": {k: v for k, v in found.items() if k != "filters"}})
        if route == ("POST", "/read"):
            return _json(200, {"success": True, "data": read_payload(engine, body)})
        if method == "GET" and at.path.startswith("/clip/"):
            row = engine.clip(at.path.removeprefix("/clip/"))
            return _json(200, {"success": True, "data": {"id": row["id"], **_slice_fields(row)}})
        if route == ("GET", "/clips"):
            return _json(200, {"success": True, "data": batch_payload(engine, parse_ids(parse_qs(at.query).get("ids", [])))})
        if route == ("POST", "/clips"):
            ids = body.get("ids")
            if not isinstance(ids, list) or any(isinstance(i, bool) or not isinstance(i, int) for i in ids):
                raise RequestError(MESSAGES["id_list"])
            return _json(200, {"success": True, "data": batch_payload(engine, ids)})
        return _json(404, {"success": False, "error": "not found"})
    except RequestError as e:
        return _json(e.status, {"success": False, "error": str(e)})
    except EmbedError as e:
        return _json(502, {"success": False, "error": str(e)})
    except Exception as e:  # noqa: BLE001 - a server tells the failure and goes on
        return _json(500, {"success": False, "error": str(e).split("\n")[0]})


def _json(status: int, value: Any) -> tuple[int, str, str]:
    return status, "application/json", json.dumps(value)


def http_server(engine: Engine, port: int = PORT, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is ready for ``serve_forever``."""
    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(size) or b"{}") if size <= MOST_BODY else None
            except ValueError:
                body = None
            status, kind, text = respond(engine, self.command, self.path, body) if body is not None else _json(400, {"success": False, "error": "the body isn't JSON"})
            raw = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _answer

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


# -- tools on standard input and output -----------------------------------------------------

_TEXT, _LINE = {"type": "string"}, {"type": "number"}
_ID = {"type": "integer", "minimum": 1}
#: Names of the tools and of their arguments.
TOOLS: dict[str, tuple[str, dict[str, Any], list[str]]] = {
    "codebase_semantic_search": ("Search the indexed files by meaning; returns ranked chunks with clip ids.", {
        "query": _TEXT, "top_k": {"type": "integer", "minimum": 1, "maximum": 100}, "module": _TEXT, "language": _TEXT, "chunk_type": _TEXT,
        "min_score": {"type": "number", "minimum": 0, "maximum": 1}, "min_score_diff": {"type": "number", "minimum": 0, "maximum": 1},
        "include": {"type": "array", "items": {"enum": ["chunkType", "module", "language"]}}, "format": {"enum": ["markdown", "json"]}}, ["query"]),
    "codebase_read_file": ("Read a range of lines of a file.", {"filePath": _TEXT, "startLine": _LINE, "endLine": _LINE}, ["filePath", "startLine", "endLine"]),
    "codebase_clip": ("Fetch the text of one clip id, or of several.", {"id": _ID, "ids": {"type": "array", "items": _ID}}, []),
    "codebase_stats": ("Tell how many chunks are indexed, and by which model.", {}, []),
}


def call_tool(engine: Engine, name: str, args: dict[str, Any]) -> str:
    """The text of a tool's answer; a bad call raises RequestError."""
    if name == "codebase_semantic_search":
        found = engine.search(args.get("query"), strict=True, **{k: v for k, v in args.items() if k != "query"})
        return found["markdown"] if "markdown" in found else json.dumps(found, indent=2)
    if name == "codebase_read_file":
        return json.dumps(read_payload(engine, args), indent=2)
    if name == "codebase_clip":
        if ("id" in args) == ("ids" in args):
            raise RequestError(MESSAGES["id_or_ids"])
        return json.dumps(batch_payload(engine, [args["id"]] if "id" in args else args["ids"], distinct=True), indent=2)
    if name == "codebase_stats":
        return json.dumps(engine.stats(), indent=2)
    raise RequestError(f"no tool named {name}")


def handle_message(engine: Engine, message: dict[str, Any]) -> dict[str, Any] | None:
    """The answer to one JSON-RPC message; None for a notification."""
    if "id" not in message:
        return None
    params = message.get("params") or {}
    methods: dict[str, Callable[[], Any]] = {
        "initialize": lambda: {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "corvane", "version": "1"}},
        "ping": dict,
        "tools/list": lambda: {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]},
    }
    head = {"jsonrpc": "2.0", "id": message["id"]}
    if message.get("method") == "tools/call":
        try:
            text, bad = call_tool(engine, params.get("name", ""), params.get("arguments") or {}), False
        except Exception as e:  # noqa: BLE001 - told to the caller
            text, bad = f"{params.get('name')} failed: {str(e).splitlines()[0] if str(e) else type(e).__name__}", True
        return head | {"result": {"content": [{"type": "text", "text": text}]} | ({"isError": True} if bad else {})}
    if message.get("method") in methods:
        return head | {"result": methods[message["method"]]()}
    return head | {"error": {"code": -32601, "message": "method not found"}}


def serve_stdio(engine: Engine, lines: IO[str] = sys.stdin, out: IO[str] = sys.stdout) -> None:
    """One JSON message a line, until the input ends."""
    for line in lines:
        if line.strip():
            try:
                answer = handle_message(engine, json.loads(line))
            except ValueError:
                answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
            if answer is not None:
                print(json.dumps(answer), file=out, flush=True)
