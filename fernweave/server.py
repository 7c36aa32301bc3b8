"""A tool server: JSON-RPC with tools/list and tools/call, by lines on stdin or as stateless HTTP posts."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import TextIO

from pyspark.sql import SparkSession

from .config import paths
from .operators.embed import HashingEmbedder, read_index
from .operators.results import tools
from .sources.ntriples import open_graph


def loaded(spark: SparkSession, graph: str | None = None, vectors: str | None = None, fmt: str = "parquet") -> dict[str, Callable[..., dict]]:
    """The tools over a stored graph and its index; the graph's table is cached, so that calls share it."""
    where = paths()
    g = open_graph(spark, graph or where.graph, fmt)
    g.quads.cache()
    index = read_index(spark, vectors or where.vectors)
    return tools(g, index, HashingEmbedder(index[2]["dim"]) if index else None)


def answer(own: dict[str, Callable[..., dict]], request: dict) -> dict:
    """The response to one request; a tool's error is a response too."""
    out: dict = {"jsonrpc": "2.0", "id": request.get("id")}
    params = request.get("params") or {}
    if request.get("method") == "tools/list":
        return out | {"result": {"tools": sorted(own)}}
    if request.get("method") != "tools/call" or params.get("name") not in own:
        return out | {"error": {"code": -32601, "message": "no such method or tool"}}
    try:
        return out | {"result": own[params["name"]](**(params.get("arguments") or {}))}
    except (TypeError, ValueError) as e:
        return out | {"error": {"code": -32602, "message": str(e)}}


def serve_lines(own: dict[str, Callable[..., dict]], src: TextIO = sys.stdin, dst: TextIO = sys.stdout) -> None:
    for line in src:
        if line.strip():
            print(json.dumps(answer(own, json.loads(line)), default=str), file=dst, flush=True)


def http_server(own: dict[str, Callable[..., dict]], port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                out, code = answer(own, json.loads(body)), 200
            except ValueError:
                out, code = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}, 400
            data = json.dumps(out, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *a):
            pass

    return ThreadingHTTPServer((host, port), Handler)
