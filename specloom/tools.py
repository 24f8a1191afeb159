"""The queries as tools of an agent: a table of tools with their parameters, a dispatcher, JSON-RPC over standard input and output, and the same answers over HTTP.

    python -m specloom.tools --index-path DIR --specs SPECS [--http PORT]

An answer is text in JSON; a query that can't be answered is an answer marked ``isError``, never an exception."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, HTTPServer
from typing import TextIO
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, SparkSession

from .functions.vectors import HashingEncoder
from .operators import graph as G
from .operators import retrieval as R
from .runtime import cut
from .sources import store

#: Rows of one answer; a longer result says that it was cut.
MOST_ROWS = 1000


@dataclass
class Opened:
    """An index opened for questions: the graph is built once, its parts cut from their lineage."""

    spark: SparkSession
    path: str
    specs: str | None = None
    encode: Callable | None = None

    def __post_init__(self):
        opened = store.open_index(self.spark, self.path)
        self.manifest, self.chunks = opened.manifest, opened.embeddings
        self.encode = self.encode or HashingEncoder(int(self.manifest.get("embedding_dimensions") or 64))
        built = G.build(opened.nodes, opened.edges)
        self.graph = G.Graph(cut(built.nodes), cut(built.edges), built.orphans)


def _rows(df: DataFrame, *order) -> dict:
    got = [json.loads(r) for r in (df.orderBy(*order) if order else df).limit(MOST_ROWS + 1).toJSON().collect()]  # a bounded answer
    return {"rows": got[:MOST_ROWS], "cut": len(got) > MOST_ROWS}


def _list(text) -> list[str] | None:
    return None if text in (None, "") else [x.strip() for x in text.split(",")] if isinstance(text, str) else list(text)


def _search(o: Opened, query: str = "", kind=None, limit: int = 10, min_score: float = 0.3):
    r = R.hybrid(o.graph, o.chunks, query, o.encode, kinds=_list(kind), limit=int(limit), min_score=float(min_score))
    return {"results": _rows(r.results, "rank"), "warnings": r.warnings}


def _find_spec(o: Opened, name: str = ""):
    r = R.find_spec(o.graph, o.chunks, name, o.encode)
    return {"results": _rows(r.results, "rank"), "warnings": r.warnings}


def _related(o: Opened, node_id: str = "", depth: int = 2, kind=None):
    r = R.related(o.graph, node_id, int(depth), kinds=_list(kind))
    return {"nodes": _rows(r.nodes, "distance", "node_id"), "edges": _rows(r.edges.select("from_node", "to_node", "edge_type"), "from_node", "to_node"), "layer_violations": _rows(r.layer_violations)}


def _impact(o: Opened, node_id: str = "", depth: int = 3):
    i = R.impact(o.graph, node_id, depth=int(depth))
    return {"direct": _rows(i.direct, "node_id"), "transitive": _rows(i.transitive, "node_id"), "scenarios": _rows(i.scenarios, "node_id"), "truncated": i.truncated}


def _semantic(o: Opened, query: str = "", kind=None, limit: int = 10, min_score: float = 0.7):
    if o.chunks is None:
        raise R.QueryError("NO_EMBEDDINGS", "the index has no vectors")
    return _rows(R.semantic(o.graph, o.chunks, query, o.encode, float(min_score), int(limit), _list(kind)))


def _coverage(o: Opened, node_id: str = ""):
    c = R.coverage(o.graph, node_id)
    return {"categories": _rows(c, "category_rank"), "links": _rows(R.coverage_links(o.graph, node_id), "category", "other"), "percent": _rows(R.coverage_percent(c))}


def _violations(o: Opened, kind=None, layer=None):
    v = R.layer_violations(o.graph, _list(kind), _list(layer))
    return {"violations": _rows(v, "from_node", "to_node"), "rate": _rows(R.rate(v, o.graph.edges, "violations"))}


def _context(o: Opened, hints=(), depth: int = 1, max_tokens: int = 4000):
    c = R.context(o.graph, _list(hints) or [], int(depth), int(max_tokens))
    return {"constraints": _rows(c.constraints, "rank"), "behavior": _rows(c.behavior, "rank"), "warnings": c.warnings}


def _read_section(o: Opened, file: str = "", anchor: str | None = None):
    if o.specs is None:
        raise R.QueryError("BAD_PARAMETER", "no folder of specs is given")
    return store.read_section(o.spark, o.specs, file, anchor)


def _listing(o: Opened, kind=None, domain: str | None = None):
    return _rows(R.listing(o.graph.nodes, _list(kind), domain or None), "id")


def _stats(o: Opened):
    chunks = o.chunks if o.chunks is not None else o.graph.nodes.limit(0)
    return {"manifest": json.loads(json.dumps(o.manifest, default=str)), "counts": _rows(R.stats(o.graph, chunks), "what")}


_TEXT, _NUMBER, _TEXTS = {"type": "string"}, {"type": "number"}, {"type": "array", "items": {"type": "string"}}
#: name: (function, what it does, parameters, those that must be given)
TOOLS: dict[str, tuple[Callable, str, dict, list[str]]] = {
    "search": (_search, "Specs that answer a text, by vectors, graph and words together.", {"query": _TEXT, "kind": _TEXT, "limit": _NUMBER, "min_score": _NUMBER}, ["query"]),
    "find_spec": (_find_spec, "A spec by its name or id.", {"name": _TEXT}, ["name"]),
    "related": (_related, "Specs within some hops of one.", {"node_id": _TEXT, "depth": _NUMBER, "kind": _TEXT}, ["node_id"]),
    "impact": (_impact, "What depends on a spec, and the scenarios to run again if it changes.", {"node_id": _TEXT, "depth": _NUMBER}, ["node_id"]),
    "read_section": (_read_section, "The text of a spec file or of one of its sections.", {"file": _TEXT, "anchor": _TEXT}, ["file"]),
    "list": (_listing, "All specs, of some kinds or a domain.", {"kind": _TEXT, "domain": _TEXT}, []),
    "stats": (_stats, "Counts of the index.", {}, []),
    "context": (_context, "Rules and behaviour that bear on files, specs or words, within a budget.", {"hints": _TEXTS, "depth": _NUMBER, "max_tokens": _NUMBER}, ["hints"]),
    "semantic": (_semantic, "Specs by vectors alone.", {"query": _TEXT, "kind": _TEXT, "limit": _NUMBER, "min_score": _NUMBER}, ["query"]),
    "coverage": (_coverage, "Which kinds of neighbours a spec should have and has.", {"node_id": _TEXT}, ["node_id"]),
    "violations": (_violations, "Links against the order of layers.", {"kind": _TEXT, "layer": _TEXT}, []),
}


def describe() -> list[dict]:
    return [{"name": n, "description": what, "inputSchema": {"type": "object", "properties": p, "required": need}} for n, (_, what, p, need) in TOOLS.items()]


def call(opened: Opened, name: str, arguments: dict | None = None) -> dict:
    """The answer of a tool: {"content": [{"type": "text", "text": ...}]}, with "isError" where there is none."""
    try:
        if name not in TOOLS:
            raise R.QueryError("BAD_PARAMETER", f"unknown tool {name}")
        run, _, known, need = TOOLS[name]
        given = {k: v for k, v in (arguments or {}).items() if v is not None}
        wrong = [k for k in given if k not in known] + [k for k in need if k not in given]
        if wrong:
            raise R.QueryError("BAD_PARAMETER", f"parameters of {name}: {', '.join(wrong)}")
        got = run(opened, **given)
        return {"content": [{"type": "text", "text": got if isinstance(got, str) else json.dumps(got, ensure_ascii=False)}]}
    except Exception as e:  # whatever went wrong is the answer
        return {"content": [{"type": "text", "text": str(e)}], "isError": True}


def answer(opened: Opened, message: dict) -> dict | None:
    """The reply to a JSON-RPC message; none to a notification."""
    method, number = message.get("method"), message.get("id")
    if number is None:
        return None
    if method == "initialize":
        result = {"protocolVersion": (message.get("params") or {}).get("protocolVersion", "2024-11-05"), "serverInfo": {"name": "specloom", "version": "1.0.0"}, "capabilities": {"tools": {}}}
    elif method == "tools/list":
        result = {"tools": describe()}
    elif method == "tools/call":
        params = message.get("params") or {}
        result = call(opened, params.get("name"), params.get("arguments"))
    elif method == "ping":
        result = {}
    else:
        return {"jsonrpc": "2.0", "id": number, "error": {"code": -32601, "message": f"unknown method {method}"}}
    return {"jsonrpc": "2.0", "id": number, "result": result}


def serve(opened: Opened, lines: TextIO, out: TextIO) -> None:
    """One message a line, until the input ends."""
    for line in lines:
        if not line.strip():
            continue
        try:
            reply = answer(opened, json.loads(line))
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if reply is not None:
            out.write(json.dumps(reply, ensure_ascii=False) + "\n")
            out.flush()


def http(opened: Opened, port: int) -> HTTPServer:
    """A server that answers ``/v1/retrieve/TOOL`` with parameters in the query (GET) or as a JSON body (POST): 200, 400 for one that can't be answered, 404 for an unknown path."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, arguments: dict) -> None:
            path = urlparse(self.path).path.rstrip("/")
            name = path.removeprefix("/v1/retrieve/").replace("-", "_") if path.startswith("/v1/retrieve/") else ""
            got = call(opened, name, arguments) if name in TOOLS else {"isError": True, "content": [{"text": json.dumps({"error": "unknown path"})}]}
            text = got["content"][0]["text"]
            status = 404 if name not in TOOLS else 400 if got.get("isError") else 200
            body = (json.dumps({"error": text}, ensure_ascii=False) if status == 400 else text).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):  # noqa: N802
            self._reply({k: v[0] if len(v) == 1 else v for k, v in parse_qs(urlparse(self.path).query).items()})

        def do_POST(self):  # noqa: N802
            try:
                given = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            except ValueError:
                given = {"": "not JSON"}
            self._reply(given if isinstance(given, dict) else {"": "not an object"})

        def log_message(self, *args):
            pass

    return HTTPServer(("127.0.0.1", port), Handler)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="specloom.tools")
    p.add_argument("--index-path", default=".index")
    p.add_argument("--specs")
    p.add_argument("--http", type=int)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("specloom tools").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    opened = Opened(spark, a.index_path, a.specs)
    if a.http is None:
        serve(opened, sys.stdin, sys.stdout)
    else:
        http(opened, a.http).serve_forever()


if __name__ == "__main__":
    main()
