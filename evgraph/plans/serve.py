"""The graph's queries as tools of a JSON-RPC server: lines of JSON in, lines out."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import IO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.plans.render import context_lines
from evgraph.plans.workspace import Workspace

#: Rows of a page of an answer; ``offset`` asks for the pages after the first.
MAX_ROWS = 1000
# The protocol's error numbers and the tools' other names.
INVALID_REQUEST, NO_METHOD, BAD_PARAMS, INTERNAL = -32600, -32601, -32602, -32603
ALIASES = {
    "query": "search", "graph_search": "search", "find": "search", "graph_explain": "explain", "graph_path": "path",
    "graph_impact": "impact", "context": "graph_context", "graph": "graph_context",
}


class RpcError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def _rows(df: DataFrame) -> list:
    """All rows, as JSON would have them."""
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns))).toLocalIterator()]


def _page(df: DataFrame, offset: int) -> tuple[DataFrame, int, bool]:
    """MAX_ROWS rows of an ordered table from ``offset`` on, the number of all, and whether there are more after them."""
    total = df.count()
    return df.offset(offset).limit(MAX_ROWS), total, offset + MAX_ROWS < total


def _offset(a: dict) -> int:
    offset = int(a.get("offset") or 0)
    if offset < 0:
        raise RpcError(BAD_PARAMS, "offset must not be negative")
    return offset


class Server:
    def __init__(self, workspace: Workspace):
        self.workspace, self.closed = workspace, False
        text, number, tool = {"type": "string"}, {"type": "number"}, self._tool
        self.tools: dict[str, tuple[dict, Callable[[dict], object]]] = dict([
            tool("search", "Nodes whose name, qualified name, route or file match", {"query": text, "limit": number, "kind": text}, ["query"], self._search),
            tool("explain", "A node with its incoming and outgoing edges, page by page", {"nodeId": text, "offset": number}, ["nodeId"], self._explain),
            tool("path", "The steps of a shortest path between two nodes", {"from": text, "to": text}, ["from", "to"], self._path),
            tool("impact", "What a file, node, kind or lack of consumers touches, page by page", {"target": {}, "offset": number}, ["target"], self._impact),
            tool("graph_context", "The graph as lines of text, page by page", {"offset": number}, [], self._context),
        ])

    @staticmethod
    def _tool(name: str, about: str, properties: dict, required: list[str], run: Callable[[dict], object]):
        definition = {"name": name, "description": about, "inputSchema": {"type": "object", "properties": properties, "required": required}}
        return name, (definition, run)

    def _search(self, a: dict) -> object:
        return _rows(self.workspace.search(a.get("query") or a.get("q") or "", int(a.get("limit") or 25), a.get("kind")))

    def _explain(self, a: dict) -> object:
        found = self.workspace.explain(a.get("nodeId") or a.get("id") or a.get("node") or "")
        if not found:
            return found
        edges, total, more = _page(found["edges"], _offset(a))
        return {"node": found["node"].asDict(True), "edges": _rows(edges), "revision": found["revision"], "total": total, "more": more}

    def _path(self, a: dict) -> object:
        start, end = a.get("from") or a.get("fromId"), a.get("to") or a.get("toId")
        hops = _rows(self.workspace.shortest_path(start, end).orderBy("hop"))
        same = start == end and bool(self.workspace.nodes.where(F.col("id") == start).limit(1).count())
        return {"found": bool(hops) or same, "hops": hops}

    def _impact(self, a: dict) -> object:
        nodes, edges, reason = self.workspace.impact(a.get("target") or {})
        parts = {"nodes": _page(nodes.orderBy("id"), _offset(a)), "edges": _page(edges.orderBy("id"), _offset(a))}
        out = {name: _rows(page) for name, (page, _, _) in parts.items()}
        total = {name: n for name, (_, n, _) in parts.items()}
        return out | {"reason": reason, "total": total, "more": any(more for _, _, more in parts.values())}

    def _context(self, a: dict) -> object:
        offset = _offset(a)
        lines = context_lines(self.workspace.nodes, self.workspace.edges).orderBy("section", "id", "line")
        page, total, more = _page(lines, offset)
        found = [r["line"] for r in page.collect()]
        if more:
            found.append(f"(lines {offset + 1} to {offset + len(found)} of {total}; more with offset {offset + len(found)})")
        return "\n".join(found)

    def call(self, name: str, arguments: dict | None = None) -> object:
        if self.closed:
            raise RpcError(INTERNAL, "the server is closed")
        tool = self.tools.get(ALIASES.get(name, name))
        if tool is None:
            raise RpcError(BAD_PARAMS, f"unknown tool: {name}")
        return tool[1](arguments or {})

    def _content(self, name: str, arguments: dict | None) -> dict:
        out = self.call(name, arguments)
        return {"content": [{"type": "text", "text": out if isinstance(out, str) else json.dumps(out, indent=2)}], "isError": False}

    def handle(self, message: object) -> dict | None:
        """The answer to a message; None for notifications, which have no id."""
        if not isinstance(message, dict):
            return {"jsonrpc": "2.0", "id": None, "error": {"code": INVALID_REQUEST, "message": "a message must be an object"}}
        number, method = message.get("id"), message.get("method")
        if number is None:
            return None
        try:
            result = self._dispatch(method, message.get("params") or {})
        except Exception as e:  # whatever a query raises becomes the answer's error
            code = getattr(e, "code", INTERNAL)
            text = str(e) if isinstance(e, RpcError) else f"Internal error: {e}"
            return {"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": text}}
        return {"jsonrpc": "2.0", "id": number, "result": result}

    def _dispatch(self, method: object, params: dict) -> object:
        if not isinstance(method, str) or not method:
            raise RpcError(INVALID_REQUEST, "a message needs a method")
        if method == "initialize":
            return {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "evgraph", "version": "0.1.0"}}
        if method == "ping":
            return {}
        if method == "tools/list":
            return {"tools": [definition for definition, _ in self.tools.values()]}
        if method == "tools/call":
            arguments = params.get("arguments") or params.get("params") or params.get("input")
            return self._content(params.get("name") or params.get("tool") or "", arguments)
        if ALIASES.get(method, method) in self.tools:
            return self._content(method, params)
        raise RpcError(NO_METHOD, f"Method not found: {method}")

    def serve(self, lines: IO[str], out: IO[str]) -> None:
        """Answer each line that holds JSON, one line each; blank and broken lines are left out."""
        for line in lines:
            try:
                message = json.loads(line)
            except ValueError:
                continue
            answer = self.handle(message)
            if answer is not None:
                out.write(json.dumps(answer) + "\n")
                out.flush()

    def close(self) -> None:
        self.closed = True
