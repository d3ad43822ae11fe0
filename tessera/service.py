"""The questions as tools over JSON-RPC, one message a line."""

from __future__ import annotations

import json
import time

from tessera import __version__, schema
from tessera.engine import Engine

MOST, FRESH_S = 40_000, 10.0
_S, _N, _L = {"type": "string"}, {"type": "number"}, {"type": "array", "items": {"type": "string"}}


def _lines(rows: list[dict]) -> str:
    return "\n".join(f"{r['path']}:{r['line']}  [{r['kind']}] {r['signature']}" for r in rows)


#: name: (parameters, required ones, what answers). Absent, zero and empty values stand for the defaults.
TOOLS = {
    "map": ({"budget": _N, "focus": _L, "mentions": _L}, [], lambda e, a: e.map(int(a.get("budget") or schema.MAP_BUDGET), a.get("focus") or (), a.get("mentions") or ())),
    "search": ({"query": _S, "limit": _N, "mode": _S}, ["query"], lambda e, a: _lines(e.search(a["query"], int(a.get("limit") or 10), a.get("mode") or "auto")) or "(no results)"),
    "outline": ({"file": _S}, ["file"], lambda e, a: _lines(e.outline(a["file"])) or "(no symbols)"),
    "defs": ({"name": _S}, ["name"], lambda e, a: _lines(e.defs(a["name"])) or "(not found)"),
    "slice": ({"file": _S, "name": _S}, ["file", "name"], lambda e, a: e.slice(a["file"], a["name"])),
    "impact": ({"files": _L, "since_hours": _N, "budget": _N, "tests": {"type": "boolean"}}, [], lambda e, a: e.impact(a.get("files") or (), float(a.get("since_hours") or schema.SINCE_HOURS), int(a.get("budget") or schema.IMPACT_BUDGET), bool(a.get("tests")))),
    "refs": ({"name": _S, "limit": _N}, ["name"], lambda e, a: refs_text(a["name"], e.refs(a["name"], int(a.get("limit") or 20)))),
}
#: What each tool is for.
ABOUT = {
    "map": "The best definitions of the tree within a budget of tokens, ranked by who references them.",
    "search": "Symbols by words, by meaning or by both.",
    "outline": "The symbols of a file, with their lines.",
    "defs": "Where a name is defined.",
    "slice": "The lines of one symbol, and the signatures around it.",
    "impact": "What uses the symbols of changed files.",
    "refs": "Where a name is defined and which other files reference it.",
}


def refs_text(name: str, found: dict) -> str:
    if not found["defined"] and not found["referenced"]:
        return f"(no definition of or reference to `{name}`)"
    own = [f"defined in: {r['path']}:{r['line']}" for r in found["defined"]] or [f"(no definition of `{name}`)"]
    return "\n".join([*own, *(f"{r['score']:4}x {r['path']}" for r in found["referenced"]), f"confidence: {found['confidence']}"])


class Service:
    def __init__(self, engine: Engine):
        self.engine, self.fresh_until = engine, 0.0

    def handle(self, message: dict) -> dict | None:
        """The answer to a message, None to a notification."""
        method, key = message.get("method"), message.get("id")
        if key is None:
            return None
        answer = lambda **x: {"jsonrpc": "2.0", "id": key, **x}
        if method == "initialize":
            asked = (message.get("params") or {}).get("protocolVersion")
            return answer(result={"protocolVersion": asked if isinstance(asked, str) else "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "tessera", "version": __version__}})
        if method == "ping":
            return answer(result={})
        if method == "tools/list":
            return answer(result={"tools": [{"name": n, "description": ABOUT[n], "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (p, r, _) in TOOLS.items()]})
        if method != "tools/call":
            return answer(error={"code": -32601, "message": f"unknown method: {method}"})
        params = message.get("params") or {}
        name, args = params.get("name"), params.get("arguments") or {}
        if name not in TOOLS:
            self.engine.log.record(str(name), args, "(unknown tool)")
            return answer(error={"code": -32602, "message": f"unknown tool: {name}"})
        try:
            if lacking := [r for r in TOOLS[name][1] if r not in args]:
                raise ValueError(f"missing argument: {', '.join(lacking)}")
            if time.monotonic() >= self.fresh_until:
                self.engine.index()
                self.fresh_until = time.monotonic() + FRESH_S
            text, bad = TOOLS[name][2](self.engine, args), False
        except Exception as e:  # a tool's failure is its answer
            text, bad = f"{type(e).__name__}: {e}", True
        self.engine.log.record(name, args, text)
        text = text if len(text) <= MOST else text[:MOST] + "\n… (truncated)"
        return answer(result={"content": [{"type": "text", "text": text}], "isError": bad})


def serve(engine: Engine, source, sink) -> None:
    service = Service(engine)
    for line in source:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
            out = service.handle(message) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "no object"}}
        except json.JSONDecodeError:
            out = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
        if out is not None:
            sink.write(json.dumps(out, ensure_ascii=False) + "\n")
            sink.flush()
