"""Command line: ``python -m tessera.cli --repo PATH COMMAND ...``"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from tessera import __version__, schema
from tessera.engine import Engine


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--repo", default=".")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: tuple) -> None:
        own = sub.add_parser(name)
        for names, options in args:
            own.add_argument(*names.split(), **options)

    flag, text = {"action": "store_true"}, {}
    command("index", ("--json", flag), ("--no-embed", flag), ("--verify", flag))
    command("map", ("--budget", {"type": int, "default": schema.MAP_BUDGET}), ("--focus", {"action": "append", "default": []}), ("--mention", {"action": "append", "default": []}))
    command("search", ("query", text), ("-k --limit", {"type": int, "default": 10}), ("--mode", {"default": "auto"}), ("--json", flag))
    command("outline", ("file", text), ("--json", flag))
    command("slice", ("file", text), ("name", text))
    command("defs", ("name", text), ("--json", flag))
    command("refs", ("name", text), ("-k --limit", {"type": int, "default": 20}), ("--json", flag))
    command("impact", ("files", {"nargs": "*"}), ("--since", {"type": float, "default": schema.SINCE_HOURS}), ("--budget", {"type": int, "default": schema.IMPACT_BUDGET}), ("--tests", flag))
    command("stats")
    command("report")
    command("doctor", ("--json", flag), ("--fail-on-warn", flag))
    command("mcp")
    return p


def run(engine: Engine, a: argparse.Namespace, out=print) -> int:
    show = lambda x: out(json.dumps(x, ensure_ascii=False, indent=1))
    line = lambda r: f"{r['path']}:{r['line']}  [{r['kind']}] {r['signature']}"
    if a.command == "index":
        result = engine.index(a.verify, not a.no_embed)
        show(result) if a.json else out(" ".join(f"{k}={v}" for k, v in result.items()))
        return 0
    if a.command == "report":
        out(engine.report())
        return 0
    if a.command == "doctor":
        found = engine.doctor()
        show(found) if a.json else out("\n".join(f"{c['status']:5} {c['name']}: {c['n']}" for c in found))
        worst = {c["status"] for c in found}
        return int("fail" in worst or a.fail_on_warn and "warn" in worst)
    engine.index(embed=False) if not engine._meta() else engine.index()
    if a.command == "map":
        out(engine.map(a.budget, a.focus, a.mention))
    elif a.command == "search":
        hits = engine.search(a.query, a.limit, a.mode)
        show([h | {"score": round(h["score"], 3)} for h in hits]) if a.json else out("\n".join(f"{h['score']:.3f} {line(h)}" for h in hits) or "(no results)")
    elif a.command in ("outline", "defs"):
        rows = engine.outline(a.file) if a.command == "outline" else engine.defs(a.name)
        show(rows) if a.json else out("\n".join(map(line, rows)) or "(nothing found)")
        return int(not rows)
    elif a.command == "slice":
        out(engine.slice(a.file, a.name))
    elif a.command == "refs":
        got = engine.refs(a.name, None if a.json else a.limit)
        show(got) if a.json else out("\n".join([*("defined in: " + line(r) for r in got["defined"]), *(f"{r['score']:4}x {r['path']}" for r in got["referenced"])]) or "(not found)")
        return int(not got["defined"] and not got["referenced"])
    elif a.command == "impact":
        out(engine.impact(a.files, a.since, a.budget, a.tests))
    elif a.command == "stats":
        show(engine.stats())
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark, a.repo)
    if a.command == "mcp":
        from tessera.service import serve

        serve(engine, sys.stdin, sys.stdout)
        return 0
    return run(engine, a)


if __name__ == "__main__":
    sys.exit(main())
