"""An index of a small tree, end to end."""

import io
import json
import os

import pytest

from tessera import cli
from tessera.engine import Engine
from tessera.service import Service, serve

CORE = "class Engine:\n    def start_engine(self):\n        return prepare_fuel()\n\ndef prepare_fuel():\n    return 42\n"
APP = "from pkg.core import Engine, prepare_fuel\n\ndef run_application():\n    e = Engine()\n    e.start_engine()\n    prepare_fuel()\n    prepare_fuel()\n"
MAIN = "from pkg.app import run_application\nrun_application()\n"


def put(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/").replace("_py", ".py")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    put(root, pkg__core_py=CORE, pkg__app_py=APP, main_py=MAIN)
    engine = Engine(spark, str(root))
    first = engine.index()
    return root, engine, first


def test_index(tree):
    root, engine, first = tree
    assert (first["added"], first["updated"], first["removed"]) == (3, 0, 0)
    symbols = {(r.path, r.name, r.kind, r.line, r.end_line, r.signature) for r in engine.table("symbols").collect()}
    assert symbols == {
        ("pkg/core.py", "Engine", "class", 1, 3, "class Engine:"),
        ("pkg/core.py", "start_engine", "function", 2, 3, "def start_engine(self):"),
        ("pkg/core.py", "prepare_fuel", "function", 5, 6, "def prepare_fuel():"),
        ("pkg/app.py", "run_application", "function", 3, 7, "def run_application():"),
    }
    idents = {(r.path, r.name): r["count"] for r in engine.table("idents").collect()}
    assert idents == {("pkg/app.py", "Engine"): 2, ("pkg/app.py", "start_engine"): 1, ("pkg/app.py", "prepare_fuel"): 3, ("pkg/core.py", "prepare_fuel"): 1, ("main.py", "run_application"): 2}
    assert engine.index()["unchanged"] == 3


def test_questions(tree):
    root, engine, _ = tree
    shown = engine.map()
    assert shown.index("pkg/core.py:") < shown.index("pkg/app.py:")
    assert engine.map() == shown  # now from the kept ranks
    assert "pkg/core.py:" not in engine.map(focus=["pkg/core.py"])
    hits = engine.search("prepare fuel", mode="bm25")
    assert hits[0]["name"] == "prepare_fuel" and hits[0]["score"] == pytest.approx(3.342259, abs=1e-6)
    hits = engine.search("engine", mode="bm25")
    assert [(h["name"], round(h["score"], 6)) for h in hits] == [("Engine", 2.479551), ("start_engine", 0.962097)]
    assert engine.search("application", mode="bm25")[0]["score"] == pytest.approx(1.671129, abs=1e-6)
    assert engine.search("prepare fuel")[0]["name"] == "prepare_fuel"
    with pytest.raises(ValueError):
        engine.search("x", mode="other")
    assert [r["path"] for r in engine.refs("prepare_fuel")["referenced"]] == ["pkg/app.py"]
    assert [r["path"] for r in engine.refs("Engine.start_engine")["referenced"]] == ["pkg/app.py"]
    assert engine.refs("...")["referenced"] == [] and engine.refs("")["defined"] == []
    assert [r["name"] for r in engine.outline("pkg/core.py")] == ["Engine", "start_engine", "prepare_fuel"]
    shown = engine.slice("pkg/core.py", "prepare_fuel")
    assert "    6:     return 42" in shown and "[class] class Engine: ..." in shown and "return prepare_fuel()" not in shown
    assert engine.slice("no.py", "x").startswith("(no symbols") and engine.slice("main.py", "x").startswith("(no symbol")
    assert "pkg/app.py — uses" in engine.impact(["pkg/core.py"]) and "main.py" not in engine.impact(["pkg/core.py"])
    assert "none (nothing references" in engine.impact(["main.py"])
    assert "truncated" in engine.impact(["pkg/core.py"], budget=10)
    assert engine.stats()["symbols"] == 4


def test_graph_goldens(spark, tree):
    from tessera.operators import graph

    _, engine, _ = tree
    definitions, references = engine.table("symbols").select("name", "path").distinct(), engine.table("idents")
    e = graph.edges(definitions, references)
    assert {(r.src, r.dst, r.ident): round(r.weight, 6) for r in e.collect()} == {
        ("pkg/app.py", "pkg/core.py", "Engine"): 1.295831, ("pkg/app.py", "pkg/core.py", "prepare_fuel"): 2.401132,
        ("pkg/app.py", "pkg/core.py", "start_engine"): 1.832581, ("main.py", "pkg/app.py", "run_application"): 2.591662,
    }
    nodes = graph.graph_nodes(definitions, references)
    flow = graph.shares(definitions, graph.weighted_uses(definitions, references))
    for kernel in (True, False):
        ranks = {r.node: r["rank"] for r in graph.pagerank(nodes, definitions, flow, kernel=kernel).collect()}
        assert sum(ranks.values()) == pytest.approx(1)
        assert {k: round(v, 6) for k, v in ranks.items()} == {"pkg/core.py": 0.474412, "pkg/app.py": 0.341171, "main.py": 0.184417}


def test_ranks_flow_as_over_the_edges(spark):
    """Factored ranks against those over expanded edges, in plain Python."""
    import random

    from tessera.operators import graph
    from tessera.schema import DAMPING

    rng = random.Random(3)
    defined = {(f"name{rng.randrange(12)}", f"f{rng.randrange(9)}") for _ in range(30)}
    used = {(f"f{rng.randrange(12)}", f"name{rng.randrange(14)}"): rng.randrange(1, 9) for _ in range(60)}
    definitions = spark.createDataFrame(sorted(defined), "name string, path string")
    references = spark.createDataFrame([(p, n, c) for (p, n), c in sorted(used.items())], "path string, name string, count long")
    edges = graph.edges(definitions, references).collect()
    out = {}
    for e in edges:
        out[e.src] = out.get(e.src, 0.0) + e.weight
    nodes = sorted(r.node for r in graph.graph_nodes(definitions, references).collect())
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(7):
        new = dict.fromkeys(nodes, 0.0)
        for e in edges:
            new[e.dst] += rank[e.src] * e.weight / out[e.src]
        lost = sum(rank[n] for n in nodes if n not in out)
        rank = {n: (1 - DAMPING) / len(nodes) + DAMPING * (new[n] + lost / len(nodes)) for n in nodes}
    score = {}
    for e in edges:
        score[e.dst, e.ident] = score.get((e.dst, e.ident), 0.0) + rank[e.src] * e.weight / out[e.src]
    flow = graph.shares(definitions, graph.weighted_uses(definitions, references))
    for kernel in (True, False):
        ranks = graph.pagerank(graph.graph_nodes(definitions, references), definitions, flow, max_iter=7, tol=0.0, kernel=kernel)
        assert {r.node: r["rank"] for r in ranks.collect()} == pytest.approx(rank)
        assert {(r.path, r.name): r.score for r in graph.definition_ranks(ranks, definitions, flow).collect()} == pytest.approx(score)


def test_changes(spark, tmp_path):
    put(tmp_path, pkg__core_py=CORE, pkg__app_py=APP, main_py=MAIN)
    engine = Engine(spark, str(tmp_path))
    engine.index()
    put(tmp_path, pkg__core_py="def other_function():\n    pass\n")
    (tmp_path / "main.py").unlink()
    got = engine.index()
    assert (got["added"], got["updated"], got["removed"], got["unchanged"]) == (0, 1, 1, 1)
    assert {r.name for r in engine.table("symbols").collect()} == {"other_function", "run_application"}
    # same size and time: only verify sees it
    path = tmp_path / "pkg" / "core.py"
    was = path.stat()
    path.write_text("def third_function():\n    pass\n".ljust(was.st_size)[: was.st_size])
    os.utime(path, ns=(was.st_atime_ns, was.st_mtime_ns))
    assert engine.index()["updated"] == 0
    assert engine.index(verify=True)["updated"] == 1
    # user patterns
    put(tmp_path, pkg__di_py='WIRE = "Bind<FuelPump>()"\n')
    (tmp_path / ".tessera" / "wiring.json").write_text(json.dumps({"patterns": [{"regex": r"Bind<(\w+)>"}]}))
    engine.index()
    assert [r["path"] for r in engine.refs("FuelPump")["referenced"]] == ["pkg/di.py"]
    assert {c["name"]: c["status"] for c in engine.doctor()}["stale"] == "ok"
    put(tmp_path, new_py="x = 1\n")
    assert {c["name"]: c["status"] for c in engine.doctor()}["stale"] == "warn"


def test_ignored(spark, tmp_path):
    put(tmp_path, a_py="def first_one():\n    pass\n", vendor__b_py="x", node_modules__c_py="x", docs__d_py="def second_one():\n    pass\n")
    (tmp_path / ".tesseraignore").write_text("# comment\n\ndocs/\n")
    (tmp_path / "big.py").write_text("x" * 1_000_001)
    (tmp_path / "empty.py").write_text("")
    engine = Engine(spark, str(tmp_path))
    engine.index()
    assert [r.path for r in engine.table("files").collect()] == ["a.py"]


def test_service(tree, monkeypatch, tmp_path):
    _, engine, _ = tree
    monkeypatch.setenv("TESSERA_QUERYLOG", "1")
    engine.log_path = str(tmp_path / "log.jsonl")
    service = Service(engine)
    call = lambda tool, **args: service.handle({"id": 1, "method": "tools/call", "params": {"name": tool, "arguments": args}})
    assert len(service.handle({"id": 1, "method": "tools/list"})["result"]["tools"]) == 7
    assert service.handle({"method": "notify"}) is None
    assert service.handle({"id": 1, "method": "x"})["error"]["code"] == -32601
    assert call("search")["result"]["isError"] and "query" in call("search")["result"]["content"][0]["text"]
    assert call("nothing")["error"]["code"] == -32602
    assert "x pkg/app.py" in call("refs", name="prepare_fuel")["result"]["content"][0]["text"]
    assert all(t["description"] for t in service.handle({"id": 1, "method": "tools/list"})["result"]["tools"])
    assert service.handle({"id": 1, "method": "initialize", "params": {"protocolVersion": "2025-03-26"}})["result"]["protocolVersion"] == "2025-03-26"
    assert call("refs", name="absent_name")["result"]["content"][0]["text"].startswith("(no definition")
    assert "start_engine" in call("outline", file="pkg/core.py")["result"]["content"][0]["text"]
    assert call("search", query="zzz", mode="bm25")["result"]["content"][0]["text"] == "(no results)"
    assert call("search", query="zzz", mode="bad")["result"]["isError"]
    assert "(1)" in engine.report() and "Searched most" in engine.report()
    out = io.StringIO()
    serve(engine, io.StringIO('{"id": 1, "method": "ping"}\n\nbroken\n'), out)
    assert [json.loads(x).get("error", {}).get("code") for x in out.getvalue().splitlines()] == [None, -32700]


def test_cli(tree):
    root, engine, _ = tree
    said = []
    run = lambda *a: cli.run(engine, cli.parser().parse_args(a), said.append)
    assert run("index", "--json") == 0 and json.loads(said[-1])["unchanged"] == 3
    assert run("defs", "prepare_fuel") == 0 and run("defs", "nothing") == 1
    assert run("refs", "prepare_fuel", "--json") == 0 and json.loads(said[-1])["referenced"][0]["score"] == 3
    assert run("map", "--budget", "48") == 0 and len(said[-1]) // 4 <= 64
    assert run("doctor") == 0


def test_vectors_that_lack_are_made_later_and_one_old_version_stays(spark, tmp_path):
    put(tmp_path, a_py="def first_one():\n    pass\n")
    engine = Engine(spark, str(tmp_path))
    engine.index(embed=False)
    assert engine.table("vectors").count() == 0
    held = engine.table("symbols")
    engine.index()
    assert engine.table("vectors").count() == 1 and held.count() == 1
    put(tmp_path, b_py="def second_one():\n    pass\n")
    engine.index(embed=False)
    assert {c["name"]: c["n"] for c in engine.doctor()}["embeddings"] == 1
    engine.index()
    assert engine.table("vectors").count() == 2 and len(list(engine.store.glob("v[0-9]*"))) == 2
