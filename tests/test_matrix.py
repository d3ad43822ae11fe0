"""Graphs of one row a name against expanded edges."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import graph, matrix


@pytest.fixture(scope="module")
def tables(spark):
    """Files that define what they use, ambient names, names without uses, without definitions and null, repeated rows."""
    rng = random.Random(5)
    defined = [(f"name{rng.randrange(40)}", f"f{rng.randrange(30)}") for _ in range(120)] + [("unused_name", "g"), ("alone", "h"), (None, "i")]
    used = [(f"f{rng.randrange(60)}", f"name{rng.randrange(44)}", rng.randrange(1, 9)) for _ in range(300)] + [(f"f{i}", "name3", 2) for i in range(40)] + [("h", "alone", 1), ("f1", None, 1)]
    return spark.createDataFrame(defined, "name string, path string"), spark.createDataFrame(used, "path string, name string, count long")


@pytest.fixture(scope="module")
def plain(spark, tables):
    definitions, references = tables
    return definitions.distinct().cache(), references.groupBy("path", "name").sum("count").withColumnRenamed("sum(count)", "count").cache()


def test_packed_numbers():
    rows = [np.array(x, np.int32) for x in ([5], [0, 1, 65_536], [7, 80_000, 80_001], [100_000, 100_001], list(range(0, 400_000, 100)))]
    wide, data = zip(*map(matrix._packed, rows))
    assert wide == (False, False, True, False, False)
    row, number = matrix._unpacked(np.array(wide), pa.array(data, pa.binary()))
    assert [sorted(number[row == i]) for i in range(len(rows))] == [list(x) for x in rows]


@pytest.mark.parametrize("packed, pairs", [(4_096, 1_000_000), (2, 3)])
def test_edges_between_files(spark, tables, plain, monkeypatch, packed, pairs):
    """Sums as over the expanded edges, of which only uses with packed definers are exchanged."""
    monkeypatch.setattr(matrix, "PACKED", packed)
    monkeypatch.setattr(matrix, "PAIRS", pairs)
    want = {}
    for e in graph.edges(*plain).collect():
        w, n = want.get((e.src, e.dst), (0.0, 0))
        want[e.src, e.dst] = w + e.weight, n + 1
    got = matrix.file_edges(matrix.matrix(matrix.by_name(*tables)))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    rows = got.collect()
    assert len(rows) == len(want) and {(r.src, r.dst): r.w for r in rows} == pytest.approx({k: w for k, (w, _) in want.items()})
    assert {(r.src, r.dst): r.idents for r in rows} == {k: n for k, (_, n) in want.items()}


def test_queries_beyond_the_files_held(spark, monkeypatch, tables):
    monkeypatch.setattr(matrix, "FILES_HELD", 3)
    names = matrix.by_name(*tables)
    assert matrix.matrix(names) is None
    from tessera import catalogue

    sf = "/root/testdata/sf0.001"
    big = {(r.src, r.dst): (r.w, r.idents) for r in catalogue.graph_edges(spark, sf).collect()}
    monkeypatch.undo()
    assert big == {(r.src, r.dst): (pytest.approx(r.w, abs=2e-6), r.idents) for r in catalogue.graph_edges(spark, sf).collect()}


def test_ranks_without_a_join_a_step(spark, tables, plain):
    """As over uses and definitions in one task, with ranks of definitions; steps read numbers and exchange sums only."""
    definitions, references = plain
    flow = graph.shares(definitions, graph.weighted_uses(definitions, references))
    nodes = graph.graph_nodes(definitions, references)
    for focus in ((), ("f1", "f2", "nowhere")):
        want = graph.pagerank(nodes, definitions, flow, focus, max_iter=7, tol=0.0)
        m = matrix.matrix(matrix.by_name(*tables))
        rank, out = matrix.ranks(m, focus, max_iter=7, tol=0.0)
        assert {r.node: r["rank"] for r in matrix.file_ranks(m, rank).collect()} == pytest.approx({r.node: r["rank"] for r in want.collect()})
        score = {(r.path, r.name): r.score for r in graph.definition_ranks(want, definitions, flow).collect()}
        assert {(r.path, r.name): r.score for r in matrix.definition_ranks(m, rank, out).collect()} == pytest.approx(score)
