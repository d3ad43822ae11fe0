"""Reference graph: weighted edges, personalised PageRank, and ranks of definitions.

An edge leads from each file that uses a name to each file that defines it. A name with u uses and d
definitions has u x d edges, so ranks never expand them: rank flows from files to names along uses and from
names to files along definitions, and what a file would send to itself is taken off. Each step costs uses
plus definitions. :func:`edges` expands them for whoever wants to see them.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.schema import AMBIENT, AMBIENT_FILES, DAMPING, MAX_ITER, TOL
from tessera.storage import written

#: Nodes, uses and definitions up to which one task iterates in memory; beyond it each step is a distributed join.
KERNEL_EDGES = 5_000_000


def defined_references(definitions: DataFrame, references: DataFrame) -> DataFrame:
    return references.join(definitions.select("name").distinct(), "name", "left_semi")


def usable_names(own: DataFrame, mentions: Iterable[str] = (), n_files: int | None = None) -> tuple[DataFrame, int]:
    """name and rf (files that reference the name) of the names that ``own``, the references to defined names, hold, without ambient vocabulary, and the number of files that reference any."""
    if n_files is None:
        n_files = max(1, own.select("path").distinct().count())
    rf = own.groupBy("name").agg(F.count("*").alias("rf"))
    if n_files >= AMBIENT_FILES:  # before the join with definitions: these names are also its most skewed keys
        few = F.col("rf") / n_files <= AMBIENT
        rf = rf.where(few | F.col("name").isin(*mentions) if mentions else few)
    return rf, n_files


def usable_references(definitions: DataFrame, references: DataFrame, mentions: Iterable[str] = (), n_files: int | None = None) -> tuple[DataFrame, int]:
    """References to defined names with rf, those to ambient names left out, and the number of files that reference any."""
    own = defined_references(definitions, references)
    rf, n_files = usable_names(own, mentions, n_files)
    return own.join(rf, "name"), n_files


def weighted_uses(definitions: DataFrame, references: DataFrame, mentions: Iterable[str] = ()) -> DataFrame:
    """definitions: distinct (name, path). references: (path, name, count). src, name and the weight of its edge to each definer."""
    used, n = usable_references(definitions, references, mentions)
    definers = definitions.groupBy("name").agg(F.count_distinct("path").alias("definers"))
    weight = X.ident_multiplier(F.col("name"), tuple(mentions)) * F.log(1 + n / (1 + F.col("rf"))) * F.sqrt("count") / F.col("definers")
    return used.join(definers, "name").select(F.col("path").alias("src"), "name", "definers", weight.alias("weight"))


def edges(definitions: DataFrame, references: DataFrame, mentions: Iterable[str] = ()) -> DataFrame:
    """src, dst, ident, weight: every edge of its own."""
    uses = weighted_uses(definitions, references, mentions)
    pairs = uses.join(definitions.select("name", F.col("path").alias("dst")), "name").where("src <> dst")
    return pairs.select("src", "dst", F.col("name").alias("ident"), "weight")


def shares(definitions: DataFrame, uses: DataFrame) -> DataFrame:
    """src, name, share (of src's rank that goes to each definer of the name), own (whether src is one of them)."""
    mine = definitions.select("name", F.col("path").alias("src"), F.lit(True).alias("own"))
    both = uses.join(mine, ["name", "src"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    reach = F.col("weight") * (F.col("definers") - F.col("own").cast("int"))
    out = both.groupBy("src").agg(F.sum(reach).alias("out")).where("out > 0")
    return both.join(out, "src").select("src", "name", (F.col("weight") / F.col("out")).alias("share"), "own")


def graph_nodes(definitions: DataFrame, references: DataFrame) -> DataFrame:
    used = defined_references(definitions, references)
    return used.select(F.col("path").alias("node")).unionByName(definitions.select(F.col("path").alias("node"))).distinct()


def _start(nodes: DataFrame, focus: Iterable[str]) -> DataFrame:
    focus = list(focus)
    if focus:
        inside = nodes.where(F.col("node").isin(*focus)).count()
        if inside:
            return nodes.select("node", F.when(F.col("node").isin(*focus), 1.0 / inside).otherwise(0.0).alias("p"))
    return nodes.select("node", F.lit(1.0 / max(1, nodes.count())).alias("p"))


def pagerank(nodes: DataFrame, definitions: DataFrame, flow: DataFrame, focus: Iterable[str] = (), max_iter: int = MAX_ITER, tol: float = TOL, kernel: bool | None = None) -> DataFrame:
    """nodes: (node). flow: :func:`shares`, as a written table since each step reads it. (node, rank); rank sums to 1."""
    start = _start(written(nodes, "pr-nodes"), focus)
    definitions = written(definitions.select("name", "path").join(flow.select("name").distinct(), "name", "left_semi"), "pr-definitions")
    if kernel is None:
        kernel = start.count() + flow.count() + definitions.count() <= KERNEL_EDGES
    return (_in_one_task if kernel else _distributed)(start, definitions, flow, max_iter, tol)


def _in_one_task(start: DataFrame, definitions: DataFrame, flow: DataFrame, max_iter: int, tol: float) -> DataFrame:
    def run(frames):
        rows = pd.concat(list(frames), ignore_index=True)
        node, use, made = (rows[rows["kind"] == k] for k in "nud")
        if node.empty:
            return
        index, names = pd.Index(node["file"]), pd.Index(made["name"].unique())
        p, n, m = node["x"].to_numpy(), len(node), max(1, len(names))
        src, name, share = index.get_indexer(use["file"]), names.get_indexer(use["name"]), use["x"].to_numpy()
        own = use["own"].to_numpy().astype(bool)
        dst, via = index.get_indexer(made["file"]), names.get_indexer(made["name"])
        ends = np.bincount(src, minlength=n) == 0
        rank = p.copy()
        for _ in range(max_iter):
            sent = rank[src] * share
            got = np.bincount(dst, weights=np.bincount(name, weights=sent, minlength=m)[via], minlength=n)
            got -= np.bincount(src[own], weights=sent[own], minlength=n)
            new = (1 - DAMPING) * p + DAMPING * (got + rank[ends].sum() * p)
            delta, rank = np.abs(new - rank).sum(), new
            if delta < tol * n:
                break
        yield pd.DataFrame({"node": node["file"].to_numpy(), "rank": rank})

    none, no = F.lit(None).cast("string"), F.lit(False)
    rows = start.select(F.lit("n").alias("kind"), F.col("node").alias("file"), none.alias("name"), F.col("p").alias("x"), no.alias("own"))
    rows = rows.unionByName(flow.select(F.lit("u").alias("kind"), F.col("src").alias("file"), "name", F.col("share").alias("x"), "own"))
    rows = rows.unionByName(definitions.select(F.lit("d").alias("kind"), F.col("path").alias("file"), "name", F.lit(0.0).alias("x"), no.alias("own")))
    return rows.coalesce(1).mapInPandas(run, "node string, rank double")


def received(ranks: DataFrame, definitions: DataFrame, flow: DataFrame) -> DataFrame:
    """path, name, score, others: what each definition gets from the files that use it, and how many others those are."""
    sent = flow.join(ranks.select(F.col("node").alias("src"), "rank"), "src").select("src", "name", (F.col("rank") * F.col("share")).alias("sent"), "own")
    by_name = sent.groupBy("name").agg(F.sum("sent").alias("all"), F.count("*").alias("uses"))
    own = sent.where("own").select(F.col("src").alias("path"), "name", F.col("sent").alias("back"))
    got = definitions.join(by_name, "name").join(own, ["path", "name"], "left")
    others = F.col("uses") - F.col("back").isNotNull().cast("int")
    return got.select("path", "name", (F.col("all") - F.coalesce("back", F.lit(0.0))).alias("score"), others.alias("others")).where("others > 0")


def _distributed(start: DataFrame, definitions: DataFrame, flow: DataFrame, max_iter: int, tol: float) -> DataFrame:
    n, ends = start.count(), flow.select(F.col("src").alias("node"), F.lit(False).alias("ends")).distinct()
    rank = written(start.join(ends, "node", "left").select("node", "p", F.coalesce("ends", F.lit(True)).alias("ends"), F.col("p").alias("rank")), "pr-ranks")
    for _ in range(max_iter):
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("ends"), F.col("rank"))), F.lit(0.0))).first()[0]
        got = received(rank, definitions, flow).groupBy(F.col("path").alias("dst")).agg(F.sum("score").alias("got"))
        new = (1 - DAMPING) * F.col("p") + DAMPING * (F.coalesce("got", F.lit(0.0)) + lost * F.col("p"))
        step = rank.join(got, F.col("node") == F.col("dst"), "left").select("node", "p", "ends", F.col("rank").alias("old"), new.alias("rank"))
        rank = written(step, "pr-ranks")
        if rank.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < tol * n:
            break
        rank = rank.drop("old")
    return rank.select("node", "rank")


def definition_ranks(ranks: DataFrame, definitions: DataFrame, flow: DataFrame) -> DataFrame:
    """path, name and score: what each file's rank gives to the definitions that it references."""
    return received(ranks, definitions, flow).where("score > 0").select("path", "name", "score")
