"""Exact top-k search by inner product with KD-trees per shard.

Each task cuts its candidates into shards of at most ``SHARD`` points and builds a tree over each: median
splits on the widest side down to ``LEAF`` points, with a tight bounding box at every node. The most that a
point of a box can score against a query is a sum over sides of the better corner. A query walks a tree
best-first: a heap holds the nodes it has reached by their bounds, the best is opened, a leaf's points are
scored, and the walk ends when no bound reaches the kth score so far. That kth score goes on from shard to
shard of a task, and every query starts with the one that a bounded sample of the candidates gives it, so
every tree is pruned from its root on.

Queries are a table in the shared folder, with their first kth scores. A task builds its trees once and
streams that table past them, ``TOGETHER`` queries at a time, so neither driver nor task holds all queries,
no pair of rows is ever a row of its own, and a task sends at most k rows of a query on.

Components become floor(256 x); scores are exact integers (single precision where all sums stay below
2^24, double below 2^53, else Python's integers). Defined cases: rows with a null vec_id, a null vector
or null or non-finite components take no part; vectors are compared with those of their own length only;
a candidate with the query's vec_id is the query's own row; rows that share a query's vec_id are all asked,
and their scores ranked together (equal rows give equal scores again, as a join would); ties go to the
smaller vec_id; columns other than vec_id and embedding are not read; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.batches import schema_of
from tessera.storage import scratch, table

K, EVERY = 5, 50
#: Candidates in the sample that gives the first kth scores, points in a shard, shards that a task holds, points in a leaf, queries handled at a time.
SAMPLE, SHARD, HELD, LEAF, TOGETHER = 2_048, 65_536, 8, 256, 1_024


def quantised(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, integer components as doubles) of the usable rows, by length."""
    if isinstance(ids, pa.ChunkedArray):
        ids, vectors = ids.combine_chunks(), vectors.combine_chunks()
    flat = vectors.flatten()
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = flat.cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    fine = ids.is_valid().to_numpy(zero_copy_only=False) & vectors.is_valid().to_numpy(zero_copy_only=False)
    keys, out = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), {}
    for n in np.unique(lengths[fine]).tolist() if len(keys) else []:
        own = np.flatnonzero(fine & (lengths == n))
        x = values[(starts[own][:, None] + np.arange(n)).ravel()].reshape(len(own), n)
        good = np.isfinite(x).all(axis=1)
        out[n] = (keys[own][good], np.floor(256 * x[good]))
    return {n: v for n, v in out.items() if len(v[0])}


def exact_kind(a: np.ndarray, b: np.ndarray) -> type:
    """The narrowest type in which the inner products of whole numbers are exact."""
    most = float(np.abs(a).max(initial=1)) * float(np.abs(b).max(initial=1)) * max(1, a.shape[1])
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def to_kind(a: np.ndarray, kind: type) -> np.ndarray:
    if kind is not object:
        return a.astype(kind)
    out = np.empty(a.shape, object)
    out.ravel()[:] = [int(x) for x in a.ravel()]
    return out


class Tree:
    """Nodes by number, the root first: boxes, the two children (of leaves -1) and the points that lie below."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.arange(len(ids))
        low, high, below, left, todo = [], [], [], [], [(0, len(ids))]
        for node, (a, b) in enumerate(todo):  # grows as it goes
            own = order[a:b]
            x = points[own]
            low.append(x.min(axis=0))
            high.append(x.max(axis=0))
            below.append((a, b))
            if b - a <= LEAF:
                left.append(-1)
                continue
            side = int(np.argmax(high[node] - low[node])) if x.shape[1] else 0
            half = (b - a) // 2
            if x.shape[1]:
                order[a:b] = own[np.argpartition(x[:, side], half)]
            left.append(len(todo))
            todo += [(a, a + half), (a + half, b)]
        self.low, self.high, self.below, self.left = np.stack(low), np.stack(high), below, left
        self.ids, self.points = ids[order], points[order]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, vec_id, score) of all that may be among a query's best k. kth: the scores below which nothing counts; raised."""
        kind = exact_kind(queries, np.stack([self.low[0], self.high[0]]))
        queries, none = to_kind(queries, kind), -(1 << 200) if kind is object else -np.inf
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        floor = np.array([none if x == -np.inf else int(x) for x in kth], object) if kind is object else kth.copy()
        best = np.full((len(queries), k), none, dtype=object if kind is object else np.float64)
        bounds: dict[int, np.ndarray | list] = {}

        def bound(node: int):
            """The most that each query can score below the node."""
            if node not in bounds:
                bounds[node] = (plus @ to_kind(self.high[node], kind) + minus @ to_kind(self.low[node], kind)).tolist()
            return bounds[node]

        heaps = [[(-x, 0)] for x in bound(0)]
        active, out = range(len(queries)), []
        while active:
            at_leaf: dict[int, list[int]] = {}
            for q in active:
                heap, least = heaps[q], floor[q]
                while heap:
                    most, node = heapq.heappop(heap)
                    if -most < least:
                        heap.clear()  # nor does any other reach it
                    elif self.left[node] < 0:
                        at_leaf.setdefault(node, []).append(q)
                        break
                    else:
                        for child in (self.left[node], self.left[node] + 1):
                            if (x := bound(child)[q]) >= least:
                                heapq.heappush(heap, (-x, child))
            for node, who in at_leaf.items():
                who, (a, b) = np.array(who), self.below[node]
                ids = self.ids[a:b]
                scores = queries[who] @ to_kind(self.points[a:b], kind).T
                hit = (scores >= floor[who][:, None]) & (ids[None, :] != query_ids[who][:, None])
                rows, columns = np.nonzero(hit)
                if len(rows):
                    out.append((who[rows], ids[columns], scores[rows, columns]))
                    top = np.sort(np.concatenate([best[who], np.where(hit, scores, none)], axis=1), axis=1)[:, -k:]
                    best[who] = top
                    floor[who] = np.maximum(floor[who], top[:, 0])
            active = [q for who in at_leaf.values() for q in who if heaps[q]]
        if kind is not object:
            kth[:] = floor
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        who, ids, scores = (np.concatenate(x) for x in zip(*out, strict=True))
        return best_k(who, ids, scores, k)


def best_k(who: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores of each, ties to the smaller id."""
    rank = np.lexsort((ids, -scores, who)) if scores.dtype != object else np.array(sorted(range(len(who)), key=lambda i: (who[i], -scores[i], ids[i])), np.int64)
    who, ids, scores = who[rank], ids[rank], scores[rank]
    place = np.arange(len(who)) - np.searchsorted(who, who)
    return who[place < k], ids[place < k], scores[place < k]


def asked_of(rows: DataFrame, k: int, every: int) -> str:
    """Writes the queries with their first kth scores to the shared folder: vec_id, embedding, copies, kth. Equal rows are one with a number of copies."""
    total = rows.count()
    few = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 20)) < max(1, min(1 << 20, (SAMPLE << 20) // max(1, total)))
    # any candidates give valid scores to start from; the limit only matters where rows repeat
    sample = quantised(*rows.where(few).limit(4 * SAMPLE).toArrow().columns) if total else {}
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "embedding").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    schema = schema_of("vec_id long, embedding array<double>, copies int, kth double")

    def start(batches):
        for batch in batches:
            kth = np.full(batch.num_rows, -np.inf)
            at = pa.array(np.arange(batch.num_rows))
            for n, (places, x) in quantised(at, batch["embedding"]).items():
                ids = batch["vec_id"].to_numpy(zero_copy_only=False)[places]
                kth[places] = first_scores(ids, x, sample.get(n), k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kth)], names=schema.names)

    path = scratch(rows.sparkSession, "queries")
    asked.mapInArrow(start, schema).write.parquet(path)
    return path


def queries_at(path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, ids, integer components, copies, kth) of the queries below a path, some at a time."""
    store, place = fs.FileSystem.from_uri(path)
    for file in sorted(f.path for f in store.get_file_info(fs.FileSelector(place)) if f.path.endswith(".parquet")):
        with store.open_input_file(file) as source:
            for batch in pq.ParquetFile(source).iter_batches(TOGETHER):
                ids, copies, kth = (batch[c].to_numpy(zero_copy_only=False) for c in ("vec_id", "copies", "kth"))
                for n, (places, x) in quantised(pa.array(np.arange(batch.num_rows)), batch["embedding"]).items():
                    yield n, ids[places], x, copies[places], kth[places].copy()


def search(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """vectors: (vec_id, embedding). query_id, rank, vec_id and score of each query's best k."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    path = asked_of(rows, k, every)
    found = rows.mapInArrow(lambda batches: _task(batches, path, k), schema_of("query_id long, vec_id long, score long, copies int"))
    found = found.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _task(batches, path: str, k: int):
    held: dict[int, list] = {}
    trees: list[tuple[int, Tree]] = []
    for batch in batches:
        for n, own in quantised(*batch.columns).items():
            held.setdefault(n, []).append(own)
            while sum(len(ids) for ids, _ in held[n]) >= SHARD:
                ids, points = (np.concatenate(x) for x in zip(*held[n], strict=True))
                trees.append((n, Tree(ids[:SHARD], points[:SHARD])))
                held[n] = [(ids[SHARD:], points[SHARD:])]
        if len(trees) >= HELD:
            yield from _past(trees, path, k)
            trees = []
    trees += [(n, Tree(*(np.concatenate(x) for x in zip(*own, strict=True)))) for n, own in held.items() if sum(len(ids) for ids, _ in own)]
    if trees:
        yield from _past(trees, path, k)


def _past(trees: list[tuple[int, Tree]], path: str, k: int) -> Iterator[pa.RecordBatch]:
    """All queries past the trees."""
    for n, asked, x, copies, kth in queries_at(path):
        found = [tree.search(asked, x, kth, k) for m, tree in trees if m == n]  # each raises kth for the next
        if not (found := [f for f in found if len(f[0])]):
            continue
        who, ids, scores = best_k(*(np.concatenate([f[i].astype(object) if i == 2 and any(g[2].dtype == object for g in found) else f[i] for f in found]) for i in range(3)), k)
        columns = [asked[who], ids, np.array([int(s) for s in scores], np.int64), copies[who]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["query_id", "vec_id", "score", "copies"])


def first_scores(ids: np.ndarray, queries: np.ndarray, sample: tuple | None, k: int) -> np.ndarray:
    """Each query's kth score within the sample, minus infinity where it has fewer."""
    out = np.full(len(ids), -np.inf)
    if sample is not None and len(sample[0]) > k:
        if (kind := exact_kind(queries, sample[1])) is object:
            return out  # a bound is no need, and a rounded one would be wrong
        q, p = to_kind(queries, kind), to_kind(sample[1], kind)
        for a in range(0, len(ids), TOGETHER):
            scores = (q[a : a + TOGETHER] @ p.T).astype(np.float64)
            scores[ids[a : a + TOGETHER, None] == sample[0][None, :]] = -np.inf
            out[a : a + TOGETHER] = np.partition(scores, -k, axis=1)[:, -k]
    return out


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
