"""Near-duplicate documents: an n-gram Jaccard join by MinHash banding.

1. A pass over the texts gives each document its set of five-word shingles as 64-bit hashes, a 128-bit key
   of that set, and minimum hashes in bands. Band and row counts follow from the recall wanted at the
   threshold. Only key and bands are kept.
2. Documents with equal sets are copies: they collapse to one node with a count. No later step sees copies.
3. Nodes meet in the buckets of their band hashes. Buckets with equal members are looked at once.
4. The members of a bucket get their whole texts back; all their pairs are verified on the full sets. Pairs
   are counted in arrays inside a task and never become rows. Of a pair that meets in several buckets only
   the smallest counts. A bucket beyond ``TOGETHER`` members (or shingles) is cut into chunks, and each pair
   of chunks is a task of its own, so no task grows with a group.
5. A task returns each member's links and an edge to the smallest member that it hangs together with; classes
   are the connected components of these edges, found by alternating large and small stars.

Result: one row per document: class_id, the smallest doc_id of its class, and n_links, the number of other
documents of similarity ``SIMILAR`` or more (copies count).

Words lie between white space, with ASCII letters lowered. Defined cases: a text of one to four words is
one shingle; a null, empty or blank text has no shingles, no links and is its own class; repeated rows are
copies; rows that share a doc_id but not their text are documents of their own; classes of rows without
doc_id have a null class_id; texts of any length count whole; columns other than doc_id and text are not
read, and :func:`one_of_each` returns them as they are, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.batches import fresh, give_back, map_slices, schema_of, texts
from tessera.llm.textkit import U, mix, shingles
from tessera.storage import table, written

SIMILAR, WORDS, RECALL, MOST_HASHES = 0.8, 5, 0.9999, 128
#: Members, and shingles, of a bucket that a task verifies at once.
TOGETHER, SHINGLES = 2_048, 4_000_000
#: Bytes of text that are sketched at a time: some twenty arrays of eight bytes for each, part of which a worker keeps.
SKETCHED = 1 << 20


def bands_and_rows(similar: float = SIMILAR, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """The most rows, hence the fewest chance meetings, with which bands of them find a pair at the threshold with this chance."""
    out = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(similar**rows))) if similar < 1 else 1
        if bands * rows <= most:
            out = bands, rows
    if out is None:
        raise ValueError("recall is out of reach with so few hashes")
    return out


def set_keys(found: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, the same for equal sets only."""
    out = []
    for salt in (0x1234567, 0x89ABCDE):
        running = np.concatenate([np.zeros(1, U), np.cumsum(mix(found ^ U(salt)), dtype=U)])
        out.append((running[starts[1:]] - running[starts[:-1]]).view(np.int64))
    return out[0], out[1]


def band_hashes(found: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands): a hash of each band's minima. Sets are not empty."""
    factors = mix(np.arange(1, bands * rows + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
    out = np.empty((len(starts) - 1, bands), np.int64)
    for b in range(bands):
        h = np.full(len(starts) - 1, b + 1, U)
        for f in factors[b * rows : (b + 1) * rows]:
            h = mix(h * U(0x2545F4914F6CDD1D) + np.minimum.reduceat((found * f) >> U(24), starts[:-1]))
        out[:, b] = h.view(np.int64)
    return out


def sketch(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, mark (a hash of the text), k1, k2, size and bands of every document; keys and bands are null where there is no shingle."""

    def run(parts) -> Iterator[dict]:
        for part in parts:
            found, starts = shingles([t.encode("utf-8", "surrogatepass") for t in texts(part)], WORDS)
            size = np.diff(starts)
            k1, k2 = set_keys(found, starts)
            full = np.flatnonzero(size)
            own = np.full(len(size), None, object)
            if len(full):
                own[full] = list(band_hashes(found, np.append(starts[full], len(found)), bands, rows))
            none = size == 0
            yield {"doc_id": part["doc_id"], "mark": part["mark"], "k1": pa.array(k1, mask=none), "k2": pa.array(k2, mask=none), "size": size, "bands": own.tolist()}

    own = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark"))
    return map_slices(own, run, "doc_id long, mark long, k1 long, k2 long, size long, bands array<long>", most=SKETCHED)


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """(k1, k2, rep, copies, bucket, chunks) of the nodes of each bucket worth looking at."""
    spread = nodes.select("k1", "k2", "size", F.explode("bands").alias("bucket"))
    members = [F.bit_xor(F.xxhash64("k1", "k2", F.lit(salt))) for salt in (1, 2)]
    seen = spread.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("total"), members[0].alias("m1"), members[1].alias("m2"))
    once = seen.where("n > 1").groupBy("n", "m1", "m2").agg(F.min("bucket").alias("at"), F.max("total").alias("total"))
    chunks = F.greatest(F.ceil(F.col("n") / TOGETHER), F.ceil(F.col("total") / SHINGLES)).cast("int")
    once = once.select("at", F.least(chunks, F.col("n").cast("int")).alias("chunks"))
    return spread.join(once, F.col("bucket") == F.col("at")).select("k1", "k2", "bucket", "chunks")


def pair_counts(of: np.ndarray, item: np.ndarray, n: int) -> np.ndarray:
    """(n, n): how many items each two of n sets share. of, item: the sets' distinct items."""
    out = np.zeros((n, n), np.float32)
    order = np.argsort(item, kind="stable")
    item, of = item[order], of[order]
    first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(item)))
    for c in range(2, min(8, n) + 1):  # items of few sets, pair by pair
        own = first[counts == c]
        for i in range(c):
            for j in range(i + 1, c):
                np.add.at(out, (of[own + i], of[own + j]), 1)
    if n > 8:  # the others as a product of matrices, some columns at a time
        many = np.flatnonzero(counts > 8)
        width = max(1, (8 << 20) // n)
        for a in range(0, len(many), width):
            some = many[a : a + width]
            x = np.zeros((n, len(some)), np.float32)
            for k, g in enumerate(some.tolist()):
                x[of[first[g] : first[g] + counts[g]], k] = 1
            out += np.triu(x @ x.T, 1)
    return out + out.T


def verified(k1, k2, copies, buckets, own_chunk, raw: list[bytes], bucket: int, cross: bool, similar: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one task: (members with links, their weighted links, the member each hangs together with)."""
    found, starts = shingles(raw, WORDS)
    n, size = len(raw), np.diff(starts)
    of = np.repeat(np.arange(n), size)
    both = pair_counts(of, found, n)
    linked = np.zeros((n, n), bool)
    for i in range(n):  # in double precision, row by row: in single precision pairs at the threshold itself fall below it
        linked[i] = both[i].astype(np.float64) * (1 + similar) >= similar * (size[i] + size) - 1e-6
    before = [(i, b) for i, own in enumerate(buckets) for b in own if b < bucket]
    if before:
        i, b = (np.array(x, np.int64) for x in zip(*before, strict=True))
        linked &= pair_counts(i, b, n) == 0
    np.fill_diagonal(linked, False)
    if cross:
        linked &= own_chunk[:, None] != own_chunk[None, :]
    links = linked @ copies
    root = np.full(n, -1)
    order = np.lexsort((k2, k1))
    for i in order:
        if root[i] < 0 and links[i]:
            edge = np.zeros(n, bool)
            edge[i] = True
            while edge.any():
                root[edge] = i
                edge = linked[edge].any(axis=0) & (root < 0)
    who = np.flatnonzero(root >= 0)
    return who, links[who], root[who]


def links(docs: DataFrame, nodes: DataFrame, similar: float) -> DataFrame:
    """k1, k2, links and the node r1, r2 that it hangs together with, for each task in which a node has links."""
    members = shared_buckets(nodes)
    per_node = members.groupBy("k1", "k2").agg(F.collect_list(F.struct("bucket", "chunks")).alias("own"))
    wanted = per_node.join(nodes.select("k1", "k2", "rep", "rep_mark", "copies"), ["k1", "k2"])
    # by the text's hash too: rows without doc_id, or with one that others carry, meet only themselves
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = text.join(wanted, text["doc_id"].eqNullSafe(F.col("rep")) & (F.xxhash64(text["text"]) == F.col("rep_mark"))).drop("doc_id", "rep", "rep_mark")
    rows = rows.withColumn("buckets", F.col("own.bucket")).select("k1", "k2", "copies", "text", "buckets", F.explode("own").alias("at"))
    rows = rows.select("k1", "k2", "copies", "text", "buckets", F.col("at.bucket").alias("bucket"), "at.chunks")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("k1", "k2", "bucket"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other")).drop("chunks", "other")
    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "k1", "k2")
    schema = schema_of("k1 long, k2 long, links long, r1 long, r2 long")

    def task(own: list[dict]) -> pa.RecordBatch | None:
        if len(own) < 2:
            return None
        k1, k2, copies, chunk = (np.array([r[c] for r in own], np.int64) for c in ("k1", "k2", "copies", "chunk"))
        first = own[0]
        raw = [(r["text"] or "").encode("utf-8", "surrogatepass") for r in own]
        who, n, root = verified(k1, k2, copies, [r["buckets"] for r in own], chunk, raw, first["bucket"], first["i"] != first["j"], similar)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (k1[who], k2[who], n, k1[root], k2[root])], names=schema.names) if len(who) else None

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and any(r[c] != held[0][c] for c in ("bucket", "i", "j")):
                    if (out := task(held)) is not None:
                        yield out
                    held = []
                if not held or (r["k1"], r["k2"]) != (held[-1]["k1"], held[-1]["k2"]):  # a row that is repeated comes again
                    held.append(r)
        if held and (out := task(held)) is not None:
            yield out
        held = []
        give_back()

    return dealt.mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component of (a, b), for all but the roots. a and b can be compared."""
    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("at"), F.least("m", "a").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("at")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = written(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("at"), "m")
        kept = large.join(least, F.col("a") == F.col("at"))
        small = kept.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(kept.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        edges = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "small-star")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == now:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def _classes(docs: DataFrame, similar: float, recall: float) -> DataFrame:
    """doc_id, mark, class_id, n_links and whether its class stands for it by another row (other), of every document."""
    bands, rows = bands_and_rows(similar, recall)
    seen = written(sketch(docs, bands, rows), "near-sketch")
    full = seen.where("k1 is not null")
    first = lambda d, m: F.coalesce(F.min(F.when(F.col(d).isNotNull(), F.struct(d, m))), F.min(F.struct(d, m)))
    nodes = full.groupBy("k1", "k2").agg(F.count("*").alias("copies"), first("doc_id", "mark").alias("own"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = written(nodes.select("k1", "k2", "copies", F.col("own.doc_id").alias("rep"), F.col("own.mark").alias("rep_mark"), "size", "bands"), "near-nodes")
    found = written(links(docs, nodes, similar), "near-links")
    pair = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    roots = components(found.select(pair("k1", "k2").alias("a"), pair("r1", "r2").alias("b")))
    counted = found.groupBy("k1", "k2").agg(F.sum("links").alias("links"))
    # only nodes that have copies or links are joined to documents
    marked = nodes.select("k1", "k2", "copies", "rep", "rep_mark").join(counted, ["k1", "k2"], "left").where("copies > 1 or links > 0")
    marked = marked.join(roots, pair("k1", "k2") == F.col("node"), "left").withColumn("root", F.coalesce("root", pair("k1", "k2")))
    marked = written(marked.select("k1", "k2", "copies", "rep", "rep_mark", "links", "root"), "near-marked")
    least = marked.groupBy("root").agg(first("rep", "rep_mark").alias("kept"))
    marked = marked.join(least, "root").select("k1", "k2", "kept", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = seen.select("doc_id", "mark", "k1", "k2").join(marked, ["k1", "k2"], "left")
    inside, kept = F.col("kept").isNotNull(), F.struct(F.col("doc_id").alias("rep"), F.col("mark").alias("rep_mark"))
    class_id, links_of = F.when(inside, F.col("kept.rep")).otherwise(F.col("doc_id")), F.coalesce("n_links", F.lit(0)).cast("long")
    return out.select("doc_id", "mark", class_id.alias("class_id"), links_of.alias("n_links"), (inside & ~kept.eqNullSafe(F.col("kept"))).alias("other"))


def classes(docs: DataFrame, similar: float = SIMILAR, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id and n_links of every document."""
    return _classes(docs, similar, recall).drop("mark", "other")


def one_of_each(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The documents with the smallest doc_id of their classes, all columns; of a class without doc_ids one row, of repeated rows one.

    Which rows go is found without their texts; only repeated rows are compared by text.
    """
    rows = _classes(docs, similar, RECALL).groupBy("doc_id", "mark").agg(F.max("other").alias("gone"), F.count("*").alias("n"))
    found = written(rows.where("gone or n > 1"), "near-gone")
    key, mark = fresh(docs, "key", "mark")
    own = docs["doc_id"].cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(docs["text"]) == F.col(mark))
    keyed = lambda rows: rows.select(F.col("doc_id").alias(key), F.col("mark").alias(mark))
    left, repeated = docs.join(keyed(found), own, "left_anti"), found.where("not gone")
    if repeated.isEmpty():
        return left
    return left.union(docs.join(keyed(repeated), own, "left_semi").dropDuplicates(["doc_id", "text"]))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
