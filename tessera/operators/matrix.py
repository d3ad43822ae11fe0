"""The reference graph as a table of one row a name, for graphs of more edges than one task iterates.

:func:`by_name` exchanges uses and definitions once, by name. Files are then numbered, and a step of PageRank is one pass
over a written table of numbers with the vector of ranks at hand: what goes from a pass to the next is one
number per defining file and task, not per use. Sums over pairs of files move each use once, with its name's
definers packed, to the task of its file. Vectors are held up to ``FILES_HELD`` files; beyond, :mod:`graph` joins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.schema import AMBIENT, AMBIENT_FILES, DAMPING, MAX_ITER, TOL
from tessera.storage import written

#: Files whose vectors and paths a worker holds.
FILES_HELD = 10_000_000
#: Tasks of a pass, each of which sends one number per defining file; definers in a packed row; pairs summed at once.
TASKS, PACKED, PAIRS = 32, 4_096, 1_000_000


def by_name(definitions: DataFrame, references: DataFrame) -> DataFrame:
    """definitions: (name, path), references: (path, name, count), both with repeats. name and files (path, count, made) of each defined name."""
    made = definitions.select("name", "path", F.lit(0).cast("long").alias("count"), F.lit(True).alias("made"))
    used = references.where("name is not null").select("name", "path", F.col("count").cast("long").alias("count"), F.lit(False).alias("made"))
    files = made.unionByName(used).repartition("name").groupBy("name", "path").agg(F.sum("count").alias("count"), F.max("made").alias("made"))
    rows = files.groupBy("name").agg(F.collect_list(F.struct("path", "count", "made")).alias("files"))
    return written(rows.where(F.exists("files", lambda x: x["made"])), "names")


def definitions_of(names: DataFrame) -> DataFrame:
    return names.select("name", F.explode("files").alias("f")).where("f.made").select("name", "f.path")


def references_of(names: DataFrame) -> DataFrame:
    return names.select("name", F.explode("files").alias("f")).where("f.count > 0").select("f.path", "name", "f.count")


@dataclass
class Matrix:
    """names: name, factor, src and root of each use and whether its file defines the name too (own), dst (places in makers).

    files: (path, h) as written; hashes: sorted h, in whose order files are numbered; makers: numbers of those that define."""

    names: DataFrame
    files: DataFrame
    hashes: np.ndarray
    makers: np.ndarray


def matrix(names: DataFrame, mentions: Iterable[str] = ()) -> Matrix | None:
    """None if there are too many files, or two with one hash."""
    each = names.select(F.explode("files").alias("f")).select("f.*")
    files = each.groupBy("path").agg(F.max(F.col("count") > 0).alias("uses"), F.max("made").alias("makes")).withColumn("h", F.xxhash64("path"))
    files = written(files, "files")
    if files.count() > FILES_HELD:
        return None
    told = files.select("h", F.col("uses") & F.col("path").isNotNull(), "makes").toArrow()
    h, uses, makes = (told.column(i).to_numpy() for i in range(3))
    order = np.argsort(h)
    hashes, n = h[order], max(1, int(uses.sum()))
    if (hashes[1:] == hashes[:-1]).any():
        return None
    makers = np.flatnonzero(makes[order].astype(bool))
    used, made = F.filter("files", lambda x: x["count"] > 0), F.filter("files", lambda x: x["made"] & x["path"].isNotNull())
    rows = names.select("name", F.size(used).alias("rf"), F.filter(used, lambda x: x["path"].isNotNull()).alias("used"), made.alias("made")).where("size(used) > 0 and size(made) > 0")
    if n >= AMBIENT_FILES:
        few = F.col("rf") / n <= AMBIENT
        rows = rows.where(few | F.col("name").isin(*mentions) if mentions else few)
    factor = X.ident_multiplier(F.col("name"), tuple(mentions)) * F.log(1 + n / (1 + F.col("rf"))) / F.size("made")
    number = lambda a: F.transform(a, lambda x: F.xxhash64(x["path"]))
    rows = rows.select("name", factor.alias("factor"), number("used").alias("src"), F.transform("used", lambda x: F.sqrt(x["count"])).alias("root"), F.transform("used", lambda x: x["made"]).alias("own"), number("made").alias("dst"))
    held = names.sparkSession.sparkContext.broadcast((hashes, makers))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, makers = held.value
        place = np.zeros(len(hashes), np.int32)
        place[makers] = np.arange(len(makers), dtype=np.int32)
        for b in batches:
            src, dst = (np.searchsorted(hashes, _flat(b, c)[1]).astype(np.int32) for c in ("src", "dst"))
            rows, dst = _rows(_flat(b, "dst")[0]), place[dst]
            dst = dst[np.lexsort((dst, rows))]
            new = [pa.ListArray.from_arrays(pa.array(_flat(b, c)[0], pa.int32()), pa.array(v)) for c, v in (("src", src), ("dst", dst))]
            yield pa.RecordBatch.from_arrays([b["name"], b["factor"], new[0], b["root"], b["own"], new[1]], ["name", "factor", "src", "root", "own", "dst"])

    kind = "name string, factor double, src array<int>, root array<double>, own array<boolean>, dst array<int>"
    return Matrix(written(rows.mapInArrow(numbered, kind), "matrix"), files, hashes, makers)


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of a list column from 0, and its values."""
    a = batch[name]
    offsets = a.offsets.to_numpy()
    return offsets - offsets[0] if len(offsets) else offsets, a.flatten().to_numpy(zero_copy_only=False)


def _rows(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def _parts(batch: pa.RecordBatch):
    """Of a batch of names: row, src, weight and own of each use, row and dst of each definition."""
    at, src = _flat(batch, "src")
    to, dst = _flat(batch, "dst")
    use = _rows(at)
    weight = batch["factor"].to_numpy()[use] * _flat(batch, "root")[1]
    return use, src, weight, _flat(batch, "own")[1].astype(bool), _rows(to), dst


class _Sums:
    """A vector to which pairs of place and value are added, many at a time."""

    def __init__(self, n: int):
        self.sums, self.held, self.size = np.zeros(n), [], 0

    def add(self, place: np.ndarray, value: np.ndarray) -> None:
        self.held.append((place, value))
        self.size += len(place)
        if self.size > max(PAIRS, len(self.sums)):
            self.settle()

    def settle(self) -> np.ndarray:
        if self.held:
            place, value = (np.concatenate(x) for x in zip(*self.held))
            self.sums += np.bincount(place, weights=value, minlength=len(self.sums))
            self.held, self.size = [], 0
        return self.sums


def _summed(m: Matrix, n: int, columns: list[str], add, *held) -> np.ndarray:
    """The vector of n sums to which ``add(sums, batch, *held)`` gives its part for each batch of names."""
    sent = m.names.sparkSession.sparkContext.broadcast(held)

    def part(batches):
        sums = _Sums(n)
        for b in batches:
            add(sums, b, *sent.value)
        total = sums.settle()
        there = np.flatnonzero(total)
        for i in range(0, len(there), 100_000):
            some = there[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["place", "part"])

    parts = m.names.select(*columns).coalesce(TASKS).mapInArrow(part, "place int, part double")
    got = parts.groupBy("place").agg(F.sum("part").alias("part")).toArrow()
    sent.unpersist()
    out = np.zeros(n)
    out[got["place"].to_numpy()] = got["part"].to_numpy()
    return out


def _reach(sums: _Sums, b: pa.RecordBatch) -> None:
    use, src, weight, own, to, _ = _parts(b)
    sums.add(src, weight * (np.bincount(to, minlength=b.num_rows)[use] - own))


def _step(sums: _Sums, b: pa.RecordBatch, rank: np.ndarray, makers: np.ndarray) -> None:
    use, src, weight, own, to, dst = _parts(b)
    sent = rank[src] * weight
    sums.add(dst, np.bincount(use, weights=sent, minlength=b.num_rows)[to])
    if own.any():
        sums.add(np.searchsorted(makers, src[own]), -sent[own])


_ALL = ["factor", "src", "root", "own", "dst"]


def ranks(m: Matrix, focus: Iterable[str] = (), max_iter: int = MAX_ITER, tol: float = TOL) -> tuple[np.ndarray, np.ndarray]:
    """PageRank of the files by number, and what each file's edges weigh."""
    n = len(m.hashes)
    p, focus = np.full(n, 1.0 / max(1, n)), list(focus)
    if focus and (inside := [r.h for r in m.files.where(F.col("path").isin(*focus)).select("h").collect()]):
        p = np.zeros(n)
        p[np.searchsorted(m.hashes, inside)] = 1.0 / len(inside)
    out = _summed(m, n, _ALL, _reach)
    ends, each = out <= 0, np.where(out > 0, out, 1.0)
    rank = p.copy()
    for _ in range(max_iter):
        got = np.zeros(n)
        got[m.makers] = _summed(m, len(m.makers), _ALL, _step, np.where(ends, 0.0, rank / each), m.makers)
        new = (1 - DAMPING) * p + DAMPING * (got + rank[ends].sum() * p)
        delta, rank = np.abs(new - rank).sum(), new
        if delta < tol * n:
            break
    return rank, out


def file_ranks(m: Matrix, rank: np.ndarray) -> DataFrame:
    """(node, rank)."""
    held = m.files.sparkSession.sparkContext.broadcast((m.hashes, rank))

    def ranked(batches):
        hashes, rank = held.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["path"], pa.array(rank[np.searchsorted(hashes, b["h"].to_numpy())])], ["node", "rank"])

    return m.files.select("path", "h").mapInArrow(ranked, "node string, rank double")


def _paths(m: Matrix, files: DataFrame) -> pa.Array:
    """Paths of files in the order of their hashes."""
    told = files.select("h", "path").toArrow()
    return told["path"].take(pa.array(np.argsort(told["h"].to_numpy()))).combine_chunks()


def definition_ranks(m: Matrix, rank: np.ndarray, out: np.ndarray) -> DataFrame:
    """path, name and score: what each file's rank gives to the definitions that it references."""
    share = np.where(out > 0, rank / np.where(out > 0, out, 1.0), 0.0)
    held = m.files.sparkSession.sparkContext.broadcast((share, m.makers, _paths(m, m.files.where("makes"))))

    def scored(batches):
        share, makers, paths = held.value
        for b in batches:
            use, src, weight, own, to, dst = _parts(b)
            sent = share[src] * weight
            score = np.bincount(use, weights=sent, minlength=b.num_rows)[to]
            others = np.bincount(use, minlength=b.num_rows)[to]
            if own.any():  # rows, and dst within each, ascend
                at = np.searchsorted(to * np.int64(len(makers)) + dst, use[own] * np.int64(len(makers)) + np.searchsorted(makers, src[own]))
                score[at] -= sent[own]
                others[at] -= 1
            kept = np.flatnonzero((others > 0) & (score > 0))
            for i in range(0, len(kept), 100_000):
                some = kept[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([paths.take(pa.array(dst[some])), b["name"].take(pa.array(to[some])), pa.array(score[some])], ["path", "name", "score"])

    return m.names.mapInArrow(scored, "path string, name string, score double")


def _packed(dst: np.ndarray) -> tuple[bool, bytes]:
    """Ascending numbers: the first in four bytes and differences in two, or all in four where one does not fit."""
    steps = np.diff(dst)
    if len(steps) and steps.max() > 0xFFFF:
        return True, dst.astype("<u4").tobytes()
    return False, dst[:1].astype("<u4").tobytes() + steps.astype("<u2").tobytes()


def _unpacked(wide: np.ndarray, packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of each packed one."""
    rows, numbers = [], []
    for is_wide in (False, True):
        here = np.flatnonzero(wide == is_wide)
        if not len(here):
            continue
        some = packed.take(pa.array(here))
        offsets = np.frombuffer(some.buffers()[1], np.int32)[some.offset : some.offset + len(some) + 1].astype(np.int64)
        raw = np.frombuffer(some.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        size = np.diff(offsets)
        if is_wide:
            rows.append(np.repeat(here, size // 4))
            numbers.append(raw.view("<u4").astype(np.int64))
            continue
        u, start, size = raw.view("<u2").astype(np.int64), (offsets[:-1] - offsets[0]) // 2, size // 2 - 1
        u[start + 1] += u[start] - u[start + 1] + (u[start + 1] << 16)
        u = np.delete(u, start)
        first = np.cumsum(size) - size
        total = np.cumsum(u)
        rows.append(np.repeat(here, size))
        numbers.append(total - np.repeat(total[first] - u[first], size))
    return np.concatenate(rows), np.concatenate(numbers)


def file_edges(m: Matrix) -> DataFrame:
    """src, dst, w and idents: the summed weight and the number of edges from a file to a file."""
    sc = m.files.sparkSession.sparkContext

    def packed(batches):
        for b in batches:
            use, src, weight, _, _, _ = _parts(b)
            to, dst = _flat(b, "dst")
            row, wide, data = [], [], []
            for i in range(b.num_rows):
                for j in range(to[i], to[i + 1], PACKED):
                    w, x = _packed(dst[j : min(j + PACKED, to[i + 1])])
                    row.append(i)
                    wide.append(w)
                    data.append(x)
            wide, data, row = np.array(wide, bool), pa.array(data, pa.binary()), np.array(row, np.int64)
            first, many = np.searchsorted(row, use), np.bincount(row, minlength=b.num_rows)[use]
            which = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            src, weight = np.repeat(src, many), np.repeat(weight, many)
            for i in range(0, len(which), 20_000):
                some = which[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(src[i : i + 20_000]), pa.array(weight[i : i + 20_000]), pa.array(wide[some]), data.take(pa.array(some))], ["src", "weight", "wide", "dst"])

    held = sc.broadcast((m.makers, _paths(m, m.files)))

    def summed(batches):
        """Rows come in order of src; the last file of each batch waits for more."""
        makers, paths = held.value
        none = np.zeros(0, np.int64)
        key, w, n = none, np.zeros(0), none

        def shown(key, w, n):
            for i in range(0, len(key), 50_000):
                k = key[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([paths.take(pa.array(k >> 32)), paths.take(pa.array(makers[k & 0xFFFFFFFF])), pa.array(w[i : i + 50_000]), pa.array(n[i : i + 50_000])], ["src", "dst", "w", "idents"])

        for b in batches:
            src, weight, wide = b["src"].to_numpy().astype(np.int64), b["weight"].to_numpy(), b["wide"].to_numpy(zero_copy_only=False)
            step = max(1, PAIRS // PACKED) if b["dst"].nbytes > 2 * PAIRS else len(src)
            for i in range(0, len(src), step):
                row, dst = _unpacked(wide[i : i + step], b["dst"].slice(i, step))
                row += i
                other = src[row] != makers[dst]
                row, dst = row[other], dst[other]
                key, w, n = np.concatenate([key, src[row] << 32 | dst]), np.concatenate([w, weight[row]]), np.concatenate([n, np.ones(len(row), np.int64)])
                if not len(key):
                    continue
                order = np.argsort(key, kind="stable")
                key, w, n = key[order], w[order], n[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                key, w, n = key[first], np.add.reduceat(w, first), np.add.reduceat(n, first)
                done = np.searchsorted(key, key[-1] >> 32 << 32)
                yield from shown(key[:done], w[:done], n[:done])
                key, w, n = key[done:], w[done:], n[done:]
        yield from shown(key, w, n)

    moved = m.names.select(*_ALL).mapInArrow(packed, "src int, weight double, wide boolean, dst binary")
    return moved.repartition("src").sortWithinPartitions("src").mapInArrow(summed, "src string, dst string, w double, idents long")
