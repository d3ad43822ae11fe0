"""Removing repeated passages with a sparse suffix array, sorted by a common-prefix-aware merge sort.

Every byte that a string of ``LENGTH`` bytes covers which also starts elsewhere is removed. Sorting the
suffixes at all positions would exchange many times the input, so the array is sparse: of each ``LENGTH``
bytes the leftmost smallest hash of ``GRAM`` bytes in it is the anchor. Equal strings have their anchor at
the same place, so repeats meet at anchors, about one in 75 positions, and nothing is lost.

1. A pass over the texts keeps each document's digest and the hashes of its anchors. Equal texts collapse:
   a text of ``LENGTH`` bytes or more that occurs twice is removed whole, and stays once as a partner.
2. Anchors whose hash occurs once in all texts cannot repeat. Only texts with others are read again.
3. Each task sorts the suffixes at its remaining anchors into runs, cut by the hash of the anchor. Equal
   suffixes with equal surroundings are resolved where they are, so of any passage at most one suffix of
   each task travels. Runs are front-coded: each suffix has the length of the prefix that it shares with
   the one before, and only the rest. The strings of an anchor that occurs ``COMMON`` times are dealt on
   in pieces of ``PART`` starts by the bytes that all strings of a piece share (its core). A core that is
   as common again, as within a passage whose surroundings differ, has its piece cut into single strings:
   equal ones fall together where they are, others go their own ways. So no passage, however common and
   wherever it stands, fills a reader.
4. A reader merges its runs, decoded as it goes, with a loser tree that keeps each loser's common prefix
   with the winner that it lost to, so that no comparison looks at a prefix known to be equal. The common
   prefix of neighbours comes with the merge; neighbours that share ``GRAM`` bytes form a group. Two strings
   with the anchor at the same place are equal where the common prefixes of the merge reach their end and
   those of the bytes before the anchor, sorted backwards, reach their start: no bytes are hashed for that.
5. The ranges come back to their text, whose remaining bytes are hashed.

Defined cases: a null text is empty; texts under ``LENGTH`` bytes lose nothing; very long texts are taken
in pieces that overlap; overlaps within a text count; repeated rows are copies; columns other than doc_id
and text are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.batches import map_slices, texts
from tessera.llm.textkit import Block, U, mix
from tessera.storage import table, written

LENGTH, GRAM = 200, 48
#: Bytes whose anchors are sought at a time: some ten arrays of eight bytes for each.
SURVEYED = 1 << 19
#: Bits of a sort key that hold the position, suffixes of a reader in expectation, bytes of suffixes that a writer holds, occurrences from which an anchor or a core is dealt further, starts in a piece, and parts in which a common core is joined.
PLACE, READER, HELD, COMMON, PART, SALTS = 24, 65_536, 48 << 20, 4_096, 16, 32


def anchors(block: Block, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first and last start of the strings that have it, hash) of all strings of ``length`` bytes within one text."""
    n = len(block.data)
    none = np.zeros(0, np.int64)
    if n < length or not block.n:
        return none, none, none, none.view(U)
    block.prepare()
    at = np.arange(n - gram + 1)
    hashes = block.hashes(at, at + gram)
    width, windows = length - gram + 1, n - length + 1
    place = U((1 << PLACE) - 1)
    if n > int(place):  # one very long text: positions would not fit
        return _long(block, hashes, length, width)
    low = _least(((hashes >> U(PLACE)) << U(PLACE)) | at.astype(U), width)[:windows]
    anchor = (low & place).astype(np.int64)
    ends = np.append(block.first[1:], n) - 1  # of texts, without the space behind
    start = np.arange(windows)
    inside = start + length <= ends[block.owner(start)]
    return _grouped(anchor[inside], start[inside], hashes)


def _long(block: Block, hashes: np.ndarray, length: int, width: int):
    """As :func:`anchors`, over pieces of a text that overlap."""
    n, piece, out = len(block.data) - 1, (1 << PLACE) - 1, []
    for a in range(0, n - length + 1, piece - length):
        own = hashes[a : a + piece - length + width]
        at = np.arange(len(own), dtype=U)
        windows = min(piece - length, n - length + 1 - a)
        low = _least(((own >> U(PLACE)) << U(PLACE)) | at, width)[:windows]
        out.append((a + (low & U(piece)).astype(np.int64), a + np.arange(windows)))
    return _grouped(*(np.concatenate(x) for x in zip(*out, strict=True)), hashes)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    pad = -len(x) % width
    y = np.concatenate([x, np.full(pad, ~U(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    behind = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(x) - width + 1
    return np.minimum(behind[:m], ahead[width - 1 : width - 1 + m])


def _grouped(anchor, start, hashes):
    if not len(anchor):
        return anchor, anchor, anchor, np.zeros(0, U)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = np.append(new[1:], len(anchor)) - 1
    return anchor[new], start[new], start[last], hashes[anchor[new]]


def survey(docs: DataFrame) -> DataFrame:
    """doc_id, key (SHA-256 of the bytes), n_bytes and the hashes of the anchors."""

    def run(parts) -> Iterator[dict]:
        for part in parts:
            raw = [t.encode("utf-8", "surrogatepass") for t in texts(part)]
            block = Block(raw)
            at, _, _, h = anchors(block)
            cut = np.searchsorted(at, block.first[1:])
            yield {"doc_id": part["doc_id"], "key": [hashlib.sha256(x).digest() for x in raw], "n_bytes": [len(x) for x in raw], "anchors": [x.tolist() for x in np.split(h.view(np.int64), cut)] if raw else []}

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, key binary, n_bytes long, anchors array<long>", most=SURVEYED)


def common(a: bytes, b: bytes, h: int) -> int:
    """The length of the common prefix of a and b, known to be h at least."""
    n = min(len(a), len(b))
    while h + 16 <= n and a[h : h + 16] == b[h : h + 16]:
        h += 16
    while h < n and a[h] == b[h]:
        h += 1
    return h


# A suffix: (bytes from the anchor on, bytes before it, text, position, least and most bytes before the anchor of the strings meant, whether they are known to repeat)
def front_code(run: list[tuple], keys: list[bytes]) -> bytes:
    """A sorted run as bytes; keys: the texts' digests, by the number that suffixes carry."""
    shared, last = [], b""
    for s in run:
        shared.append(common(last, s[0], 0))
        last = s[0]
    used = sorted({s[2] for s in run})
    number = {t: i for i, t in enumerate(used)}
    columns = [np.array(x, kind).tobytes() for x, kind in ((shared, "<u2"), ([len(s[0]) - h for s, h in zip(run, shared, strict=True)], "<u2"), ([len(s[1]) for s in run], "<u2"), ([number[s[2]] for s in run], "<u4"), ([s[3] for s in run], "<i8"), ([s[4] for s in run], "<u2"), ([s[5] for s in run], "<u2"), ([s[6] for s in run], "u1"))]
    tails = b"".join([s[0][h:] for s, h in zip(run, shared, strict=True)])
    lefts = b"".join([s[1] for s in run])
    return zlib.compress(b"".join([struct.pack("<3I", len(run), len(used), len(tails)), *(keys[t] for t in used), *columns, tails, lefts]), 1)


def front_decode(data: bytes) -> Iterator[tuple[tuple, int]]:
    """(suffix with its text's digest, common prefix with the one before), one by one."""
    data = zlib.decompress(data)
    n, k, length = struct.unpack_from("<3I", data)
    at = 12
    keys = [data[at + 32 * i : at + 32 * i + 32] for i in range(k)]
    at += 32 * k
    columns = []
    for kind in ("<u2", "<u2", "<u2", "<u4", "<i8", "<u2", "<u2", "u1"):
        columns.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    left_at, last = at + length, b""
    for row in zip(*columns, strict=True):
        h, tail, left, key, place, low, high, known = map(int, row)
        last = last[:h] + data[at : at + tail]
        yield (last, data[left_at : left_at + left], keys[key], place, low, high, known), h
        at, left_at = at + tail, left_at + left


def merge(runs: list[Iterator[tuple[tuple, int]]]) -> Iterator[tuple[tuple, int]]:
    """(suffix, common prefix with the one before) in order, by a loser tree over the runs."""
    k = 1
    while k < len(runs):
        k *= 2
    now = [next(r, None) for r in runs]
    heads: list[bytes | None] = [x[0][0] if x else None for x in now] + [None] * (k - len(runs))
    shared = [0] * k  # with the last winner, or with the one that a loser lost to
    loser = [0] * k

    def play(i: int, j: int) -> tuple[int, int]:
        """(winner, loser)"""
        a, b = heads[i], heads[j]
        if b is None:
            return i, j
        if a is None:
            return j, i
        if shared[i] != shared[j]:
            return (i, j) if shared[i] > shared[j] else (j, i)
        h = common(a, b, shared[i])
        if a[h : h + 1] <= b[h : h + 1]:
            shared[j] = h
            return i, j
        shared[i] = h
        return j, i

    def build(node: int) -> int:
        if node >= k:
            return node - k
        win, loser[node] = play(build(2 * node), build(2 * node + 1))
        return win

    win = build(1) if k > 1 else 0
    while heads[win] is not None:
        yield now[win][0], shared[win]
        if (after := next(runs[win], None)) is None:
            heads[win] = None
        else:
            now[win], heads[win], shared[win] = after, after[0][0], after[1]
        node = (win + k) // 2
        while node:
            win, loser[node] = play(win, loser[node])
            node //= 2


def matched(group: list[tuple], shared: list[int], length: int = LENGTH) -> Iterator[tuple[bytes, int, int]]:
    """(text, start, end) of the bytes that repeated strings cover, for suffixes in order that share the anchor. shared: common prefixes with the one before."""
    n = len(group)
    for s in group:
        if s[6]:
            yield s[2], s[3] - s[5], s[3] - s[4] + length
    if n <= 8:
        for i in range(n):
            right = length
            for j in range(i + 1, n):
                right = min(right, shared[j])
                p, q = group[i], group[j]
                if (p[6] and q[6]) or right + min(len(p[1]), len(q[1])) < length:
                    continue
                left = common(p[1][::-1], q[1][::-1], 0)
                low, high = max(length - right, p[4], q[4]), min(left, p[5], q[5])
                if low <= high:
                    for s in (p, q):
                        if not s[6]:
                            yield s[2], s[3] - high, s[3] - low + length
        return
    low, high = (np.array([s[c] for s in group]) for c in (4, 5))
    backwards = [s[1][::-1] for s in group]
    order = sorted(range(n), key=backwards.__getitem__)
    left = np.array([0] + [common(backwards[a], backwards[b], 0) for a, b in zip(order, order[1:])])
    right, hits = np.array(shared), np.zeros((n, int(high.max()) + 1), bool)
    for d in range(int(low.min()), int(high.max()) + 1):
        own = np.flatnonzero((low <= d) & (d <= high))
        before = np.empty(n, np.int64)  # the same for those that share d bytes before the anchor, as neighbours in their order do
        before[order] = np.cumsum(left < d)
        behind = np.cumsum(right < length - d)
        _, back, counts = np.unique(behind[own] * (n + 1) + before[own], return_inverse=True, return_counts=True)
        hits[own, d] = counts[back] > 1
    for i in np.flatnonzero(hits.any(axis=1)).tolist():
        if not group[i][6]:
            edge = np.diff(hits[i].view(np.int8), prepend=np.int8(0), append=np.int8(0))
            for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                yield group[i][2], group[i][3] - b + 1, group[i][3] - a + length


def spread(h: int, data: bytes, d: int) -> int:
    """A 64-bit key of an anchor's hash and some bytes around it, the first d before the anchor."""
    return ((h ^ zlib.crc32(data, d) * 0x9E3779B1) + (1 << 63)) % (1 << 64) - (1 << 63)


def pieces(raw: bytes, at: int, low: int, high: int, h: int) -> Iterator[tuple[int, int, int]]:
    """(low, high, key of the core) of the pieces of an anchor's strings. A core is what all strings of a whole piece have; equal strings have equal cores."""
    for a in range(low - low % PART, high + 1, PART):
        yield max(a, low), min(a + PART - 1, high), spread(h, raw[at - a : at - (a + PART - 1) + LENGTH], a)


def joined(own: list[int]) -> bytes:
    """Starts and ends in any order, as bytes, those that touch as one."""
    pairs = np.array(own, np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    ends = np.maximum.accumulate(pairs[:, 1])
    first = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > ends[:-1]]))
    return np.stack([pairs[first, 0], ends[np.append(first[1:], len(pairs)) - 1]], axis=1).astype("<i8").tobytes()


class Writer:
    """Gathers suffixes, resolves those that are equal here, and gives sorted runs by reader."""

    def __init__(self, readers: int, most: int = COMMON):
        self.readers, self.most, self.keys, self.parts, self.size = readers, most, [], {}, 0

    def add(self, raw: bytes, key: bytes, at: int, first: int, last: int, h: int, seen: int, hot: set[int] = frozenset()) -> None:
        """The strings of ``raw`` that start from first to last and have their anchor at ``at``. hot: keys of common cores."""
        low, high = at - last, at - first
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        if seen < self.most:
            cuts = [(low, high, h)]
        else:
            cuts = []
            for x, y, core in pieces(raw, at, low, high, h):
                cuts += [(d, d, spread(h, raw[at - d : at - d + LENGTH], d)) for d in range(x, y + 1)] if core in hot else [(x, y, core)]
        for x, y, way in cuts:
            own = self.parts.setdefault(way % self.readers, {})
            same = own.setdefault((raw[at : at - x + LENGTH], raw[at - y : at], x, y), [])
            self.size += 120 if same else LENGTH + y - x + 400
            same.append((len(self.keys) - 1, at))

    def flush(self) -> dict:
        out = {"part": [], "key": [], "ranges": [], "run": []}
        ranges: dict[int, list[int]] = {}
        for part, own in self.parts.items():
            run = []
            for (suffix, before, low, high), places in own.items():
                known = len(places) > 1
                if known:
                    for text, at in places:
                        ranges.setdefault(text, []).extend((at - high, at - low + LENGTH))
                run.append((suffix, before, *places[0], low, high, known))
            run.sort(key=lambda s: s[0])
            out["part"].append(part)
            out["key"].append(None)
            out["ranges"].append(None)
            out["run"].append(front_code(run, self.keys))
        for text, own in ranges.items():
            out["part"].append(text % self.readers)
            out["key"].append(self.keys[text])
            out["ranges"].append(joined(own))
            out["run"].append(None)
        self.keys, self.parts, self.size = [], {}, 0
        return out


def _found(parts) -> Iterator[tuple[bytes, bytes, dict, set, list]]:
    """Of each text: digest, bytes, counts of its repeated anchors by hash, keys of common cores, and its anchors. A row without digest tells the cores of the rows behind it."""
    hot: set[int] = set()
    for part in parts:
        marks = part["hot"].to_pylist() if "hot" in part.schema.names else [None] * part.num_rows
        for key, text, hits, own in zip(part["key"].to_pylist(), texts(part), part["hits"].to_pylist(), marks, strict=True):
            if key is None:
                hot = set(own)
                continue
            raw = text.encode("utf-8", "surrogatepass")
            at, first, last, h = anchors(Block([raw]))
            yield key, raw, {x["anchor"]: x["seen"] for x in hits}, hot, list(zip(at.tolist(), first.tolist(), last.tolist(), h.view(np.int64).tolist(), strict=True))


def in_slices(wanted: DataFrame, most: int) -> DataFrame:
    """Texts by slice, and before each slice's a row without key, with those of its cores (hot) that occur as often as ``most`` in all.

    A slice is some bytes of texts that one task has read together, so that it counts a core once however often it has it."""

    def cores(parts) -> Iterator[dict]:
        task = TaskContext.get().partitionId()
        for number, part in enumerate(parts):
            slice_, seen = task << 32 | number, Counter()
            for _, raw, counts, _, own in _found([part]):
                seen.update(core for a, b, c, x in own if counts.get(x, 0) >= most for _, _, core in pieces(raw, a, a - c, a - b, x))
            n, none = part.num_rows, [None] * len(seen)
            yield {
                "slice": [slice_] * (n + len(seen)),
                **{c: [*part[c].to_pylist(), *none] for c in ("key", "text", "hits")},
                "core": [*[None] * n, *seen], "n": [*[None] * n, *seen.values()],
            }

    ddl = "slice long, key binary, text string, hits array<struct<anchor:long,seen:long>>, core long, n long"
    both = written(map_slices(wanted.select("key", "text", "hits"), cores, ddl), "suffix-slices")
    found = both.where("core is not null").select("slice", "core", "n")
    hot = found.groupBy("core").agg(F.sum("n").alias("n")).where(F.col("n") >= most)
    hot = hot.select("core", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    found = found.withColumn("salt", F.pmod(F.xxhash64("slice"), F.lit(SALTS)).cast("int"))
    marks = found.join(hot, ["core", "salt"]).groupBy("slice").agg(F.collect_list("core").alias("hot"))
    own = both.where("core is null").select("slice", "key", "text", "hits", F.lit(None).cast("array<long>").alias("hot"))
    empty = own.select("slice").distinct().join(marks, "slice", "left").select("slice", F.coalesce("hot", F.array().cast("array<long>")).alias("hot"))
    return own.unionByName(empty, allowMissingColumns=True).repartition("slice").sortWithinPartitions("slice", F.col("key").isNotNull())


def ranges(wanted: DataFrame, readers: int, most: int = COMMON, cut: bool = True) -> DataFrame:
    """wanted: key, text and hits (hash and count of the anchors that occur twice or more); cut: whether any is as common as ``most``. (key, ranges) with the bytes to remove."""

    def write(parts) -> Iterator[dict]:
        writer = Writer(readers, most)
        for key, raw, counts, hot, own in _found(parts):
            for a, b, c, x in own:
                if x in counts:
                    writer.add(raw, key, a, b, c, x, counts[x], hot)
            if writer.size > HELD:
                yield writer.flush()
        if writer.parts:
            yield writer.flush()

    def read(parts) -> Iterator[dict]:
        part, runs = None, []
        for batch in parts:
            done = [(k, r) for k, r in zip(batch["key"].to_pylist(), batch["ranges"].to_pylist(), strict=True) if k is not None]
            if done:
                yield {"key": [k for k, _ in done], "ranges": [r for _, r in done]}
            for p, run in zip(batch["part"].to_pylist(), batch["run"].to_pylist(), strict=True):
                if run is None:
                    continue
                if p != part and runs:
                    yield merged(runs)
                    runs = []
                part = p
                runs.append(run)
        if runs:
            yield merged(runs)

    def merged(runs: list[bytes]) -> dict:
        found: dict[bytes, list[int]] = {}
        group, shared = [], []

        def close() -> None:
            if len(group) > 1 or group[0][6]:
                for text, a, b in matched(group, shared):
                    found.setdefault(text, []).extend((a, b))

        for suffix, h in merge([front_decode(r) for r in runs]):
            if group and h < GRAM:
                close()
                group, shared = [], []
            group.append(suffix)
            shared.append(h)
        if group:
            close()
        return {"key": [*found], "ranges": [joined(x) for x in found.values()]}

    ddl = "part int, key binary, ranges binary, run binary"
    if cut:
        common_one = F.exists("hits", lambda x: x["seen"] >= most)
        runs = map_slices(wanted.where(~common_one), write, ddl).unionByName(map_slices(in_slices(wanted.where(common_one), most), write, ddl))
    else:
        runs = map_slices(wanted, write, ddl)
    dealt = runs.repartition(readers, "part").sortWithinPartitions("part")
    return map_slices(dealt, read, "key binary, ranges binary", "run")


def union(own: list[bytes], size: int) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that any range covers."""
    pairs = np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 2) for x in own])
    edge = np.bincount(pairs[:, 0], minlength=size + 1) - np.bincount(pairs[:, 1], minlength=size + 1)
    change = np.diff((np.cumsum(edge) > 0).view(np.int8), prepend=np.int8(0))
    return list(zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist(), strict=True))


def deduplicate(docs: DataFrame, most: int = COMMON) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document. most: occurrences from which an anchor is dealt further; no matter for the result."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = written(survey(docs), "suffix-survey")
    distinct = seen.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"), F.first("anchors").alias("anchors"))
    distinct = written(distinct, "suffix-texts")
    each = distinct.select("key", F.explode("anchors").alias("anchor"))
    twice = written(each.groupBy("anchor").agg(F.count("*").alias("seen")).where("seen > 1"), "suffix-anchors")
    total, highest = twice.agg(F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.max("seen"), F.lit(0))).first()
    readers = max(8, -(-total // READER))
    hits = each.distinct().join(twice, "anchor").groupBy("key").agg(F.collect_list(F.struct("anchor", "seen")).alias("hits"))
    hits = written(hits.join(distinct.select("key", "rep", "copies"), "key"), "suffix-hits")
    right = own.join(hits, own["doc_id"].eqNullSafe(F.col("rep")))
    # a doc_id that several rows carry may bring other texts; equal rows would count as repeats
    right = right.where(F.unhex(F.sha2(F.encode("text", "utf-8"), 256)) == F.col("key")).select("key", "text", "hits", "copies")
    wanted = written(right.dropDuplicates(["key"]), "suffix-wanted")
    found = ranges(wanted.select("key", "text", "hits"), int(readers), most, highest >= most).groupBy("key").agg(F.collect_list("ranges").alias("ranges"))
    cut = wanted.where("copies = 1").select("key", "text").join(found, "key")

    def remove(parts) -> Iterator[dict]:
        for part in parts:
            out = {"key": part["key"], "n_removed": [], "n_spans": [], "kept": []}
            for text, own in zip(texts(part), part["ranges"].to_pylist(), strict=True):
                raw, digest, at = text.encode("utf-8", "surrogatepass"), hashlib.sha256(), 0
                spans = union(own, len(raw))
                for a, b in spans:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                out["n_removed"].append(sum(b - a for a, b in spans))
                out["n_spans"].append(len(spans))
                out["kept"].append(digest.hexdigest())
            yield out

    parts = written(map_slices(cut, remove, "key binary, n_removed long, n_spans long, kept string"), "suffix-cuts")
    whole = distinct.where(f"copies > 1 and n_bytes >= {LENGTH}").select("key", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept"))
    out = seen.select("doc_id", "key", "n_bytes").join(parts.unionByName(whole), "key", "left")
    none = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept", F.lower(F.hex("key"))).alias("kept_sha256"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))
