"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

Words are counted over all documents; the most frequent ones, at most ``LEXICON``, are encoded once
and compiled into a minimal acyclic automaton with shared suffixes. Its arcs carry numbers whose sum
along a word's path is the word's place in a table of ids, so equal suffixes are stored once although
their ids differ. The file is written to the shared folder, sent to executors by Spark and mapped into
memory there. Words that it lacks are merged exactly, by the vocabulary's ranks.

Texts are normalised and cut as the tokenizers library does (see ``pretokens``); special tokens in a
text become their ids. The vocabulary has no decoder, so decoding joins tokens with spaces.

Defined cases: a null or empty text has no ids and decodes to the empty text; long words are merged in
n log n steps; an empty table gives an empty lexicon and no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import struct
import uuid
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice, pairwise

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.batches import map_slices, texts
from tessera.llm.pretokens import LETTER, lower_words, special_pattern
from tessera.storage import scratch, table, written

VOCABULARY = "word_bpe_49k.json"
#: Most words in the lexicon, words a worker counts before it hands them on, words whose ids a worker remembers.
LEXICON, COUNTED, REMEMBERED = 1 << 15, 100_000, 250_000
#: Bytes of text that are encoded at a time: ids and digits of a slice take some twenty times as much.
ENCODED = 1 << 20
_WORD_END = "</w>"
_ID, _MASK, _NEVER = 20, (1 << 20) - 1, 1 << 60


class Merger:
    """Exact BPE of one word: of all adjacent pairs the one of lowest rank, leftmost first, until none can be merged."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # by pair: rank and new id in one number, so that the least of them says both
        self.rank = {self.vocab[a] << _ID | self.vocab[b]: i << _ID | self.vocab[a + b] for i, (a, b) in enumerate(pairs)}
        self.first = [self.vocab[LETTER[b]] for b in range(256)]
        self.last = [self.vocab[LETTER[b] + _WORD_END] for b in range(256)]

    def __call__(self, word: bytes) -> list[int]:
        ids = [*map(self.first.__getitem__, word[:-1]), self.last[word[-1]]]
        return self._short(ids) if len(ids) < 48 else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        get = self.rank.get
        ranks = [get(a << _ID | b, _NEVER) for a, b in pairwise(ids)]
        while ranks and (best := min(ranks)) != _NEVER:
            i = ranks.index(best)
            ids[i] = best & _MASK
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << _ID | ids[i], _NEVER)
            if i < len(ranks):
                ranks[i] = get(ids[i] << _ID | ids[i + 1], _NEVER)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(r, i, p) for i, (a, b) in enumerate(pairwise(ids)) if (r := self.rank.get(p := a << _ID | b)) is not None]
        heapq.heapify(heap)
        while heap:
            best, i, pair = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] << _ID | ids[j] != pair:
                continue
            ids[i], alive[j], after[i] = best & _MASK, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (r := self.rank.get(p := ids[a] << _ID | ids[after[a]])) is not None:
                    heapq.heappush(heap, (r, a, p))
        return [x for x, live in zip(ids, alive, strict=True) if live]


def compile_lexicon(words: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """Words, sorted by bytes and distinct, to the automaton's file.

    Header: five uint32 (a mark, states, arcs, words, ids); then per state its first arc and whether a word
    ends there; per arc its byte, its state and the number of words passed by taking it; then per word the
    place of its first id, and the ids.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []  # minimal states: final, ((byte, state), ...)
    path: list[tuple[int, list]] = [(0, [False, []])]  # states of the last word that may still grow
    counts, starts, ids, last = [], [0], [], b""

    def settle(down_to: int) -> None:
        while len(path) > down_to + 1:
            byte, (final, arcs) = path.pop()
            key = (final, tuple(arcs))
            if (state := register.get(key)) is None:
                state = register[key] = len(states)
                states.append(key)
                counts.append(final + sum(counts[s] for _, s in arcs))
            path[-1][1][1].append((byte, state))

    for word, own in words:
        common = next((i for i, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
        settle(common)
        path += [(b, [False, []]) for b in word[common:]]
        path[-1][1][0] = True
        ids += own
        starts.append(len(ids))
        last = word
    settle(0)
    final, arcs = path[0][1]
    root = len(states)
    states.append((final, tuple(arcs)))
    first, labels, to, add = [0], [], [], []
    for ends, out in states:
        skipped = int(ends)
        for byte, state in out:
            labels.append(byte)
            to.append(state)
            add.append(skipped)
            skipped += counts[state]
        first.append(len(labels))
    head = struct.pack("<5I", 0x5441464C, len(states), len(labels), len(starts) - 1, len(ids))
    columns = [np.array(x, "<u4").tobytes() for x in (first, to, add, starts, ids)]
    assert root == len(states) - 1  # the last state is where every word begins
    return b"".join([head, *columns, bytes(labels), bytes(int(f) for f, _ in states)])


class Lexicon:
    """Reads the automaton from a buffer, such as a file mapped into memory."""

    def __init__(self, buffer):
        mark, states, arcs, words, ids = struct.unpack_from("<5I", buffer, 0)
        if mark != 0x5441464C:
            raise ValueError("not a lexicon")
        at, self.held = 20, buffer
        for name, n in (("first", states + 1), ("to", arcs), ("add", arcs), ("starts", words + 1), ("ids", ids)):
            setattr(self, name, memoryview(buffer)[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.label_at, self.final_at, self.root = at, at + arcs, states - 1

    def get(self, word: bytes) -> list[int] | None:
        state, place, find = self.root, 0, self.held.find
        first, to, add, base = self.first, self.to, self.add, self.label_at
        for i in range(len(word)):
            arc = find(word[i : i + 1], base + first[state], base + first[state + 1]) - base
            if arc < 0:
                return None
            place += add[arc]
            state = to[arc]
        if not self.held[self.final_at + state]:
            return None
        return self.ids[self.starts[place] : self.starts[place + 1]].tolist()


@lru_cache(1)
def _library(vocabulary: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def frequent_words(docs: DataFrame, vocabulary: str, most: int = LEXICON) -> list[str]:
    """The most frequent words of all documents, at most ``most``: all that occur so often that no more words do.

    Only the number of words in each of some hundred classes of frequency goes to the driver to find that count.
    """

    def run(parts) -> Iterator[dict]:
        tokenizer, counts = _library(vocabulary), Counter()
        special = special_pattern(tokenizer)
        for part in parts:
            for text in texts(part):
                for piece in special.split(text)[::2] if "<|" in text else (text,):
                    counts.update(lower_words(tokenizer, piece))
            if len(counts) > COUNTED:
                yield {"word": [*counts], "n": [*counts.values()]}
                counts.clear()
        yield {"word": [*counts], "n": [*counts.values()]}

    counted = map_slices(docs.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = written(counted.where("n > 1"), "word-counts")
    step = F.floor(F.log2("n") * 64).cast("int")
    left, least = most, None
    for r in sorted(counted.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r.step):
        left -= r.words
        if left < 0:
            break
        least = r.step
    return [] if least is None else [r.word for r in counted.where(step >= least).select("word").collect()]


def lexicon_file(spark: SparkSession, words: list[str], vocabulary: str) -> str:
    """Compiles the words, leaves the file in the shared folder and sends it to all executors; its name there."""
    merge = Merger(vocabulary)
    data = compile_lexicon((w, merge(w)) for w in sorted(w.encode("utf-8", "surrogateescape") for w in words))
    name = f"lexicon-{uuid.uuid4().hex}.fsa"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch(spark, 'lexicon')}/{name}")
    out = path.getFileSystem(conf).create(path)
    out.write(data)
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


class Codec:
    """Ids and tokens of texts, and texts of ids."""

    def __init__(self, vocabulary: str, lexicon: Lexicon):
        self.tokenizer, self.merge, self.lexicon = _library(vocabulary), Merger(vocabulary), lexicon
        self.special = special_pattern(self.tokenizer)
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.token = {i: t for t, i in (self.merge.vocab | self.added).items()}
        self.number = [str(i) for i in range(1 + max(self.token))]
        self.known: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogateescape")
        ids = self.lexicon.get(raw)
        return array("I", self.merge(raw) if ids is None else ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        words, known = lower_words(self.tokenizer, piece), self.known
        if new := [w for w in set(words) if w not in known]:
            if len(known) + len(new) > REMEMBERED:  # the words met first are the frequent ones
                known = self.known = dict(islice(known.items(), REMEMBERED // 2))
                new = [w for w in set(words) if w not in known]
            known.update(zip(new, map(self._word, new), strict=True))
        return b"".join(map(known.__getitem__, words))

    def encode(self, text: str) -> np.ndarray:
        if "<|" not in text:
            return np.frombuffer(self._piece(text), np.uint32)
        pieces = self.special.split(text)
        return np.frombuffer(b"".join(array("I", [self.added[p]]).tobytes() if i % 2 else self._piece(p) for i, p in enumerate(pieces)), np.uint32)

    def shown(self, ids: list[int]) -> str:
        """The ids as text."""
        return " ".join(map(self.number.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.token.__getitem__, ids))


@lru_cache(1)
def codec(vocabulary: str, name: str) -> Codec:
    """The process's own, over the lexicon that Spark has brought, mapped into memory."""
    with open(SparkFiles.get(name), "rb") as f:
        return Codec(vocabulary, Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)))


def encode(docs: DataFrame, vocabulary: str, most: int = LEXICON, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (if wanted), ids_sha256, decoded_sha256 of every document."""
    name = lexicon_file(docs.sparkSession, frequent_words(docs, vocabulary, most), vocabulary)

    def run(parts) -> Iterator[dict]:
        for part in parts:
            own = codec(vocabulary, name)
            out = {"doc_id": part["doc_id"], "n_tokens": [], "ids": [], "ids_sha256": [], "decoded_sha256": []}
            for text in texts(part):
                ids = own.encode(text)
                numbers = ids.tolist()
                out["n_tokens"].append(len(ids))
                out["ids"].append(ids)
                out["ids_sha256"].append(hashlib.sha256(own.shown(numbers).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(own.decode(numbers).encode()).hexdigest())
            yield out

    ids = "ids array<int>, " if with_ids else ""
    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), run, f"doc_id long, n_tokens long, {ids}ids_sha256 string, decoded_sha256 string", most=ENCODED)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), with_ids=False)
