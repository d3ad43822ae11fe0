"""Token ids in a length-delimited binary format with a separate offset index.

A shard holds records one after the other:

    uint64 length | uint32 masked CRC-32 of these 8 bytes | payload | uint32 masked CRC-32 of the payload

all little-endian; the payload is a byte with the width of an id, 2 or 4, and one document's ids in that
width, the narrowest for the vocabulary. Checksums are masked (rotated right
by 15 bits, plus a constant) so that a checksum over bytes that hold checksums stays sound. Beside
each shard lies an index: for each record a row of int64 (has_id, doc_id, offset), behind a header of
the number of rows, for reads in any order without a pass over the shard.

Shards are cut by ranges of doc_id and sorted within, so record order over all shards is doc_id order
(null first, equal ids by a hash of the text). No id, however often it repeats, has to fit one shard. A shard's name carries the task attempt that wrote it, and the
manifest names the files that count: retries and speculative copies leave no doubt. Files go to the
shared folder by its URI through Arrow's file systems, which open local, HDFS and object stores.

Defined cases: a null text is empty and its record holds the end id only; texts of any length are encoded
whole; repeated rows give repeated records; columns other than doc_id and text are not read; an empty table
gives no shard and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.batches import map_slices, schema_of, texts
from tessera.llm.pretokens import BYTE_LEVEL_WORD, plain, special_pattern
from tessera.storage import scratch, table, written

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Words whose ids each Python worker remembers.
REMEMBERED = 400_000
_HEAD, _CRC = struct.Struct("<QI"), struct.Struct("<I")


def masked(data) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, _CRC.pack(masked(length)), payload, _CRC.pack(masked(payload))))


def read_record(source) -> bytes | None:
    """The next payload of an open shard, None at its end."""
    head = source.read(_HEAD.size)
    if not head:
        return None
    if len(head) < _HEAD.size:
        raise ValueError("shard ends within a record's length")
    length, crc = _HEAD.unpack(head)
    if crc != masked(head[:8]):
        raise ValueError("checksum of a length differs")
    payload, tail = source.read(length), source.read(_CRC.size)
    if len(payload) < length or len(tail) < _CRC.size or _CRC.unpack(tail)[0] != masked(payload):
        raise ValueError("checksum of a record differs")
    return payload


def ids_of(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, f"<u{payload[0]}", offset=1).astype("<u4")


def read_index(path: str) -> np.ndarray:
    store, place = fs.FileSystem.from_uri(path)
    with store.open_input_stream(place + ".idx") as source:
        rows = np.frombuffer(source.read(), dtype="<i8")
    if not len(rows) or len(rows) != 1 + 3 * rows[0]:
        raise ValueError("index is incomplete")
    return rows[1:].reshape(-1, 3)


def read_at(path: str, offset: int) -> np.ndarray:
    """The ids of the record at an offset of the index."""
    store, place = fs.FileSystem.from_uri(path)
    with store.open_input_file(place) as source:
        source.seek(int(offset))
        return ids_of(read_record(source))


class Encoder:
    """Texts to the bytes of their ids, ``width`` to an id. The library encodes each word once; the ids of a text are those of its words."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if max(self.tokenizer.get_vocab().values()) < 1 << 16 else 4
        self.special = special_pattern(self.tokenizer)
        (self.line,) = self.tokenizer.encode("\n", add_special_tokens=False).ids  # of a byte that no other word has
        self.known: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=f"<u{self.width}").tobytes()

    def _learn(self, words: list[str]) -> None:
        """One call for all new words: a line break between two words is a word of its own and leaves both as they are."""
        solid = [w for w in words if not w.isspace()]
        self.known.update((w, self._library(w)) for w in words if w.isspace())
        if not solid:
            return
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(solid)], add_special_tokens=False)[0].ids, dtype=f"<u{self.width}")
        cuts = np.flatnonzero(ids == self.line)
        if len(cuts) != len(solid) - 1:
            raise ValueError("words were cut in another way")
        data, at = ids.tobytes(), 0
        for w, cut in zip(solid, [*(cuts * self.width).tolist(), len(data)], strict=True):
            self.known[w] = data[at:cut]
            at = cut + self.width

    def __call__(self, text: str) -> bytes:
        if not plain(text) or self.special.search(text):
            return self._library(text)
        words = BYTE_LEVEL_WORD.findall(text)
        known = self.known
        if new := [w for w in set(words) if w not in known]:
            if len(known) + len(new) > REMEMBERED:  # the words met first are the frequent ones
                known = self.known = dict(islice(known.items(), REMEMBERED // 2))
                new = [w for w in set(words) if w not in known]
            self._learn(new)
        return b"".join(map(known.__getitem__, words))


@lru_cache(1)
def encoder(vocabulary: str) -> Encoder:
    """The process's own, so that its words outlast a task."""
    return Encoder(vocabulary)


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Writes the shards of (doc_id, text) and returns their manifest: part, path, n_docs, n_tokens."""
    ddl = "part int, path string, n_docs long, n_tokens long"

    def shard(parts) -> Iterator[dict]:
        parts = iter(parts)
        if (first := next(parts, None)) is None:
            return
        encode, task = encoder(vocabulary), TaskContext.get()
        if end_id >= 1 << 8 * encode.width:
            raise ValueError("the end id does not fit the ids' width")
        head, end = bytes([encode.width]), end_id.to_bytes(encode.width, "little")
        path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.rec"
        store, place = fs.FileSystem.from_uri(path)
        store.create_dir(place.rsplit("/", 1)[0], recursive=True)
        index, offset, tokens = [np.empty((0, 3), "<i8")], 0, 0
        with store.open_output_stream(place) as out:
            part = first
            while part is not None:
                rows = []
                for doc, text in zip(part["doc_id"].to_pylist(), texts(part), strict=True):
                    record = frame(payload := head + encode(text) + end)
                    out.write(record)
                    rows.append((doc is not None, doc or 0, offset))
                    offset += len(record)
                    tokens += len(payload) // encode.width
                index.append(np.array(rows, dtype="<i8").reshape(-1, 3))
                part = next(parts, None)
        rows = np.concatenate(index)
        with store.open_output_stream(place + ".idx") as out:
            out.write(struct.pack("<q", len(rows)))
            out.write(rows.tobytes())
        yield {"part": [task.partitionId()], "path": [path], "n_docs": [len(rows)], "n_tokens": [tokens]}

    # rows that share a doc_id, or all, are told apart by hash and place, so that they need not share a shard
    own = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("place"))
    ordered = own.repartitionByRange("doc_id", "mark", "place").sortWithinPartitions("doc_id", "mark", "place")
    return written(map_slices(ordered, shard, ddl), "token-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Every record of the shards in the manifest: doc_id, start, n_tokens, ids_crc32, ids (binary)."""
    schema = schema_of("doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    shards = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))

    def records(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                store, place = fs.FileSystem.from_uri(shard["path"])
                start, rows, held = shard["start"], [], 0
                with store.open_input_stream(place, buffer_size=1 << 20) as source:
                    for has_id, doc, _ in read_index(shard["path"]).tolist():
                        if (payload := read_record(source)) is None:
                            raise ValueError("shard has fewer records than its index")
                        ids = ids_of(payload).tobytes()
                        rows.append((doc if has_id else None, start, len(ids) // 4, zlib.crc32(ids), ids))
                        start, held = start + len(ids) // 4, held + len(ids)
                        if held > 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    if source.read(1):
                        raise ValueError("shard has more records than its index")
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    return shards.repartition(max(1, manifest.count())).mapInArrow(records, schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    manifest = write(docs, scratch(spark, "token-shards"), public_tokenizers.path(VOCABULARY))
    return read(manifest).drop("ids")
