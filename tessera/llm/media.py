"""Media columns in Matroska: texts' bytes as lossless 8-bit samples, read back as packet tables.

The writer stores a payload as one 8-bit PCM track: frames of 576 samples at 8,000 Hz (72 ms each),
eight to a block with fixed-size lacing, 256 to a cluster, and a cue for each cluster. The reader parses
any such file: variable-length ids and sizes, unknown sizes, simple blocks and block groups, all four
kinds of lacing, cues. Its packet table has track, timestamp, byte range and key flag of each frame.

Defined cases: a null or empty text is one frame of bytes 255; equal texts give equal files and
features; an empty table gives no rows; a broken file raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.batches import map_slices, texts
from tessera.storage import table

FRAME, RATE, LACE, PER_CLUSTER = 576, 8000, 8, 256
FRAME_MS = FRAME * 1000 // RATE

#: Fixed values of the container format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ, ID_LENGTH, SIZE_LENGTH, DOC_TYPE, DOC_VERSION, DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK, NUMBER, UID, KIND, LACING, CODEC, AUDIO, SAMPLING, CHANNELS, DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIME, SIMPLE, GROUP, BLOCK, GROUP_TIME = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_AT = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements of the segment's level, which end a cluster of unknown size.
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367}


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def vint(x: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones are kept for unknown sizes."""
    width = width or next(n for n in range(1, 9) if x < (1 << 7 * n) - 1)
    return (x | 1 << 7 * width).to_bytes(width, "big")


def element(name: int, *body: bytes) -> bytes:
    data = b"".join(body)
    return _id(name) + vint(len(data)) + data


def number(name: int, x: int) -> bytes:
    return element(name, x.to_bytes(max(1, (x.bit_length() + 7) // 8), "big"))


def payload_of(raw: bytes) -> bytes:
    return raw + b"\xff" * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))


def write(payload: bytes) -> bytes:
    """A Matroska file of a payload that is a positive multiple of a frame."""
    frames = len(payload) // FRAME
    if not frames or len(payload) % FRAME:
        raise ValueError("payload is not a positive multiple of a frame")
    head = element(EBML, number(EBML_VERSION, 1), number(EBML_READ, 1), number(ID_LENGTH, 4), number(SIZE_LENGTH, 8), element(DOC_TYPE, b"matroska"), number(DOC_VERSION, 4), number(DOC_READ, 2))
    info = element(INFO, number(SCALE, 1_000_000), element(DURATION, struct.pack(">d", float(frames * FRAME_MS))), element(MUXER, b"tessera"), element(WRITER, b"tessera"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", float(RATE))), number(CHANNELS, 1), number(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, number(NUMBER, 1), number(UID, 1), number(KIND, 2), number(LACING, 1), element(CODEC, b"A_PCM/INT/LIT"), audio))
    parts, points, at = [info, tracks], [], len(info) + len(tracks)
    for first in range(0, frames, PER_CLUSTER):
        body = [number(TIME, first * FRAME_MS)]
        for f in range(first, min(first + PER_CLUSTER, frames), LACE):
            n = min(LACE, frames - f, first + PER_CLUSTER - f)
            flags = 0x80 | (0x04 if n > 1 else 0)
            lace = bytes([n - 1]) if n > 1 else b""
            body.append(element(SIMPLE, b"\x81", struct.pack(">hB", (f - first) * FRAME_MS, flags), lace, payload[f * FRAME : (f + n) * FRAME]))
        cluster = element(CLUSTER, *body)
        points.append(element(POINT, number(CUE_TIME, first * FRAME_MS), element(POSITIONS, number(CUE_TRACK, 1), number(CUE_AT, at))))
        parts.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, *parts, element(CUES, *points))


@dataclass
class Media:
    scale: int  # nanoseconds in a unit of time
    duration: float
    tracks: dict[int, dict]
    clusters: list[tuple[int, int]]  # timestamp, offset in the segment
    cues: list[tuple[int, int, int]]  # timestamp, track, offset in the segment
    packets: list[tuple[int, int, int, int, bool, int]]  # track, nanoseconds, offset in the file, bytes, key, block


def read_id(data: bytes, at: int) -> tuple[int, int]:
    if at >= len(data) or not data[at] or (n := 9 - data[at].bit_length()) > 4 or at + n > len(data):
        raise ValueError(f"no element id at {at}")
    return int.from_bytes(data[at : at + n], "big"), at + n


def read_size(data: bytes, at: int) -> tuple[int | None, int]:
    """(size, where it ends); None if the size is unknown."""
    if at >= len(data) or not data[at] or at + (n := 9 - data[at].bit_length()) > len(data):
        raise ValueError(f"no size at {at}")
    x = int.from_bytes(data[at : at + n], "big") & ((1 << 7 * n) - 1)
    return (None if x == (1 << 7 * n) - 1 else x), at + n


def children(data: bytes, at: int, end: int, stop: set[int] = frozenset()) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements from at to end. One of unknown size has the end of what it lies in; if one of ``stop`` follows, the walk ends."""
    while at < end:
        name, body = read_id(data, at)
        if name in stop:
            return
        size, body = read_size(data, body)
        close = end if size is None else body + size
        if close > end:
            raise ValueError(f"element at {at} ends past its parent")
        if size is None and name == CLUSTER:
            for _, _, close in children(data, body, end, TOP):
                pass
            close = close if body < end else body
        yield name, body, close
        at = close


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    return struct.unpack({4: ">f", 8: ">d"}[b - a], data[a:b])[0] if b > a else 0.0


def laced(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(offset, bytes) of the frames of a block whose lace head begins at ``at``. kind: 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    if not kind:
        return [(at, end - at)]
    n, at, sizes = data[at] + 1, at + 1, []
    if kind == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == 3 and n > 1:
        size, at = read_size(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            start = at
            change, at = read_size(data, at)
            if change is None:
                change = (1 << 7 * (at - start)) - 1
            size += change - ((1 << 7 * (at - start) - 1) - 1)
            sizes.append(size)
    elif kind == 2:
        if (end - at) % n:
            raise ValueError("block is no multiple of its frames")
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at > end:
        raise ValueError("frames are longer than their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def read(data: bytes) -> Media:
    """Parses a file that holds all of a segment."""
    media = Media(1_000_000, 0.0, {}, [], [], [])
    top = list(children(data, 0, len(data)))
    if not top or top[0][0] != EBML or not (segments := [x for x in top if x[0] == SEGMENT]):
        raise ValueError("no Matroska file")
    _, base, stop = segments[0]
    blocks = 0
    for name, a, b in children(data, base, stop):
        if name == INFO:
            for k, c, d in children(data, a, b):
                if k == SCALE:
                    media.scale = _uint(data, c, d)
                elif k == DURATION:
                    media.duration = _float(data, c, d)
        elif name == TRACKS:
            for k, c, d in children(data, a, b):
                if k == TRACK:
                    own = {x: (y, z) for x, y, z in children(data, c, d)}
                    audio = {x: (y, z) for x, y, z in children(data, *own[AUDIO])} if AUDIO in own else {}
                    media.tracks[_uint(data, *own[NUMBER])] = {"codec": data[slice(*own[CODEC])].decode(), "kind": _uint(data, *own[KIND]), "rate": _float(data, *audio[SAMPLING]) if SAMPLING in audio else 8000.0, "bits": _uint(data, *audio[DEPTH]) if DEPTH in audio else 0}
        elif name == CLUSTER:
            time, held = 0, []
            for k, c, d in children(data, a, b, TOP):
                if k == TIME:
                    time = _uint(data, c, d)
                    media.clusters.append((time, a - base))
                elif k == SIMPLE:
                    held.append((c, d, None, None))
                elif k == GROUP:
                    own = {x: (y, z) for x, y, z in children(data, c, d)}
                    length = _uint(data, *own[GROUP_TIME]) if GROUP_TIME in own else None
                    held.append((*own[BLOCK], 0xFB not in own, length))
            for c, d, key, length in held:
                track, at = read_size(data, c)
                shift, flags = struct.unpack_from(">hB", data, at)
                frames = laced(data, at + 3, d, flags >> 1 & 3)
                each = (length or 0) * media.scale // len(frames)
                if not each and (t := media.tracks.get(track)) and t["codec"].startswith("A_PCM") and t["rate"] and t["bits"]:
                    each = None
                at_ns = (time + shift) * media.scale
                for offset, size in frames:
                    media.packets.append((track, at_ns, offset, size, bool(flags & 0x80) if key is None else key, blocks))
                    at_ns += round(size * 8 / t["bits"] / t["rate"] * 1e9) if each is None else each
                blocks += 1
        elif name == CUES:
            for k, c, d in children(data, a, b):
                if k == POINT:
                    own = list(children(data, c, d))
                    when = next(_uint(data, y, z) for x, y, z in own if x == CUE_TIME)
                    for x, y, z in own:
                        if x == POSITIONS:
                            at = {p: _uint(data, q, r) for p, q, r in children(data, y, z) if p in (CUE_TRACK, CUE_AT)}
                            media.cues.append((when, at[CUE_TRACK], at[CUE_AT]))
    return media


def samples(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(data[a : a + n] for t, _, a, n, _, _ in media.packets if t == track)


def features(media: Media, payload: bytes) -> str:
    """What the packet table and the samples show, as text."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    counts = np.bincount(x, minlength=256) / len(x)
    entropy = -float(np.sum(counts[counts > 0] * np.log2(counts[counts > 0])))
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    last = max(p[1] for p in media.packets) // 1_000_000
    return f"packets={len(media.packets)};blocks={media.packets[-1][5] + 1};clusters={len(media.clusters)};cues={len(media.cues)};last_ms={last};duration_ms={media.duration:.0f};mean={x.mean():.4f};deviation={x.std():.4f};entropy={entropy:.4f};crossings={crossings}"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, media (binary) and n_bytes of every document."""

    def run(parts) -> Iterator[dict]:
        for part in parts:
            raw = [t.encode() for t in texts(part)]
            yield {"doc_id": part["doc_id"], "n_bytes": [len(x) for x in raw], "media": [write(payload_of(x)) for x in raw]}

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_bytes long, media binary")


def packets(media: DataFrame) -> DataFrame:
    """The packet table of a column ``media``: doc_id, packet, track, timestamp_ns, start, size, keyframe, block."""

    def run(parts) -> Iterator[dict]:
        for part in parts:
            for doc, data in zip(part["doc_id"].to_pylist(), part["media"].to_pylist(), strict=True):
                found = read(data).packets
                columns = dict(zip(("track", "timestamp_ns", "start", "size", "keyframe", "block"), zip(*found, strict=True), strict=True))
                yield {"doc_id": [doc] * len(found), "packet": range(len(found)), **columns}

    return map_slices(media.select("doc_id", "media"), run, "doc_id long, packet int, track int, timestamp_ns long, start long, size long, keyframe boolean, block int", "media")


def digest(media: DataFrame) -> DataFrame:
    """What the stored files hold, one row per document."""

    def run(parts) -> Iterator[dict]:
        for part in parts:
            files = part["media"].to_pylist()
            parsed = [read(x) for x in files]
            held = [samples(x, m) for x, m in zip(files, parsed, strict=True)]
            yield {
                "doc_id": part["doc_id"],
                "n_bytes": part["n_bytes"],
                "payload_bytes": [len(x) for x in held],
                "payload_sha256": [hashlib.sha256(x).hexdigest() for x in held],
                "tail_crc32": [zlib.crc32(x[-32:]) for x in held],
                "media_bytes": [len(x) for x in files],
                "media_sha256": [hashlib.sha256(x).hexdigest() for x in files],
                "feature": [features(m, x) for m, x in zip(parsed, held, strict=True)],
            }

    return map_slices(media, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", "media")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(store(table(spark, sf_dir, "documents")))
