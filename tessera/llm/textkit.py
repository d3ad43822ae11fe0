"""Many texts at once as arrays: runs of bytes, their hashes, shingles and features.

Texts of a slice are joined to one byte array with a space after each; hashes of any run of bytes come
from a running sum, so there is no loop over words. All hashes depend on content only: they agree
between workers, runs and machines.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(0, 1 << 64, 256, dtype=U)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, U), np.ones(1, U)]

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[0x41:0x5B] += 0x20


#: Powers that a worker keeps; more, for a longer block, go with it.
KEPT = 1 << 20


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    made = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(max(n, 1 << 16), b, U)
        x[0] = 1
        made.append(np.cumprod(x, dtype=U))
    if n <= KEPT:
        _powers[:] = made
    return made[0][:n], made[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Block:
    def __init__(self, raw: list[bytes]):
        self.n = len(raw)
        self.data = np.frombuffer(b" ".join([*raw, b""]) if raw else b"", np.uint8)
        lengths = np.fromiter((len(x) for x in raw), np.int64, len(raw)) + 1
        self.first = np.concatenate([[0], np.cumsum(lengths)])[:-1].astype(np.int64)

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes for which the table holds."""
        change = np.diff(inside[self.data].view(np.int8), prepend=np.int8(0), append=np.int8(0))
        return np.flatnonzero(change == 1), np.flatnonzero(change == -1)

    def prepare(self, lower: bool = False) -> None:
        data = LOWERED[self.data] if lower else self.data
        power, self.inverse = _power(len(data) + 1)
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(_BYTE[data] * power[: len(data)], dtype=U)])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the runs [start, end)."""
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(U))

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The text in which each position lies."""
        return np.searchsorted(self.first, at, side="right") - 1


def ngrams(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n neighbouring words of a text, and their texts."""
    if len(words) < n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    m = len(words) - n + 1
    out = np.zeros(m, U)
    for k in range(n):
        out = (out + words[k : k + m]) * U(0xD1342543DE82EF95) + U(n)
    whole = owner[:m] == owner[n - 1 :]
    return mix(out[whole]), owner[:m][whole]


def shingles(raw: list[bytes], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of n words, sorted within each text, and where each text's begin (one more at the end).

    Words lie between white space and have ASCII letters lowered. A text of 1 to n - 1 words is one
    shingle; a text without words has none.
    """
    block = Block(raw)
    block.prepare(lower=True)
    starts, ends = block.runs(~SPACE)
    words, owner = block.hashes(starts, ends), block.owner(starts)
    counts = np.bincount(owner, minlength=block.n) if len(owner) else np.zeros(block.n, np.int64)
    found, of = ngrams(words, owner, n)
    for k in range(1, n):  # the short texts
        if (few := np.flatnonzero(counts == k)).size:
            own = np.isin(owner, few)
            h, o = ngrams(words[own], owner[own], k)
            found, of = np.concatenate([found, h]), np.concatenate([of, o])
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    if len(found):
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
        found, of = found[new], of[new]
    return found, np.searchsorted(of, np.arange(block.n + 1))


def indicators(parts: list[tuple[np.ndarray, np.ndarray]], n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features (hash, text) to distinct (feature, start of each text's), features below 2^bits."""
    keys = np.concatenate([(of.astype(U) << U(bits)) | (h >> U(64 - bits)) for h, of in parts] or [np.zeros(0, U)])
    keys = np.sort(keys)
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    starts = np.searchsorted(keys, np.arange(n + 1, dtype=U) << U(bits))
    return (keys & U((1 << bits) - 1)).astype(np.int32), starts


def sums_by(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of each text's values, the same wherever the text stands among others."""
    out, full = np.zeros(len(starts) - 1), np.flatnonzero(np.diff(starts))
    if len(full):
        out[full] = np.add.reduceat(values.astype(np.float64), starts[full])
    return out
