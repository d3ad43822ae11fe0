"""Quality by naive Bayes support vectors.

Indicators of n-grams (words, pairs of words, three bytes, and one to three word shapes) are scaled by
the log ratio of their smoothed shares in the two classes, and a linear hinge-loss model is fitted on
them by dual coordinate descent. A fifth of the learning rows, by hash of doc_id, is left out of a first
fit and turns margins into scores; the final fit takes all. See ``learning`` for the rows learnt from and
for defined cases.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import learning
from tessera.llm.learning import BITS
from tessera.llm.textkit import SPACE, Block, U, indicators, mix, ngrams
from tessera.storage import table

#: Smoothing of the class shares, bound of a dual variable, passes over the rows, and the score from which a document is good.
ALPHA, C, PASSES, GOOD = 1.0, 1.0, 8, 0.5

_CLASSES = np.zeros(256, np.int64)  # of bytes: 1 upper, 2 lower and letters beyond ASCII, 4 digits, 8 other signs
_CLASSES[0x41:0x5B], _CLASSES[0x61:0x7B], _CLASSES[0x30:0x3A], _CLASSES[0x80:] = 1, 2, 4, 2
_CLASSES[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = 8


def features(own: list[str]) -> tuple[np.ndarray, np.ndarray]:
    block = Block([t.encode("utf-8", "surrogatepass") for t in own])
    block.prepare()
    starts, ends = block.runs(~SPACE)
    words, of = block.hashes(starts, ends), block.owner(starts)
    shape, kinds = np.zeros(len(words), U), _CLASSES[block.data]
    for k in (1, 2, 4, 8):
        counts = np.concatenate([[0], np.cumsum(kinds == k)])
        inside = counts[ends] - counts[starts]
        shape = shape * U(3) + np.minimum(inside, 2).astype(U)
    if len(words):
        same = np.zeros(len(words), U)
        same[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
        shape = shape * U(2) + same
    shape = mix(shape + U(0x51A9E))
    data = block.data.astype(U)
    three = data[:-2] | data[1:-1] << U(8) | data[2:] << U(16) if len(data) > 2 else np.zeros(0, U)
    after = np.append(block.first[1:], len(data)) if block.n else block.first
    at = np.repeat(np.arange(block.n), after - block.first)[: len(three)]
    own = np.ones(len(three) + 2, bool)  # the space behind a text is its own, what follows is not
    own[after - 1] = own[after - 2] = False
    own = own[: len(three)]
    parts = [(mix(three[own] + U(0x3B00000000)), at[own]), (words, of), ngrams(words, of, 2), (shape, of), ngrams(shape, of, 2), ngrams(shape, of, 3)]
    return indicators(parts, block.n, BITS)


def log_ratios(y: np.ndarray, found: np.ndarray, starts: np.ndarray, bits: int = BITS) -> np.ndarray:
    of = np.repeat(y, np.diff(starts))
    share = []
    for k in (1, 0):
        counts = np.bincount(found[of == k], minlength=1 << bits)
        share.append((ALPHA + counts) / (2 * ALPHA + (y == k).sum()))
    seen = np.bincount(found, minlength=1 << bits) > 0
    return np.where(seen, np.log(share[0] / share[1]), 0.0)


def dual_descent(y: np.ndarray, found: np.ndarray, starts: np.ndarray, ratio: np.ndarray, c: float = C, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise |w|^2 / 2 + sum of c_i max(0, 1 - y_i f(x_i)); both classes weigh the same."""
    sign = np.where(y == 1, 1.0, -1.0)
    bound = np.where(y == 1, c * len(y) / (2 * (y == 1).sum()), c * len(y) / (2 * (y == 0).sum()))
    rows = [found[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    values = [ratio[r] * n for r, n in zip(rows, learning.norms(starts), strict=True)]
    square = np.array([v @ v for v in values]) + 1.0  # the intercept is a feature of value 1
    w, bias, dual = np.zeros(len(ratio)), 0.0, np.zeros(len(y))
    random = np.random.Generator(np.random.PCG64(7))
    for _ in range(passes):
        for i in random.permutation(len(y)):
            gap = sign[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(dual[i] - gap / square[i], 0.0), bound[i])
            if (step := (new - dual[i]) * sign[i]) != 0.0:
                w[rows[i]] += step * values[i]
                bias += step
                dual[i] = new
    return w * ratio, bias


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = learning.SAMPLE) -> dict:
    ids, y, found, starts = learning.gathered(learning.sampled(docs, labels, column, most), features)
    if (all_same := learning.constant(y)) is not None:
        return {"constant": all_same}
    check = mix(ids.astype(U)) % U(5) == 0
    scale, shift = 2.0, 0.0
    if all(len(set(y[m].tolist())) == 2 for m in (check, ~check)):
        f, s = learning.rows_of(~check, found, starts)
        w, b = dual_descent(y[~check], f, s, log_ratios(y[~check], f, s))
        f, s = learning.rows_of(check, found, starts)
        scale, shift = learning.platt(learning.sums_by(w[f], s) * learning.norms(s) + b, y[check])
    w, b = dual_descent(y, found, starts, log_ratios(y, found, starts))
    return {"constant": None, "weights": w.astype(np.float32), "bias": b, "power": 0.5, "scale": scale, "shift": shift}


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps."""
    return learning.kept(docs, features, fit(docs, labels), GOOD)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return learning.scored(docs, features, fit(docs, table(spark, sf_dir, "labels")), GOOD)
