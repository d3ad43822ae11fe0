"""What both classifiers share: which labelled rows they learn from, and scoring of all documents.

A model is fitted on the driver on at most about ``SAMPLE`` labelled rows. Of the rows whose
crc32(doc_id as text) mod 3 is not 1, those are taken whose hash lies below the share that gives this
number; below ``SAMPLE`` labelled rows all are. Every document is scored. Features go to the driver,
2^BITS weights go back: both are bounded.

Defined cases: doc_ids that carry both labels are left out of the learning; a null doc_id is not held
out and never learnt from; without rows of both classes every score is the share of ones, or 0.5
without any row; a null text is empty and is scored by the intercept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import map_slices, texts
from tessera.llm.textkit import sums_by

BITS = 20
#: Bytes of text whose features are sought at a time: some twenty arrays of eight bytes for each.
FEATURED = 1 << 19
#: Labelled rows that a model is fitted on, at most (in expectation).
SAMPLE = 8_000

Features = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of the rows that may be learnt from."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out(F.col("doc_id")))
    one = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(column).alias("label"), F.max(column).alias("most"))
    return one.where("label = most").select("doc_id", F.col("label").cast("int").alias("label"))


def sampled(docs: DataFrame, labels: DataFrame, column: str, most: int = SAMPLE) -> DataFrame:
    """(doc_id, text, label) of a bounded number of labelled documents, whichever rows come first."""
    known = labelled(labels, column)
    share = min(1.0, most / max(1, known.count()))
    below = int(share * (1 << 20))
    inside = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < below
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(inside)
    return own.join(known.where(inside), "doc_id")


def gathered(rows: DataFrame, features: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, labels, features and starts of the rows, in order of doc_id."""

    def run(parts) -> Iterator[dict]:
        for part in parts:
            found, starts = features(texts(part))
            yield {"doc_id": part["doc_id"], "label": part["label"], "found": [found[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]}

    got = sorted(map_slices(rows.select("doc_id", "text", "label"), run, "doc_id long, label int, found binary", most=FEATURED).toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["found"]))
    own = [np.frombuffer(r["found"], np.int32) for r in got]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
    return np.array([r["doc_id"] for r in got], np.int64), np.array([r["label"] for r in got], np.int8), np.concatenate(own or [np.zeros(0, np.int32)]), starts


def norms(starts: np.ndarray, power: float = 0.5) -> np.ndarray:
    """1 over the root (or another power) of each text's number of features."""
    return np.maximum(1.0, np.diff(starts)) ** -power


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def platt(f: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(a, b) so that sigmoid(a f + b) fits the labels, by Newton steps on smoothed targets."""
    pos = int(y.sum())
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * f + b)
        g = np.array([((p - t) * f).sum(), (p - t).sum()]) + 1e-6 * np.array([a, b])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * f * f).sum() + 1e-6, (s * f).sum()], [(s * f).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def rows_of(keep: np.ndarray, found: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and starts of the chosen texts."""
    lengths = np.diff(starts)[keep]
    inside = np.repeat(keep, np.diff(starts))
    return found[inside], np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def constant(labels: np.ndarray) -> float | None:
    """The score of all documents if there is nothing to learn from."""
    if not len(labels):
        return 0.5
    return float(labels.mean()) if labels.min() == labels.max() else None


def scored(docs: DataFrame, features: Features, model: dict, at: float) -> DataFrame:
    """doc_id, held_out, score and predicted of every document. model: weights, bias, power, scale, shift or constant."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts) -> Iterator[dict]:
        for part in parts:
            score = score_texts(texts(part), features, held.value)
            yield {"doc_id": part["doc_id"], "held_out": part["held_out"], "score": score, "predicted": (score >= at).astype(np.int32)}

    own = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_slices(own, run, "doc_id long, held_out boolean, score double, predicted int", most=FEATURED)


def score_texts(own: list[str], features: Features, model: dict) -> np.ndarray:
    if model["constant"] is not None:
        return np.full(len(own), model["constant"])
    found, starts = features(own)
    f = sums_by(model["weights"][found], starts) * norms(starts, model["power"]) + model["bias"]
    return sigmoid(model["scale"] * f + model["shift"])


def kept(docs: DataFrame, features: Features, model: dict, at: float) -> DataFrame:
    """The documents that score ``at`` or more, with all their columns."""
    held, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(parts) -> Iterator[dict]:
        for part in parts:
            stay = score_texts(texts(part), features, held.value) >= at
            chosen = part.filter(stay.tolist()) if len(stay) else part
            yield {n: chosen[i] for i, n in enumerate(names)}

    return map_slices(docs, run, docs.schema, most=FEATURED)
