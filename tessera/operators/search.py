"""Search over symbols: BM25 on a postings table, cosine, reciprocal rank fusion."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.schema import IDENT, K1, NAME_BOOST, POOL, RRF_K, STOPWORDS, SUBTOKEN, TEST_DEMOTION, B

_STOP = frozenset(STOPWORDS)
MODES = ("auto", "hybrid", "bm25", "vector")


def query_tokens(query: str) -> list[str]:
    """The words of a query as :func:`tessera.functions.text.tokenize` cuts them, or its blank-separated words if it has none."""
    out = []
    for ident in re.findall(IDENT, query):
        if ident.lower() not in _STOP:
            parts = [p.lower() for p in re.findall(SUBTOKEN, ident)]
            out += [ident.lower()] + ([p for p in parts if len(p) > 1 and p not in _STOP] if len(parts) > 1 else [])
    return out or [w.lower() for w in query.split()]


def documents(symbols: DataFrame) -> DataFrame:
    """path, line, name, dl and words of each symbol: one pass over the symbols serves lengths, counts and postings."""
    words = X.symbol_doc(F.col("name"), F.col("kind"), F.col("signature"), F.col("path"))
    return symbols.select("path", "line", "name", words.alias("words")).select("path", "line", "name", F.size("words").alias("dl"), "words")


def postings(symbols: DataFrame) -> DataFrame:
    """path, line, name, dl (words of the symbol), term, tf: made once when symbols change, not for each query."""
    return posted(documents(symbols))


def posted(docs: DataFrame, terms: Iterable[str] | None = None) -> DataFrame:
    """:func:`postings` of :func:`documents`, of some terms or all."""
    words = F.col("words") if terms is None else F.filter("words", lambda w: w.isin(*terms))
    each = docs.select("path", "line", "name", "dl", F.explode(words).alias("term"))
    return each.groupBy("path", "line", "name", "dl", "term").agg(F.count("*").alias("tf"))


def bm25(posted: DataFrame, n: int, average: float, query: str, limit: int = POOL) -> DataFrame:
    """path, line, name and score (six decimals) of the best symbols. n, average: number and mean length of all."""
    tokens = query_tokens(query)
    times = Counter(tokens)
    hits = posted.where(F.col("term").isin(*times)) if times else posted.where("false")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in (times or {"": 0}).items() for x in kv)), F.col("term"))
    part = weight * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / average))
    scored = hits.join(df, "term").groupBy("path", "line", "name").agg(F.sum(part).alias("score"))
    boosted = F.when(F.lower("name").isin("".join(tokens), *times), F.col("score") * NAME_BOOST).otherwise(F.col("score"))
    return scored.withColumn("score", F.round(boosted, 6)).orderBy(F.desc("score"), "path", "line").limit(limit)


def size_of(docs: DataFrame) -> tuple[int, float]:
    """Number and mean length of :func:`documents`."""
    row = docs.agg(F.count("*"), F.avg("dl")).first()
    return row[0], row[1] or 1.0


def nearest(vectors: DataFrame, query: list[float], limit: int = POOL) -> DataFrame:
    """vectors: (path, line, vector). The most similar by inner product (cosine for unit vectors), six decimals."""
    score = F.round(X.dot(F.col("vector"), F.array(*(F.lit(float(x)) for x in query))), 6)
    return vectors.select("path", "line", score.alias("score")).orderBy(F.desc("score"), "path", "line").limit(limit)


def fuse(lists: list[DataFrame], limit: int = POOL) -> DataFrame:
    """Each list: (path, line, score), bounded by its own limit. path, line, score: sums of 1 / (60 + rank)."""
    ranked = []
    for one in lists:
        rank = F.row_number().over(W.orderBy(F.desc("score"), "path", "line"))
        ranked.append(one.select("path", "line", (1.0 / (RRF_K + rank)).alias("part")))
    both = ranked[0]
    for more in ranked[1:]:
        both = both.unionByName(more)
    return both.groupBy("path", "line").agg(F.round(F.sum("part"), 6).alias("score")).orderBy(F.desc("score"), "path", "line").limit(limit)


def polish(hits: DataFrame, symbols: DataFrame, limit: int = 10) -> DataFrame:
    """hits: (path, line, score). Tests weigh less, and of equal (name, kind, signature) the best stays."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    found = hits.select("path", "line", "score").join(symbols.select("path", "line", "name", "kind", "signature"), ["path", "line"])
    found = found.withColumn("score", F.round(F.col("score") * F.when(X.is_test_path(F.col("path")), TEST_DEMOTION).otherwise(1.0), 6))
    best = F.row_number().over(W.partitionBy("name", "kind", "signature").orderBy(F.desc("score"), "path", "line"))
    return found.withColumn("best", best).where("best = 1").drop("best").orderBy(F.desc("score"), "path", "line").limit(limit)


def missing_vectors(symbols: DataFrame, vectors: DataFrame) -> DataFrame:
    return symbols.join(vectors.select("path", "line"), ["path", "line"], "left_anti")


def mode_for(mode: str, has_vectors: bool) -> str:
    if mode not in MODES:
        raise ValueError(f"unknown search mode: {mode}")
    if mode == "auto":
        return "hybrid" if has_vectors else "bm25"
    return "bm25" if mode == "hybrid" and not has_vectors else mode
