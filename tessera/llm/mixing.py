"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

Every document has a 60-bit hash. A source whose target is ``k`` times its size and a rest takes
each document ``k`` times, and once more those whose hash lies below the source's threshold. The
threshold is found without sorting: words are summed by source and hash bucket, the bucket in
which the running sum passes the budget is split into finer buckets, and so on down to single
hashes. Thresholds are nested: a larger budget takes a superset.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; a
source of size 0 has target 0; rows that are equal in doc_id and text share a hash and are taken
together; texts of any length count whole; an empty table gives an empty mix. :func:`mix` returns the
columns of ``docs`` as they are, whatever their names; :func:`mix_table` reads doc_id, source and text only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.batches import fresh, named
from tessera.storage import table, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Bits of the hash that are dropped at each level: 4,096 buckets, again in the boundary bucket, then single hashes, of one in 16 million rows.
SHIFTS = (48, 36, 0)


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(doc_id, text) -> F.Column:
    """60 bits that depend on the row only."""
    digest = F.md5(F.concat_ws(":", doc_id.cast("string"), F.md5(text)))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> with target. Water-filling: with sources ordered by cap over weight,
    a source is at its cap if the level that the rest of the budget gives to those from it on reaches its cap."""
    ranked = W.orderBy(F.col("source").asc_nulls_last())
    by_cap = W.orderBy("full_at", "pos")
    weight = F.array(*(F.lit(float(x)) for x in weights))
    one = sizes.withColumn("pos", F.row_number().over(ranked) - 1)
    one = one.withColumn("weight", F.get(weight, F.col("pos") % len(weights))).withColumn("full_at", float(most) * F.col("source_size") / F.col("weight"))
    one = one.withColumn("budget", share * F.sum("source_size").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    before = F.coalesce(F.sum(float(most) * F.col("source_size")).over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing))
    one = one.withColumn("level", (F.col("budget") - before) / rest)
    free = F.when(F.col("full_at") > F.col("level"), F.struct("full_at", "pos", "level"))
    one = one.withColumn("free", F.min(free).over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    full = float(most) * F.col("source_size")
    return one.select("source", "source_size", F.least(full, F.coalesce(F.col("free.level") * F.col("weight"), full)).alias("target"))


def thresholds(rows: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """rows: (source, size, h). One row per source: source_size, target, copies of all, and the hash below which one more copy is taken."""
    aims = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aims = aims.withColumn("copies", whole).withColumn("left", F.col("target") - F.col("copies") * F.col("source_size"))
    aims = written(aims.withColumn("edge", F.lit(0).cast("long")), "mix-targets")
    prior = 60
    for shift in SHIFTS:
        own = aims.select(F.col("source").alias("of"), "left", "edge")
        inside = rows.join(own, F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("h", prior) == F.col("edge")))
        if 0 < shift < SHIFTS[0]:  # the next level reads the boundary buckets only
            rows = written(inside.select("source", "size", "h"), "mix-boundary")
            inside = rows.join(own, F.col("source").eqNullSafe(F.col("of")))
        sums = inside.groupBy("source", "left", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        running = F.sum("words").over(W.partitionBy("source").orderBy("bucket"))
        passed = sums.withColumn("running", running).groupBy("source").agg(
            F.min(F.when(F.col("running") > F.col("left"), F.col("bucket"))).alias("next"),
            F.sum(F.when(F.col("running") <= F.col("left"), F.col("words")).otherwise(0)).alias("spent"),
        )
        passed = passed.select(F.col("source").alias("at"), "next", "spent")
        aims = aims.join(passed, F.col("source").eqNullSafe(F.col("at")), "left").select(
            "source", "source_size", "target", "copies",
            (F.col("left") - F.coalesce("spent", F.lit(0))).alias("left"),
            # past the last bucket of the one before, if the budget takes it all
            F.coalesce("next", F.shiftleft(F.col("edge") + 1, prior - shift)).alias("edge"),
        )
        aims, prior = written(aims, "mix-edges"), shift
    return aims.withColumnRenamed("edge", "threshold")


def _dealt(rows: DataFrame, aims: DataFrame) -> DataFrame:
    own = aims.select(F.col("source").alias("of"), "source_size", "target", F.col("copies").alias("whole"), "threshold")
    copies = F.col("whole") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)
    return rows.join(own, F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", copies).drop("of", "whole", "threshold")


def mix_table(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document. The texts are read once."""
    rows = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("h")), "mix-rows")
    return _dealt(rows, thresholds(rows, weights, share, most)).drop("h").withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """The mixed documents themselves: each row as often as it is taken, with the columns of ``docs``."""
    rows = written(docs.select("source", word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("h")), "mix-rows")
    of, whole, below, copy = fresh(docs, "of", "whole", "below", "copy")
    own = thresholds(rows, weights, share, most).select(F.col("source").alias(of), F.col("copies").alias(whole), F.col("threshold").alias(below))
    kept = docs.join(own, F.col("source").eqNullSafe(F.col(of)))
    copies = F.col(whole) + F.when(row_hash(F.col("doc_id"), F.col("text")) < F.col(below), 1).otherwise(0)
    return kept.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*map(named, docs.columns))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_table(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           ('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, md5(text))), 1, 15))::BIGINT AS h
    FROM documents),
s AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos
    FROM d GROUP BY source),
w AS (
    SELECT *, (CASE pos % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS weight FROM s),
r AS (
    SELECT *, 2.0::DOUBLE * source_size / weight AS full_at, 1.5::DOUBLE * (SELECT sum(size)::BIGINT FROM d) AS budget FROM w),
l AS (
    SELECT *, (budget - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY full_at, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
           / sum(weight) OVER (ORDER BY full_at, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM r),
f AS (SELECT level FROM l WHERE full_at > level ORDER BY full_at, pos LIMIT 1),
t AS (
    SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce((SELECT level FROM f) * weight, 2.0::DOUBLE * source_size)) AS target FROM l),
b AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
x AS (
    SELECT d.doc_id, d.size, b.source_size, b.target, b.copies,
           sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE UNBOUNDED PRECEDING) AS running
    FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN running <= target - copies * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM x
"""
