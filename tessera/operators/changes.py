"""What changed between two states of a corpus, and tables brought up to date by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X


def diff(known: DataFrame, seen: DataFrame, verify: bool = False) -> DataFrame:
    """known, seen: (path, sha, mtime, size). path and status: added, updated, touched, unchanged or removed.
    Without ``verify`` equal times and sizes pass for equal content."""
    k = known.select("path", F.col("sha").alias("old_sha"), F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"), F.lit(1).alias("was"))
    s = seen.select("path", "sha", "mtime", "size", F.lit(1).alias("now"))
    same = (F.col("mtime") == F.col("old_mtime")) & (F.col("size") == F.col("old_size"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed")
    status = status if verify else status.when(same, "unchanged")
    status = status.when(F.col("sha") != F.col("old_sha"), "updated").when(same, "unchanged").otherwise("touched")
    return k.join(s, "path", "full_outer").select("path", status.alias("status"))


def counters(changes: DataFrame) -> DataFrame:
    one = lambda *s: F.count_if(F.col("status").isin(*s))
    return changes.agg(one("added").alias("added"), one("updated").alias("updated"), one("removed").alias("removed"), one("unchanged", "touched").alias("unchanged"))


def upsert(old: DataFrame, new: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    """Rows of ``old`` but for the keys of ``gone`` and ``new``, and the rows of ``new``."""
    replaced = gone.select(key).unionByName(new.select(key)).distinct()
    return old.join(replaced, key, "left_anti").unionByName(new)


def state_stamp(files: DataFrame) -> DataFrame:
    """One row: a digest of all paths and contents. Digests of files are summed by ranges of paths, so no row holds them all."""
    own = files.select(F.sha2(F.concat("path", F.lit("\0"), "sha"), 256).alias("d"))
    parts = [F.conv(F.substring("d", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = own.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(p), F.lit(0).cast("decimal(38,0)")).cast("string").alias(f"p{i}") for i, p in enumerate(parts)))
    return sums.select(X.sha16(F.concat_ws(":", F.col("n").cast("string"), "p0", "p1", "p2", "p3")).alias("stamp"))
