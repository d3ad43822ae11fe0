"""Who depends on changed files, by names that those define."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.navigate import most_used
from tessera.operators.rankmap import within
from tessera.schema import IMPACT_BUDGET
from tessera.storage import handy


def changed_since(files: DataFrame, now: float, hours: float) -> DataFrame:
    return files.where(F.col("mtime") >= now - hours * 3600).select("path").orderBy("path")


def uses(changed: DataFrame, symbols: DataFrame, idents: DataFrame) -> DataFrame:
    """path, name, count: references from outside the changed files to names that those define."""
    changed = handy(changed.distinct(), "changed")
    names = handy(symbols.join(changed, "path", "left_semi").select("name").distinct(), "changed-names")
    return idents.join(names, "name", "left_semi").join(changed, "path", "left_anti")


def dependents(changed: DataFrame, symbols: DataFrame, idents: DataFrame, tests_only: bool = False, top: int = 4) -> DataFrame:
    """path, total and the names used most, as text, of each file outside that uses the changed ones."""
    found = uses(changed, symbols, idents)
    found = found.where(X.is_test_path(F.col("path"))) if tests_only else found
    rank = F.row_number().over(W.partitionBy("path").orderBy(F.desc("count"), "name"))
    ranked = found.withColumn("rank", rank)
    best = F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", F.format_string("%s (%dx)", "name", "count").alias("shown")))))
    return ranked.groupBy("path").agg(F.sum("count").alias("total"), F.array_join(F.transform(best, lambda x: x["shown"]), ", ").alias("used"))


def changed_symbols(changed: DataFrame, symbols: DataFrame, idents: DataFrame, most: int = 8) -> DataFrame:
    """The changed files' symbols that others use most. Uses are counted over all files, also where only tests are asked for."""
    total = uses(changed, symbols, idents).groupBy("name").agg(F.sum("count").alias("uses"))
    own = symbols.join(handy(changed.distinct(), "changed"), "path", "left_semi")
    return most_used(own, total, most).select("path", "line", "name", "signature", "uses", "rank")


def within_budget(listed: DataFrame, budget: int = IMPACT_BUDGET) -> DataFrame:
    """Lines of :func:`changed_symbols` that fit the budget, in order of path and rank."""
    note = F.when(F.col("uses") > 0, F.format_string("   <- used by others %dx", "uses")).otherwise("")
    rows = listed.withColumn("shown", F.concat(F.format_string("%5d: %s", "line", "signature"), note))
    return within(rows.withColumn("cost", X.token_estimate(F.concat("shown", F.lit("\n")))), "cost", ["path", "rank"], budget).select("path", "rank", "shown", "used")
