"""Checks of an index against the corpus that it stands for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.changes import diff


def checks(known: DataFrame, seen: DataFrame, symbols: DataFrame, vectors: DataFrame) -> DataFrame:
    """name, status (ok, warn or fail) and number behind it, one row each, and the worst status as ``overall``."""
    status = lambda bad, level: F.when(bad, level).otherwise("ok").alias("status")
    changes = diff(known, seen, verify=True)
    rows = [
        changes.agg(F.count_if(F.col("status").isin("added", "updated")).alias("n")).select(F.lit("stale").alias("name"), status(F.col("n") > 0, "warn"), "n"),
        changes.agg(F.count_if(F.col("status") == "removed").alias("n")).select(F.lit("removed").alias("name"), status(F.col("n") > 0, "warn"), "n"),
        known.agg(F.count("*").alias("n")).select(F.lit("index").alias("name"), status(F.col("n") == 0, "fail"), "n"),
        symbols.agg(F.count("*").alias("n")).select(F.lit("symbols").alias("name"), status(F.col("n") == 0, "warn"), "n"),
        vectors.agg(F.count("*").alias("n")).select(F.lit("vectors").alias("name"), status(F.col("n") == 0, "warn"), "n"),
    ]
    found = reduce(DataFrame.unionByName, rows)
    level = F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0)
    worst = found.agg(F.max_by("status", level).alias("status"), F.count_if(F.col("status") != "ok").alias("n"))
    return found.unionByName(worst.select(F.lit("overall").alias("name"), "status", "n"))
