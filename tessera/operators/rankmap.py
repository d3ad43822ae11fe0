"""A map of the best definitions within a budget of tokens."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.schema import MAP_BUDGET, ROWS_PER_IDENT
from tessera.storage import written

#: Best definitions that are joined with their symbols by a broadcast.
MOST_BEST = 1_000_000


def within(rows: DataFrame, cost: str, order: list, budget: int) -> DataFrame:
    """The longest prefix whose costs stay within the budget. Each cost is one at least, so no more than ``budget``
    rows reach the window that needs them in one task."""
    few = rows.orderBy(*order).limit(max(0, budget))
    running = F.sum(cost).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return few.withColumn("used", running).where(F.col("used") <= budget)


def _placed(ranked: DataFrame, symbols: DataFrame, order: list) -> DataFrame:
    place = F.row_number().over(W.partitionBy("path", "name").orderBy("line", "signature"))
    rows = ranked.join(symbols.select("path", "name", "line", "signature"), ["path", "name"]).withColumn("place", place).where(F.col("place") <= ROWS_PER_IDENT)
    first = F.row_number().over(W.partitionBy("path", "line").orderBy(*order))
    return rows.withColumn("first", first).where("first = 1").drop("first")


def _best(ranked: DataFrame, symbols: DataFrame, order: list, budget: int) -> DataFrame:
    """All rows that can be shown, at least: those of the best definitions, which come before all others' and hide
    none of them, if they are ``budget`` rows; of more definitions otherwise, and of all in the end."""
    few = max(1, 2 * budget)
    while few <= MOST_BEST:
        best = written(ranked.orderBy(F.desc("score"), "path", "name").limit(few), "map-best")
        own = symbols.join(F.broadcast(best.select("path", "name").distinct()), ["path", "name"], "left_semi")
        rows = written(_placed(best, own, order), "map-rows")
        if rows.count() >= budget or best.count() < few:
            return rows
        few *= 16
    return _placed(ranked, symbols, order)


def select(ranked: DataFrame, symbols: DataFrame, budget: int = MAP_BUDGET, focus: Iterable[str] = ()) -> DataFrame:
    """ranked: (path, name, score). symbols: (path, name, line, signature, ...). path, name, line, shown, score, file_score and used of what the map shows.

    Of a name at most three rows count, before rows on the same line fall together; the first row of a file pays for its header."""
    focus = list(focus)
    ranked = ranked.where(~F.col("path").isin(*focus)) if focus else ranked
    order = [F.desc("score"), "path", "name", "place"]
    rows = _best(ranked, symbols, order, budget)
    shown = F.format_string("%5d: %s", "line", "signature")
    rows = rows.withColumn("shown", shown).withColumn("head", F.row_number().over(W.partitionBy("path").orderBy(*order)) == 1)
    cost = X.token_estimate(F.concat("shown", F.lit("\n"))) + F.when(F.col("head"), X.token_estimate(F.concat(F.lit("\n"), "path", F.lit(":\n")))).otherwise(0)
    kept = within(rows.withColumn("cost", cost), "cost", order, budget)
    return kept.withColumn("file_score", F.sum("score").over(W.partitionBy("path"))).select("path", "name", "line", "shown", "score", "file_score", "used")


def render(rows: list) -> str:
    """Rows of :func:`select`, bounded by the budget, as text."""
    if not rows:
        return "(no ranked definitions)"
    out, last = [], None
    for r in sorted(rows, key=lambda r: (-r["file_score"], r["path"], r["line"])):
        if r["path"] != last:
            out += [""] * (last is not None) + [f"{r['path']}:"]
            last = r["path"]
        out.append(r["shown"])
    return "\n".join(out) + "\n"
