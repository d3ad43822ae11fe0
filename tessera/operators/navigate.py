"""Lookups: outline, definitions, references (single and qualified), slices, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.storage import handy


def outline(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.where(F.col("path") == path).orderBy("line", "name")


def defs(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.where(F.col("name") == name).orderBy("path", "line")


def qualified(name: str) -> list[str]:
    return [p for p in name.split(".") if p]


def refs(idents: DataFrame, name: str) -> DataFrame:
    """path and score of the files that reference all parts of a name: the least of the parts' counts. Parts are
    counted as given, so a name that repeats a part has no result."""
    parts = qualified(name)
    found = idents.where(F.col("name").isin(*parts)) if parts else idents.where("false")
    if len(parts) <= 1:
        return found.select("path", F.col("count").alias("score")).orderBy(F.desc("score"), "path")
    scored = found.groupBy("path").agg(F.min("count").alias("score"), F.count_distinct("name").alias("parts"))
    return scored.where(F.col("parts") == len(parts)).select("path", "score").orderBy(F.desc("score"), "path")


def refs_elsewhere(idents: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """References outside the files that define the last part."""
    own = symbols.where(F.col("name") == (qualified(name) or [""])[-1]).select("path").distinct()
    return refs(idents, name).join(own, "path", "left_anti")


def referenced_defined(idents: DataFrame, symbols: DataFrame) -> DataFrame:
    return idents.join(handy(symbols.select("name").distinct(), "defined"), "name", "left_semi")


def covering(symbols: DataFrame, name: str) -> DataFrame:
    """Of one file's symbols those that a slice shows: target says whether with the body. A symbol within a target
    that is shown before is left out; a fold over the file's symbols in order decides it."""
    row = F.struct("line", "seq", "end_line", (F.col("name") == name).alias("target"), "name", "kind", "signature")
    rows = symbols.groupBy("path").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    kind = "struct<until:int,shown:array<struct<line:int,seq:int,end_line:int,target:boolean,name:string,kind:string,signature:string>>>"
    start = F.struct(F.lit(0).alias("until"), F.array().alias("shown")).cast(kind)

    def step(s, x):
        new = F.struct(F.when(x["target"], x["end_line"]).otherwise(s["until"]).alias("until"), F.array_append(s["shown"], x).alias("shown")).cast(kind)
        return F.when(x["line"] <= s["until"], s).otherwise(new)

    folded = rows.select("path", F.aggregate("rows", start, step).alias("s"))
    return folded.select("path", F.explode("s.shown").alias("x")).select("path", "x.*")


def slice_view(lines: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """lines: (path, line, content). The bodies of the symbols of a name and the signatures of the others: path, line, kind, content."""
    shown = covering(symbols, name)
    with_target = shown.where("target").select("path").distinct()
    target = shown.where("target").select("path", F.col("line").alias("a"), F.col("end_line").alias("b"))
    body = lines.join(target, "path").where("line between a and b").select("path", "line", F.lit("body").alias("part"), F.format_string("%5d: %s", "line", "content").alias("shown"))
    other = shown.where("not target").join(with_target, "path", "left_semi")
    skeleton = other.select("path", "line", F.lit("skeleton").alias("part"), F.format_string("%5d-%-5d [%s] %s ...", "line", "end_line", "kind", "signature").alias("shown"))
    return body.unionByName(skeleton)


def stats(files: DataFrame, symbols: DataFrame, idents: DataFrame) -> DataFrame:
    rows = [t.agg(F.count("*").alias("n")).select(F.lit(n).alias("what"), "n") for n, t in (("files", files), ("symbols", symbols), ("idents", idents))]
    langs = files.groupBy("lang").agg(F.count("*").alias("n")).select(F.concat(F.lit("lang:"), "lang").alias("what"), "n")
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(langs)


def outline_text(symbols: DataFrame) -> DataFrame:
    return symbols.select("path", "line", F.format_string("%5d-%-5d [%s] %s", "line", "end_line", "kind", "signature").alias("shown"))


def token_costs(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """files: (path, text). What an outline costs against the whole file, in estimated tokens."""
    whole = files.select("path", X.token_estimate(F.col("text")).cast("long").alias("whole_tokens"))
    tool = outline_text(symbols).groupBy("path").agg(F.sum(X.token_estimate(F.concat("shown", F.lit("\n")))).alias("outline_tokens"))
    return whole.join(tool, "path", "left").select("path", "whole_tokens", F.coalesce("outline_tokens", F.lit(0)).cast("long").alias("outline_tokens"))


def most_used(symbols: DataFrame, uses: DataFrame, most: int = 8) -> DataFrame:
    ranked = symbols.join(uses, "name", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    rank = F.row_number().over(W.partitionBy("path").orderBy(F.desc("uses"), "line", "name"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= most)
