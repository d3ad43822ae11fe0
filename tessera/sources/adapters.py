"""Plain tables seen as the corpus model (files, symbols, idents), lazily and without any shuffle but for counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.schema import IDENT
from tessera.storage import table

#: Paths of several documents up to which only those documents' counts are added up.
MANY_PATHS = 100_000


def doc_path() -> F.Column:
    tests = F.when(F.col("doc_id") % 10 == 0, "tests/").otherwise("")
    return F.concat("source", F.lit("/"), "lang", F.lit("/"), tests, F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))


def doc_files(spark: SparkSession, sf: str) -> DataFrame:
    """path, sha, mtime, size, lang of documents; the text is read only if sha is wanted."""
    d = table(spark, sf, "documents")
    return d.select(doc_path().alias("path"), X.sha16(F.col("text")).alias("sha"), (F.lit(1.7e9) + F.col("doc_id") * 60).alias("mtime"), F.col("n_chars").alias("size"), "lang")


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    lines = d.select(doc_path().alias("path"), "lang", F.split("text", "\n").alias("lines"))
    return lines.select("path", "lang", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "content")).withColumn("line", F.col("pos") + 1).drop("pos")


def doc_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """A symbol for each line with an identifier: its first one, up to the line before the next symbol's."""
    named = doc_lines(spark, sf).withColumn("name", F.regexp_extract("content", IDENT, 0)).where("name <> ''")
    by = W.partitionBy("path").orderBy("line")
    end = F.coalesce(F.lead("line").over(by) - 1, F.col("n_lines"))
    return named.select("path", "name", F.col("lang").alias("kind"), "line", end.alias("end_line"), X.signature(F.col("content")).alias("signature"))


def doc_idents(spark: SparkSession, sf: str) -> DataFrame:
    """Counted within each document; only documents of one path, which are counted before, are added up by a shuffle."""
    docs = table(spark, sf, "documents").select(doc_path().alias("path"), "text")
    again = docs.groupBy("path").agg(F.count("*").alias("n")).where("n > 1 or path is null").select(F.col("path").alias("again"))
    many = again.limit(MANY_PATHS + 1).count()
    if not many:
        return _counted(docs)
    if many > MANY_PATHS:
        return _added(_counted(docs))
    again, same = F.broadcast(again), F.col("path").eqNullSafe(F.col("again"))
    return _counted(docs.join(again, same, "left_anti")).unionByName(_added(_counted(docs.join(again, same, "left_semi"))))


def _counted(docs: DataFrame) -> DataFrame:
    """path, name and count of each row of (path, text): the identifiers in order, of which runs are counted."""
    names = docs.select("path", F.sort_array(X.identifiers(F.col("text"))).alias("names"))
    last = F.transform("names", lambda x, i: F.when((i + 1 == F.size("names")) | (F.get("names", i + 1) != x), F.struct(x.alias("name"), (i + 1).alias("upto"))))
    ends = names.select("path", F.filter(last, lambda x: x.isNotNull()).alias("ends"))
    runs = F.transform("ends", lambda x, i: F.struct(x["name"].alias("name"), (x["upto"] - F.coalesce(F.get("ends", i - 1)["upto"], F.lit(0))).cast("long").alias("count")))
    return ends.select("path", F.inline(runs)).where(~X.stopword(F.lower("name")))


def _added(idents: DataFrame) -> DataFrame:
    return idents.groupBy("path", "name").agg(F.sum("count").alias("count"))


def line_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers define the parts that they have delivered; a row for each delivery."""
    li = table(spark, sf, "lineitem")
    return li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("path"), F.col("l_partkey").cast("string").alias("name"))


def line_definitions(spark: SparkSession, sf: str) -> DataFrame:
    return line_deliveries(spark, sf).distinct()


def line_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Customers reference the parts that they have ordered; a row for each order's line."""
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("name"))
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("path"))
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select("path", "name", F.lit(1).alias("count"))


def line_references(spark: SparkSession, sf: str) -> DataFrame:
    return line_orders(spark, sf).groupBy("path", "name").agg(F.sum("count").alias("count"))


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two states of a corpus, (path, sha, mtime, size) each: some files gone, edited, touched or new."""
    d = table(spark, sf, "documents")
    old = d.where("doc_id % 19 <> 0").select(doc_path().alias("path"), X.sha16(F.col("text")).alias("sha"), F.col("doc_id").cast("double").alias("mtime"), F.col("n_chars").alias("size"))
    edited = F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    touched = F.when((F.col("doc_id") % 11 == 0) | (F.col("doc_id") % 13 == 0), F.col("doc_id") + 0.5).otherwise(F.col("doc_id").cast("double"))
    new = d.where("doc_id % 17 <> 0").select(doc_path().alias("path"), X.sha16(edited).alias("sha"), touched.alias("mtime"), (F.col("n_chars") + F.when(F.col("doc_id") % 13 == 0, 1).otherwise(0)).alias("size"))
    return old, new


def symbol_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(path, line, vector): the embedding with a document's id stands for its first line."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    d = table(spark, sf, "documents").select("doc_id", doc_path().alias("path"))
    return d.join(e, d["doc_id"] == e["vec_id"]).select("path", F.lit(1).alias("line"), F.col("embedding").alias("vector"))
