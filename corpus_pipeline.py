"""From raw documents to token ids: five operators, each on all that the one before kept.

1. quality   documents that the quality classifier rejects go
2. near      of each class of near duplicates one document stays
3. private   personal data is masked in the texts
4. mix       documents are taken as often as their source's target weight asks
5. encode    token ids, with their count and digests; ``ids`` is the pipeline's result proper

All but the last return the columns of ``documents``, whatever their names.

Defined cases: a null text is scored, compared and encoded as an empty one and stays null until then; an empty
text has no near duplicate; texts of any length go whole through every stage; of repeated rows one stays
(``near``), unless the mix takes it twice; rows without doc_id or source go through like others; empty tables
give no rows, and without labels every document counts as good.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, mixing, neardup, pii, quality
from tessera.storage import table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good(docs, table(spark, sf_dir, "labels"))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path(bpe.VOCABULARY))


STAGES = [
    ("quality", keep_good),
    ("near", drop_near),
    ("private", mask_private),
    ("mix", mix_sources),
    ("encode", encode),
]

#: No stage but the mix can be said in SQL; tests hold all stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
