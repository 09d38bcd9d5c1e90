"""A corpus made ready for training: five stages, each one of this library's operators.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept. All but the last return the
columns of documents. No stage is SQL alone, so ORACLE_SQL is None; tests hold the stages against brute force.

Defined results: texts that are null or have no letter leave at the first stage; rows with a null doc_id, repeated
rows and extra columns pass through stages 1 to 4 under each operator's own rules; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataplan.llm.bpe import public_path
from strataplan.llm.exact_dedup import drop_copies
from strataplan.llm.language import keep_identified
from strataplan.llm.near_dedup import drop_near_copies
from strataplan.llm.packing import packed
from strataplan.llm.secrets import redacted
from strataplan.runtime import merged, save

NEAR = (80, 100)  # of the shingles of two near duplicates, so many are in both


def sized(docs: DataFrame, step) -> DataFrame:
    """``step`` (of documents and their number) on ``docs``, read and returned in partitions by the number of rows."""
    n = docs.count()
    return merged(step(merged(docs, n), n), n)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go."""
    return sized(docs, lambda d, n: keep_identified(d))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays."""
    return sized(docs, lambda d, n: drop_copies(d))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest doc_id stays."""
    return sized(docs, lambda d, n: drop_near_copies(d, at_least=NEAR))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, and n_chars follows."""
    return sized(docs, lambda d, n: redacted(d, rows=n))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document, placed in sequences."""
    return sized(docs, lambda d, n: packed(d, public_path("byte_bpe_50k.json")))


STAGES = [("language", language), ("exact", exact), ("near", near), ("secrets", secrets), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, f"stage-{name}")
    return docs
