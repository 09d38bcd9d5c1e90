"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only.

Two texts are equal when they are identical after each run of the six ASCII blanks is replaced by one space.

Defined results: null text counts as empty; rows that tie on the smallest doc_id of their group all stay; a null
doc_id never wins against a number, and keeps its row only where its whole group has none; an empty table gives an
empty table; columns other than the two named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataplan.runtime import save, text_key, whole, without

PREFIX = 128  # characters that the second refinement reads

# A run that is not already one plain space; single spaces stay as they are and cost nothing.
_BLANKS = r"(?: [\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*)"


def normalised(text: str) -> Column:
    return F.regexp_replace(whole(text), _BLANKS, " ")


def refine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = True) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, text_key (hash of the text as it stands).

    A cheap signature (length, hash of a prefix) is written once. Rows alone in their length, then rows alone in
    (length, prefix hash), leave the search; only the rest are grouped by the full SHA-256.

    ``digest_all``: the caller wants the digest of every row, so the one scan also computes it; the refinement then
    saves the shuffles. If false, texts are read again, for survivors only, and text_sha256 is null elsewhere.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col), normalised(text_col).alias("_t"))
    cheap = [F.octet_length("_t").cast("long").alias("_len"), F.xxhash64(F.substring("_t", 1, PREFIX)).alias("_prefix")]
    full = F.unhex(F.sha2(F.col("_t"), 256))
    sig = save(base.select("doc_id", "text_key", *cheap, *([full.alias("_full")] if digest_all else [])), "exact-signatures")

    # Counted once at the finer level, so that a length shared by a large group of copies is one row by then.
    counts = sig.groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    by_length = counts.groupBy("_len").agg(F.sum("_n").alias("_n")).filter("_n > 1").select("_len")
    by_prefix = counts.join(by_length, "_len", "left_semi").filter("_n > 1").drop("_n")
    if digest_all:
        rows = sig
        survivors = sig.join(by_prefix, ["_len", "_prefix"], "left_semi")
    else:
        # The second reading: a row's own (length, prefix hash) decides whether its full text is hashed.
        flags = by_prefix.withColumn("_again", F.lit(True))
        rows = save(
            base.select("doc_id", "text_key", *cheap, "_t").join(flags, ["_len", "_prefix"], "left")
            .select("doc_id", "text_key", "_len", "_prefix", F.when(F.col("_again"), full).alias("_full")),
            "exact-survivors", sig.count(),
        )
        survivors = rows.filter("_full is not null")
    groups = (
        survivors.groupBy("_len", "_prefix", "_full")
        .agg(F.min("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
        .filter("_size > 1")
    )
    return rows.join(groups, ["_len", "_prefix", "_full"], "left").select(
        "doc_id",
        F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("_keep"))).alias("kept"),
        F.lower(F.hex("_full")).alias("text_sha256"),
        "text_key",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that another row stands for; all columns as they were. Needs no digest of the others."""
    return without(docs, refine(docs, id_col, text_col, digest_all=False).filter("not kept"), id_col, text_col)


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return refine(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key")


OP7_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT doc_id, sha256(t) AS text_sha256, min(doc_id) OVER (PARTITION BY t) AS keep_id,
         count(*) OVER (PARTITION BY t) AS group_size FROM n
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
