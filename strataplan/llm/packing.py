"""Harmonic packing of tokenised documents into sequences of at most 1024 tokens.

A document's ids, with the closing id 0, are cut into full sequences; what remains is cut at powers of two down to
MIN_CUT, so every piece but a last short one fills a reciprocal class exactly. A piece of length n is in class
k = 1024 div n, and a class's sequences take k pieces each, whichever they are: worker buckets number their pieces by
themselves, and only counts per class and bucket are shared. The incomplete last sequence of each class (fewer than k
pieces) is merged with those of the other classes by first fit over slot sizes, which needs the counts alone.

Defined results: null text is one piece holding id 0; repeated rows are packed once each, and their pieces may
trade places; rows with a null doc_id are packed; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataplan.llm.bpe import Codec, Remembered, in_groups, public_path
from strataplan.runtime import numbered, remembered, save, ship

CAPACITY = 1024
MIN_CUT = 64
CLOSING_ID = 0

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _word_bytes(path: str) -> Remembered:
    def made(ids, at):
        raw = ids.astype("<u4").tobytes()
        for i, j in zip(at, at[1:]):
            yield raw[4 * i : 4 * j]

    return Remembered(Codec(path), made)


def cut(n: int, capacity: int = CAPACITY, min_cut: int = MIN_CUT) -> list[int]:
    """Lengths of a document's pieces, in order: full ones, powers of two, a short rest."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        piece = 1 << (rest.bit_length() - 1) if rest >= min_cut else rest
        out.append(piece)
        rest -= piece
    return out


def tokenised_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    ship(docs.sparkSession)

    def ids_of(pieces) -> bytes:
        parts = []
        for words, special in pieces:
            parts += words
            if special is not None:
                parts.append(special.to_bytes(4, "little"))
        parts.append(CLOSING_ID.to_bytes(4, "little"))
        return b"".join(parts)

    def run(batches):
        import pyarrow as pa

        forms = remembered(("packing", path), lambda: _word_bytes(path))
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for d, pieces in zip(b.column(0), in_groups(forms, b.column(1))):
                doc, ids = d.as_py(), ids_of(pieces)
                n, at = len(ids) // 4, 0
                for size in cut(n):
                    for col, v in zip(cols, (doc, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n)):
                        col.append(v)
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, PIECES)


def tail_plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, int], list[tuple[int, int, int]], int]:
    """First sequence of each class, (class, index, sequence) of pieces in incomplete sequences, sequences in all."""
    base, used = {}, 0
    for k in sorted(counts):
        base[k] = used
        used += counts[k] // k
    room: list[int] = []
    tail = []
    for k in sorted(counts):
        slot = capacity // k
        for i in range(counts[k] // k * k, counts[k]):
            at = next((s for s, r in enumerate(room) if r >= slot), None)
            if at is None:
                at = len(room)
                room.append(capacity)
            room[at] -= slot
            tail.append((k, i, used + at))
    return base, tail, used + len(room)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows of ``tokenised_pieces``."""
    spark = pieces.sparkSession
    pieces = save(pieces.withColumn("_class", F.floor(F.lit(capacity) / F.col("length")).cast("int")).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("_class").agg(F.count(F.lit(1))).collect()}  # at most `capacity` rows
    base, tail, _ = tail_plan(counts, capacity)
    bases = spark.createDataFrame(list(base.items()), "_class int, _base long")
    tails = spark.createDataFrame(tail, "_class int, _index long, _tail long")  # fewer rows than the classes' sizes add up to
    placed = (
        numbered(pieces, "_class", ["doc_id", "start", "_row"], ["_row"], sum(counts.values()), "_index")
        .join(F.broadcast(bases), "_class")
        .join(F.broadcast(tails), ["_class", "_index"], "left")
        .withColumn("sequence_id", F.coalesce("_tail", F.col("_base") + F.floor(F.col("_index") / F.col("_class"))).cast("long"))
    )
    before = Window.partitionBy("sequence_id").orderBy("_class", "_index").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"),
    )


def packed(docs: DataFrame, path: str) -> DataFrame:
    return pack(tokenised_pieces(docs, path))


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_path("byte_bpe_50k.json"))
