"""Line deduplication by winnowing over line hashes.

A run of RUN lines (or more) that occurs again, later in (doc_id, line) order, is deleted there; occurrences are judged
on the input. Each window of RUN lines selects the line with the smallest hash (ties: the last), so two equal runs
select the same line at the same place. Only selected lines are written in the first scan, each once, with their
places. Where a selected line is at two places or more, the text is read again and the windows that select it are
compared whole, each to the first place that has it; overlapping later windows extend each other both ways to full
runs. All other windows cannot repeat and are never hashed.

A run of fewer lines, one line included, is deleted at its later places too where it has ``long_bytes`` (its lines
joined by "\n"); op9_lines takes LONG. Such a run may select any line, so it is hashed wherever it stands.

Defined results: null and empty texts have no lines; other texts are split at "\\n" only and shorter ones than RUN lines
keep everything; rows with a null doc_id come first; rows that repeat doc_id and text are one place, so neither deletes
the other; an empty table gives an empty table; columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataplan.runtime import save, ship, whole

RUN = 3
LONG = 50  # bytes, as in op5

_NO_ID = -(1 << 63)
RESULT = "doc_id long, n_lines long, n_removed long, kept_sha256 string"


def lines_of(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Which row: its doc_id and its text. Both never null, so that they join."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("_doc"), F.xxhash64(whole(text_col)).alias("_text")]


def hashed(text: str | None, run_length: int) -> tuple[list[bytes], list[int], list[int]]:
    """Hash and rank of every line, and which line each window of ``run_length`` lines selects."""
    import xxhash

    raw = [xxhash.xxh3_128_digest(x.encode()) for x in lines_of(text)]
    rank = [int.from_bytes(x[:8], "big", signed=True) for x in raw]
    return raw, rank, [min(range(i, i + run_length), key=lambda j: (rank[j], -j)) for i in range(len(raw) - run_length + 1)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_length: int = RUN) -> DataFrame:
    """Every line that a window selects, once: its row, its hash, its place."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cols: list[list] = [[], [], [], []]
            for doc, key, text in zip(b.column(0), b.column(1), b.column(2)):
                _, rank, selected = hashed(text.as_py(), run_length)
                d, t = doc.as_py(), key.as_py()
                for at in dict.fromkeys(selected):
                    for col, v in zip(cols, (d, t, rank[at], at)):
                        col.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["_doc", "_text", "_print", "_at"])

    return docs.select(*row_key(id_col, text_col), text_col).mapInArrow(run, "_doc long, _text long, _print long, _at int")


def shared_places(found: DataFrame) -> DataFrame:
    """Fingerprints that are at two places or more, by row: _doc, _text, _ats."""
    place = F.struct("_doc", "_text", "_at")
    shared = (
        found.groupBy("_print").agg(F.min(place).alias("_lo"), F.max(place).alias("_hi"))
        .filter("_lo != _hi").select("_print")
    )
    return found.join(shared, "_print", "left_semi").groupBy("_doc", "_text").agg(F.collect_set("_at").alias("_ats"))


def windows(docs: DataFrame, places: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_length: int = RUN) -> DataFrame:
    """The windows that select a line at one of the places: row, start, hash of all lines."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        import xxhash

        for b in batches:
            cols: list[list] = [[], [], [], []]
            for doc, key, text, ats in zip(b.column(0), b.column(1), b.column(2), b.column(3)):
                raw, _, selected = hashed(text.as_py(), run_length)
                d, t, wanted = doc.as_py(), key.as_py(), set(ats.as_py())
                for i, at in enumerate(selected):
                    if at in wanted:
                        for col, v in zip(cols, (d, t, i, xxhash.xxh3_128_digest(b"".join(raw[i : i + run_length])))):
                            col.append(v)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["_doc", "_text", "_start", "_window"])

    keyed = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))
    near = keyed.join(places.hint("shuffle_hash"), ["_doc", "_text"]).select("_doc", "_text", "text", "_ats")
    return near.mapInArrow(run, "_doc long, _text long, _start int, _window binary")


def long_runs(docs: DataFrame, long_bytes: int, id_col: str = "doc_id", text_col: str = "text", run_length: int = RUN) -> DataFrame:
    """Every run of fewer than ``run_length`` lines that has ``long_bytes``: row, start, hash of all lines, lines."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        import xxhash

        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc, key, text in zip(b.column(0), b.column(1), b.column(2)):
                parts = [x.encode() for x in lines_of(text.as_py())]
                raw, d, t = [xxhash.xxh3_128_digest(x) for x in parts], doc.as_py(), key.as_py()
                for size in range(1, run_length):
                    for i in range(len(parts) - size + 1):
                        if sum(map(len, parts[i : i + size])) + size - 1 >= long_bytes:
                            for col, v in zip(cols, (d, t, i, xxhash.xxh3_128_digest(b"".join(raw[i : i + size])), size)):
                                col.append(v)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["_doc", "_text", "_start", "_window", "_size"])

    return docs.select(*row_key(id_col, text_col), text_col).mapInArrow(run, "_doc long, _text long, _start int, _window binary, _size int")


def later_windows(found: DataFrame) -> DataFrame:
    """Windows whose lines started at an earlier place: _doc, _text, _starts (_start, _size)."""
    here = F.struct("_doc", "_text", "_start")
    first = found.groupBy("_window").agg(F.min(here).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    later = found.join(first, "_window").filter(here > F.col("_first"))
    return later.groupBy("_doc", "_text").agg(F.collect_set(F.struct("_start", "_size")).alias("_starts"))


def strip_lines(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kept text, n_lines, n_removed."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            kept, lines, removed = [], [], []
            for text, starts in zip(b.column(1), b.column(2)):
                parts = lines_of(text.as_py())
                gone = {s["_start"] + i for s in (starts.as_py() or ()) for i in range(s["_size"])}
                kept.append("\n".join(x for i, x in enumerate(parts) if i not in gone))
                lines.append(len(parts))
                removed.append(len(gone))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], ["doc_id", "text", "n_lines", "n_removed"])

    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *row_key(id_col, text_col))
    marked = keyed.join(marks.hint("shuffle_hash"), ["_doc", "_text"], "left")
    return marked.select("doc_id", "text", "_starts").mapInArrow(run, "doc_id long, text string, n_lines long, n_removed long")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_length: int = RUN, long_bytes: int | None = None) -> DataFrame:
    prints = save(fingerprints(docs, id_col, text_col, run_length), "line-fingerprints")
    found = windows(docs, shared_places(prints), id_col, text_col, run_length).withColumn("_size", F.lit(run_length))
    if long_bytes is not None:
        found = found.unionByName(long_runs(docs, long_bytes, id_col, text_col, run_length))
    return strip_lines(docs, later_windows(save(found, "line-windows")), id_col, text_col)


def op9_lines(spark, sf_dir: str) -> DataFrame:
    return summary(dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), long_bytes=LONG))


def summary(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text <> ''
), w AS (
  SELECT *, lead(line, 1) OVER (PARTITION BY doc_id ORDER BY i) AS b, lead(line, 2) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM l
), f AS (
  SELECT *, strlen(line) >= 50 AND row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 AS one,
         b IS NOT NULL AND strlen(line) + strlen(b) + 1 >= 50 AND row_number() OVER (PARTITION BY line, b ORDER BY doc_id, i) > 1 AS two,
         c IS NOT NULL AND row_number() OVER (PARTITION BY line, b, c ORDER BY doc_id, i) > 1 AS later FROM w
), m AS (
  SELECT *, one OR bool_or(two) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)
         OR bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS gone FROM f
), d AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS t FROM m GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents LEFT JOIN d USING (doc_id)
"""
