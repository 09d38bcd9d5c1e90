"""Secret scans through an incremental blob ledger.

Every version of a text is addressed by its SHA-256. The ledger holds (blob, rule version, spans); only pairs that it
lacks are scanned, once each however many paths carry the blob, and findings are joined back to all paths.

Where STORE is set in the session, the ledger lies in that folder: a run that is given no ledger reads it and appends
its new rows, so later runs scan only what is new. Where it is not set, such a run starts from an empty ledger.

Defined results: null text counts as empty; a path whose blob has no finding gets zero counts and empty spans; rows
with a null or repeated doc_id are paths like any other; an empty table gives an empty table; columns other than the
two named are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataplan.runtime import forget, save, ship, unused, whole

# The rules, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex")
RULE_VERSION = "2"
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run, so shorter runs need no match of their own
MIN_VALUE, MIN_ACCESS = 6, 20
REDACTION = "[SECRET]"

LEDGER = "blob binary, rule_version string, spans string"
STORE = "spark.strataplan.secrets.ledger"


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) in code points, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def as_line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def blob_address(text_col: str):
    return F.unhex(F.sha2(whole(text_col), 256))


def _compressed(docs: DataFrame, text_col: str) -> DataFrame:
    """blob, packed text: what has to move once per distinct blob moves compressed."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        forget()
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([squeeze((t.as_py() or "").encode()) for t in b.column(1)], pa.binary())], ["blob", "_packed"])

    return docs.select(blob_address(text_col).alias("blob"), F.col(text_col).alias("_t")).mapInArrow(run, "blob binary, _packed binary")


def unseen(docs: DataFrame, ledger: DataFrame | None, rule_version: str, text_col: str = "text") -> DataFrame:
    """Blobs that the ledger does not have under this rule version, each once."""
    blobs = _compressed(docs, text_col)
    if ledger is not None:
        seen = ledger.filter(F.col("rule_version") == rule_version).select("blob")
        blobs = blobs.join(seen, "blob", "left_anti")
    return blobs.groupBy("blob").agg(F.first("_packed").alias("_packed"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION, text_col: str = "text") -> DataFrame:
    """The ledger's new rows: every unseen blob under this rule version, with its spans ('' if it has none)."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            lines = [as_line(spans_of(unpack(p.as_py()).decode())) for p in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([rule_version] * len(lines), pa.string()), pa.array(lines, pa.string())], ["blob", "rule_version", "spans"])

    return unseen(docs, ledger, rule_version, text_col).mapInArrow(run, LEDGER)


def stored(spark: SparkSession) -> DataFrame | None:
    """The ledger in the session's STORE, each pair once; none where no run has written one."""
    path = spark.conf.get(STORE, None)
    if not path:
        return None
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath):
        return None
    return spark.read.schema(LEDGER).parquet(path).dropDuplicates(["blob", "rule_version"])


def updated(docs: DataFrame, ledger: DataFrame | None, text_col: str = "text", rows: int | None = None) -> DataFrame:
    """The ledger, or the session's stored one, with the rows of every blob it lacks. ``rows``: of ``docs``, where known."""
    spark = docs.sparkSession
    path = spark.conf.get(STORE, None) if ledger is None else None
    ledger = stored(spark) if path else ledger
    new = save(scan(docs, ledger, text_col=text_col), "secret-ledger", rows)
    if path:
        new.write.mode("append").parquet(path)
        return stored(spark)
    return new if ledger is None else ledger.select("blob", "rule_version", "spans").unionByName(new)


def findings(docs: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All paths with the spans of their blob: doc_id, spans ('' where none)."""
    paths = docs.select(F.col(id_col).cast("long").alias("doc_id"), blob_address(text_col).alias("blob"))
    hits = ledger.filter((F.col("rule_version") == rule_version) & (F.col("spans") != "")).select("blob", "spans")
    return paths.join(hits, "blob", "left").select("doc_id", F.coalesce("spans", F.lit("")).alias("spans"))


def history(versions: DataFrame, ledger: DataFrame | None = None, path_col: str = "path", version_col: str = "version", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every historical version of every path: (path, blob, first_version, last_version, spans of exposures; the ledger).

    A content that a path takes up again, or that several paths share, is one blob and scanned once.
    """
    ledger = updated(versions, ledger, text_col)
    rows = versions.select(F.col(path_col).alias("path"), F.col(version_col).alias("version"), blob_address(text_col).alias("blob"))
    held = rows.groupBy("path", "blob").agg(F.min("version").alias("first_version"), F.max("version").alias("last_version"))
    hits = ledger.filter((F.col("rule_version") == RULE_VERSION) & (F.col("spans") != "")).select("blob", "spans")
    return held.join(hits, "blob").select("path", "blob", "first_version", "last_version", "spans"), ledger


def report(docs: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scan what is new; (per-path findings with counts and digest, ledger with the new rows added)."""
    ledger = updated(docs, ledger)
    kinds = F.when(F.col("spans") == "", F.array()).otherwise(F.transform(F.split("spans", ","), lambda x: F.split(x, ":")[0]))

    def count(kind: str):
        return F.size(F.filter(kinds, lambda x: x == kind)).cast("long").alias(f"n_{kind}")

    out = findings(docs, ledger).select("doc_id", *map(count, KINDS), F.sha2("spans", 256).alias("base_sha256"), "spans")
    return out, ledger


def redacted(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", length_col: str | None = "n_chars", rows: int | None = None) -> DataFrame:
    """``docs`` with every span replaced by REDACTION; columns as they were, the length brought up to date."""
    ledger = updated(docs, ledger, text_col, rows)
    blob, spans = unused(docs, "_blob"), unused(docs, "_spans")
    hits = ledger.filter((F.col("rule_version") == RULE_VERSION) & (F.col("spans") != "")).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    found = docs.withColumn(blob, blob_address(text_col)).join(hits.hint("shuffle_hash"), blob, "left").drop(blob)
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [mask(t.as_py(), s.as_py()) if s.is_valid else t.as_py() for t, s in zip(b.column(at), b.column(b.num_columns - 1))]
            cols = b.columns[:-1]
            cols[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])

    out = found.mapInArrow(run, schema)
    if length_col and length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col(length_col).isNotNull(), F.coalesce(F.length(text_col).cast(kind), F.col(length_col))))
    return out


def mask(text: str, line: str) -> str:
    """The text with the line's spans, overlapping ones together, replaced."""
    out, at = [], 0
    for start, end in sorted(tuple(map(int, x.split(":")[1:])) for x in line.split(",")):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], REDACTION]
        at = end
    return "".join([*out, text[at:]])


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
