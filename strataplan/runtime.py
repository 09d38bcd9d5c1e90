"""Session helpers shared by every module: shipping the package, scratch tables, gapless numbering."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS_PER_BATCH = 1_000
ROWS_PER_TASK = 5_000  # of whole texts
SHORT_ROWS = 100_000  # the same, of ids and hashes


def ship(spark: SparkSession) -> None:
    """Make this package importable in executors' Python workers, once per application; and hand whole texts to them in
    batches of ROWS_PER_BATCH, which both sides hold in memory at once."""
    if int(spark.conf.get(_BATCH)) > ROWS_PER_BATCH:
        spark.conf.set(_BATCH, str(ROWS_PER_BATCH))
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / "strataplan.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, os.path.join(top.name, f.relative_to(top)))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediates: ``spark.checkpoint.dir``, or one of our own where unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def merged(df: DataFrame, rows: int, per: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` in a partition for each ``per`` of about ``rows`` rows, if it has more; in one a core at least, so that the
    last step still keeps every core at work (``per`` 0: in one). Small tables are thus not one file per partition."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(cores, -(-rows // per)) if per else 1)


def save(df: DataFrame, name: str, rows: int | None = None, per: int = ROWS_PER_TASK) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    ``rows``: about how many rows at most, where the caller knows; it is ``merged`` first.
    """
    spark = df.sparkSession
    if rows is not None:
        df = merged(df, rows, per)
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    df.write.parquet(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by ``save`` that no later step reads."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f).getParent()
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let the driver notice that earlier shuffles are out of use, so that their files go before the next stage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_REMEMBERED: dict = {}


def remembered(key, make):
    """In a Python worker: what ``make`` gives, kept for later tasks of the same operator. Another operator's things go
    first, since workers are reused and their memory would add up."""
    if key not in _REMEMBERED:
        forget()
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]


def forget() -> None:
    """In a Python worker: drop what earlier operators keep there, and give the memory back."""
    if not _REMEMBERED:
        return
    _REMEMBERED.clear()
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library frees as it sees fit
        pass


def spread(n_rows: int, per_bucket: int = 20_000) -> int:
    """How many salt buckets hold ``n_rows`` at about ``per_bucket`` rows each."""
    return max(1, -(-n_rows // per_bucket))


def numbered(df: DataFrame, key: str, order: list[str], salt_on: list[str], n_rows: int, out: str, per_bucket: int = 20_000, of_key: Column | None = None) -> DataFrame:
    """Add ``out``: 0, 1, 2 ... without gaps within each value of ``key``, although a key may hold most rows.

    Rows of a key are dealt over salt buckets, each bucket is numbered by itself, and a bucket starts where the
    buckets before it end. Counts per (key, salt) are the only thing that meets per key. ``of_key``: rows of the key, where
    they are known; small keys then have one bucket instead of as many as the largest might need.
    """
    buckets = F.lit(spread(n_rows, per_bucket)) if of_key is None else F.greatest(F.lit(1), F.ceil(of_key / per_bucket)).cast("int")
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), buckets))
    counts = salted.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = Window.partitionBy(key, "_salt").orderBy(*order)
    return (
        salted.withColumn("_local", F.row_number().over(local) - 1)
        .join(starts, [key, "_salt"])
        .withColumn(out, (F.col("_start") + F.col("_local")).cast("long"))
        .drop("_salt", "_local", "_start")
    )


def whole(text: str | Column) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def text_key(text: str) -> Column:
    """Tells rows apart that share an id but not a text."""
    return F.xxhash64(whole(text)).alias("text_key")


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` that are not among ``gone`` (doc_id, text_key); null ids are compared like any value."""
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct()
    same = docs[id_col].cast("long").eqNullSafe(gone["_gone_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == gone["_gone_key"])
    return docs.join(gone.hint("shuffle_hash"), same, "left_anti")


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name
