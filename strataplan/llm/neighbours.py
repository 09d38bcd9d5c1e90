"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

A rotation that brings principal components close to their signs is learned on a bounded sample (SAMPLE rows, first in
hash order); the code of a vector is the signs. Codes split into substrings of 8 bits, each with an index from value
to rows. By the pigeonhole principle a code within Hamming radius r of a query is within r div m in one of the first
(r mod m) + 1 substrings or within r div m - 1 in one of the others, so probing those values retrieves every code in
the radius; those are reranked by exact inner products. The radius is learned on the sample: the COVER quantile of
code distances between rows and their true neighbours at the sample's density. A query with too few codes in the
radius widens it until there are enough.

Every row is indexed, in one block of about BLOCK_BYTES of vectors; queries are dealt to chunks of that size, and each
chunk meets each block in a cell of its own, where only candidates are scored and only the nearest of each query leave.
A row is sent once for each chunk of queries, a query once for each block.

Defined results: vectors that are null, zero, hold null or non-finite components, have no vec_id, or have another
length than most vectors of the sample take no part; of rows that repeat a vec_id the one with the smallest vector
counts; ties go to the smaller vec_id; fewer candidates than asked for are all returned; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataplan.runtime import ship

NEAREST = 20
QUERY_STEP = 20
SAMPLE = 4_000
SAMPLE_QUERIES = 500
COVER = 0.98
MAX_BITS = 64
ITERATIONS = 30
BLOCK_BYTES = 16 << 20  # of vectors as doubles, in a block of rows or a chunk of queries
TOGETHER = 128  # queries whose candidates are found at once
DENSE = 1 / 16  # share of a block from which on scoring all of it costs less than gathering the candidates

FOUND = "query_id long, vec_id long, score double"


def learn(x, nearest: int, n_rows: int):
    """(mean, projection) whose signs are the code, and the radius that covers neighbours in the sample."""
    import numpy as np

    mean = x.mean(0)
    centred = x - mean
    bits = min(MAX_BITS, x.shape[1])
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    z = centred @ axes
    rotation = np.linalg.qr(np.random.default_rng(0).normal(size=(bits, bits)))[0]
    for _ in range(ITERATIONS):
        u, _, v = np.linalg.svd(np.where(z @ rotation > 0, 1.0, -1.0).T @ z)
        rotation = (u @ v).T
    projection = axes @ rotation
    signs = np.where(centred @ projection > 0, 1.0, -1.0)
    q = min(len(x), SAMPLE_QUERIES)
    near = min(len(x) - 1, max(1, round(nearest * len(x) / max(1, n_rows))))
    if near < 1:
        return mean, projection, bits
    inner = x[:q] @ x.T
    inner[np.arange(q), np.arange(q)] = -np.inf
    top = np.argpartition(-inner, near - 1, axis=1)[:, :near]
    apart = (bits - signs[:q] @ signs.T) / 2
    return mean, projection, int(np.ceil(np.quantile(np.take_along_axis(apart, top, 1), COVER)))


class MultiIndex:
    """Rows of one block, by each substring of their codes."""

    def __init__(self, keys):
        import numpy as np

        self.keys = keys
        self.words = _as_words(keys)
        self.rows = [np.argsort(keys[:, j], kind="stable") for j in range(keys.shape[1])]
        self.starts = [np.searchsorted(keys[r, j], np.arange(257)) for j, r in enumerate(self.rows)]
        ones = np.array([bin(i).count("1") for i in range(256)])
        self.ball = [np.flatnonzero(ones <= r) for r in range(9)]

    def within(self, queries, radius: int, least: int = 0):
        """Which rows' codes are at most ``radius`` bits from each query's: [query, row]. A query that has fewer than
        ``least`` of them also gets the next nearest codes, as far as the one that makes up the number."""
        import numpy as np

        n, m = self.keys.shape
        probed = np.zeros((len(queries), n), bool)
        each, more = divmod(radius, m)
        for j in range(m):
            reach = each if j <= more else each - 1
            if reach >= 8:
                probed[:] = True
                break
            if reach < 0:
                continue
            rows, starts = self.rows[j], self.starts[j]
            values, who = np.unique(queries[:, j], return_inverse=True)
            for k, value in enumerate(values.tolist()):
                near = np.sort(value ^ self.ball[reach])
                hit = np.concatenate([rows[a:b] for a, b in zip(starts[near], starts[near + 1])])
                probed[np.ix_(np.flatnonzero(who == k), hit)] = True
        apart = self.apart(queries)
        found = probed & (apart <= radius)
        for q in np.flatnonzero(found.sum(1) < min(least, n)):
            found[q] = apart[q] <= np.partition(apart[q], min(least, n) - 1)[min(least, n) - 1]
        return found

    def apart(self, queries):
        """Bits in which codes differ: [query, row]."""
        import numpy as np

        out = np.zeros((len(queries), len(self.words)), np.uint16)
        for mine, theirs in zip(self.words.T, _as_words(queries).T):
            out += np.bitwise_count(theirs[:, None] ^ mine[None, :])
        return out


def _as_words(keys):
    """Codes in words of 64 bits."""
    import numpy as np

    wide = np.zeros((len(keys), -(-keys.shape[1] // 8) * 8), np.uint8)
    wide[:, : keys.shape[1]] = keys
    return wide.view(np.uint64)


def nearest_of(index: MultiIndex, ids, data, asked, wanted, probes, radius: int, nearest: int):
    """(query, row, score) of each query's nearest among its candidates, nearest first, ties to smaller ids.

    Where candidates are many, a matrix product orders them first; what it leaves within its error of the last place
    is scored again, each pair by itself, so that equal vectors score alike.
    """
    import numpy as np

    found = index.within(probes, radius, nearest + 1)
    found &= asked[:, None] != ids[None, :]
    if found.mean() > DENSE:
        rough = wanted @ data.T
        rough[~found] = -np.inf
        k = min(nearest, data.shape[0])
        floor = np.partition(rough, data.shape[0] - k, axis=1)[:, data.shape[0] - k]
        error = 1e-9 * np.linalg.norm(wanted, axis=1) * np.linalg.norm(data, axis=1).max(initial=0)
        found &= rough >= (floor - error)[:, None]
    for q, v, near in zip(asked.tolist(), wanted, found):
        near = np.flatnonzero(near)
        scores = (data[near] * v).sum(1)
        top = np.lexsort((ids[near], -scores))[:nearest]
        yield q, ids[near[top]], scores[top]


def codes(x, mean, projection):
    import numpy as np

    return np.packbits((x - mean) @ projection > 0, axis=1)


def _matrix(table, ids: str, vectors: str):
    """Distinct ids in order, with their (smallest) vectors as doubles."""
    import numpy as np

    v = table[vectors].combine_chunks()
    n = len(v)
    x = np.asarray(v.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else np.empty((0, 1))
    i = table[ids].to_numpy()
    order = np.lexsort((*x.T[::-1], i)) if n else np.empty(0, int)
    i, x = i[order], x[order]
    first = np.concatenate(([True], i[1:] != i[:-1])) if n else np.empty(0, bool)
    return i[first], x[first]


def search(vectors: DataFrame, nearest: int = NEAREST, query_step: int = QUERY_STEP, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows of each row whose id is a multiple of ``query_step``."""
    spark = vectors.sparkSession
    ship(spark)
    x = F.col("_x")
    kept = vectors.schema[vector_col].dataType.simpleString() in ("array<float>", "array<double>")
    usable = vectors.select(F.col(id_col).cast("long").alias("_id"), (F.col(vector_col) if kept else F.col(vector_col).cast("array<double>")).alias("_x")).filter(
        F.col("_id").isNotNull() & x.isNotNull() & F.exists(x, lambda v: v != 0)
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    )
    head = usable.select("_id", "_x", F.xxhash64("_id").alias("_h")).orderBy("_h", "_id").limit(SAMPLE).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not head:
        return empty
    import numpy as np

    lengths = [len(r["_x"]) for r in head]
    dim = max(set(lengths), key=lambda n: (lengths.count(n), n))
    usable = usable.filter(F.size("_x") == dim)
    n_rows = usable.count()
    n_queries = usable.filter(F.col("_id") % query_step == 0).count()
    mean, projection, radius = learn(np.array([r["_x"] for r in head if len(r["_x"]) == dim], float), nearest, n_rows)
    most = max(1, BLOCK_BYTES // (8 * dim))
    blocks = max(-(-n_rows // most), min(2 * spark.sparkContext.defaultParallelism, -(-n_rows // 1024)))
    chunks = max(1, -(-n_queries // most))
    sent = spark.sparkContext.broadcast((mean, projection))  # dimension x bits

    def cell(rows, queries):
        import pyarrow as pa

        ids, data = _matrix(rows, "_id", "_x")
        asked, wanted = _matrix(queries, "_id", "_x")
        found: list[list] = [[], [], []]
        if len(ids) and len(asked):
            mean, projection = sent.value
            index, probes = MultiIndex(codes(data, mean, projection)), codes(wanted, mean, projection)
            for at in range(0, len(asked), TOGETHER):
                some = slice(at, at + TOGETHER)
                for q, near, scores in nearest_of(index, ids, data, asked[some], wanted[some], probes[some], radius, nearest):
                    found[0] += [q] * len(near)
                    found[1] += near.tolist()
                    found[2] += scores.tolist()
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["query_id", "vec_id", "score"])

    def dealt(parts: int, name: str):
        return F.pmod(F.xxhash64("_id", F.lit(name)), F.lit(parts)).cast("int").alias(f"_{name}")

    def every(parts: int, name: str):
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias(f"_{name}")

    rows = usable.select("_id", "_x", dealt(blocks, "block"), every(chunks, "chunk"))
    queries = usable.filter(F.col("_id") % query_step == 0).select("_id", "_x", every(blocks, "block"), dealt(chunks, "chunk"))
    pairs = rows.groupBy("_block", "_chunk").cogroup(queries.groupBy("_block", "_chunk")).applyInArrow(cell, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op10_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
