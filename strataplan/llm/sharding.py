"""Sharding by longest-processing-time scheduling: groups that stay together go to the least-loaded shard.

Law: ``bytes`` (shard sizes near equal). A group is all rows with equal texts. Groups of equal size are interchangeable,
so the schedule is made for runs (size, number of groups): largest first, each group to the least-loaded shard through
a heap. A long run is dealt in closed form, with the loads that the heap would give. A group finds its shard by its rank
among the groups of its size. Runs are as many as there are different group sizes, fewer than the root of twice the
corpus's bytes whatever the number of groups; no group, however large, meets in one task.

Defined results: null text has no bytes (size 1) and is a group with the empty texts; repeated rows and rows with a
null doc_id are sharded like any other, in null-first order of slots; an empty table gives an empty table; columns
other than the two named are ignored.
"""

from __future__ import annotations

import heapq
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataplan.runtime import numbered, save, whole

SHARDS = 8
HEAP_RUN = 64  # longer runs are dealt in closed form
BROADCAST_RUNS = 200_000


def dealt_run(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` items of one size each shard takes when each goes to the least-loaded shard, ties to the first.

    Shard s takes its i-th item at load loads[s] + i * size, and the run takes the ``count`` smallest of these.
    """
    if count <= HEAP_RUN:
        heap = [(load, s) for s, load in enumerate(loads)]
        heapq.heapify(heap)
        taken = [0] * len(loads)
        for _ in range(count):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            taken[s] += 1
        return taken

    def below(level: int) -> list[int]:
        return [max(0, -(-(level - load) // size)) for load in loads]

    low, high = min(loads), min(loads) + count * size + 1
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if sum(below(middle)) <= count else (low, middle)
    taken = below(low)
    left = count - sum(taken)
    for s, load in enumerate(loads):
        if left and load + taken[s] * size == low:
            taken[s] += 1
            left -= 1
    return taken


def schedule(runs: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """For each (size, number of groups), largest first: the rank at which each shard's groups end."""
    loads, placed = [0] * shards, []
    for size, count in sorted(runs, reverse=True):
        taken = dealt_run(loads, size, count)
        loads = [load + n * size for load, n in zip(loads, taken)]
        placed.append((size, list(accumulate(taken))))
    return placed


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = whole(text_col)
    rows = save(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("_group"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "shard-rows",
    )
    n_rows = rows.count()
    groups = save(rows.groupBy("_group").agg(F.sum("size").alias("_size")), "shard-groups", n_rows)
    runs = [(r[0], r[1]) for r in groups.groupBy("_size").agg(F.count(F.lit(1))).collect()]
    placed = spark.createDataFrame([(size, ends, ends[-1]) for size, ends in schedule(runs, shards)], "_size long, _ends array<long>, _groups long")
    placed = F.broadcast(placed) if len(runs) <= BROADCAST_RUNS else placed
    ranked = numbered(groups.join(placed, "_size"), "_size", ["_group"], ["_group"], n_rows, "_rank", of_key=F.col("_groups"))
    homes = ranked.select("_group", F.size(F.filter("_ends", lambda end: end <= F.col("_rank"))).alias("shard"))
    keyed = rows.join(homes, "_group")
    out = numbered(keyed, "shard", ["doc_id", "_row"], ["_row"], n_rows, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
