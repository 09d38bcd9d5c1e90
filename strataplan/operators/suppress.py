"""Greedy non-maximum suppression: in order of rank, a row is kept unless it conflicts with a kept one of lower rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataplan.operators.graph import components
from strataplan.runtime import SHORT_ROWS, save


def suppress(nodes: DataFrame, conflicts: DataFrame, id_col: str = "id", rank: str = "rank", rounds: int = 6) -> DataFrame:
    """Ids that stay. nodes: id, rank (distinct); conflicts: a, b (ids), either way round.

    In a round every undecided row without an undecided conflict of lower rank is kept and its conflicts leave. Long
    chains of conflicts would need as many rounds as they have links; what is undecided after ``rounds`` falls apart into
    components, and each is passed through in order by itself. Rounds are written out.
    """
    both = conflicts.select("a", "b").unionByName(conflicts.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct()
    ranks = nodes.select(F.col(id_col).alias("id"), F.col(rank).alias("rank"))
    lower = save(
        both.join(ranks.select(F.col("id").alias("a"), F.col("rank").alias("_ra")), "a").join(ranks.select(F.col("id").alias("b"), F.col("rank").alias("_rb")), "b")
        .filter("_rb < _ra").select("a", "b"), "conflicts",
    )
    open_ = save(lower.select(F.col("a").alias("id")).unionByName(lower.select(F.col("b").alias("id"))).distinct(), "undecided")
    n = open_.count()
    gone = open_.limit(0)
    for _ in range(rounds):
        if not n:
            break
        held_up = _among(lower, open_).select(F.col("a").alias("id")).distinct()
        kept = save(open_.join(held_up, "id", "left_anti"), "kept", n, SHORT_ROWS)
        out = save(lower.join(kept.withColumnRenamed("id", "b"), "b", "left_semi").select(F.col("a").alias("id")).join(open_, "id", "left_semi").distinct(), "out", n, SHORT_ROWS)
        gone = gone.unionByName(out)
        open_ = save(open_.join(kept, "id", "left_anti").join(out, "id", "left_anti"), "undecided", n, SHORT_ROWS)
        n = open_.count()
    if n:
        gone = gone.unionByName(_in_order(_among(lower, open_), ranks))
    return ranks.select("id").join(gone, "id", "left_anti")


def _among(lower: DataFrame, open_: DataFrame) -> DataFrame:
    return lower.join(open_.withColumnRenamed("id", "a"), "a", "left_semi").join(open_.withColumnRenamed("id", "b"), "b", "left_semi")


def _in_order(lower: DataFrame, ranks: DataFrame) -> DataFrame:
    """Ids that leave when each component of conflicts (a, b; b of lower rank) is passed through in order of rank."""
    roots = components(lower.select(F.col("a").alias("u"), F.col("b").alias("v")))
    rows = lower.join(roots.withColumnRenamed("node", "a"), "a").join(ranks.select(F.col("id").alias("a"), "rank"), "a").select("root", "a", "b", "rank")
    kind = dict(lower.dtypes)["a"]

    def passed(table):
        import pyarrow as pa

        before: dict = {}
        for a, b in zip(table["a"].to_pylist(), table["b"].to_pylist()):
            before.setdefault(a, []).append(b)
        rank = {a: tuple(r.values()) if isinstance(r, dict) else r for a, r in zip(table["a"].to_pylist(), table["rank"].to_pylist())}
        gone: set = set()
        for a in sorted(before, key=rank.__getitem__):
            if any(b not in gone for b in before[a]):
                gone.add(a)
        return pa.table([pa.array(sorted(gone), table.schema.field("a").type)], ["id"])

    return rows.groupBy("root").applyInArrow(passed, f"id {kind}")
