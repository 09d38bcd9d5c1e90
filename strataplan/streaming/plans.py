"""An extension: plans that arrive as files are detected batch by batch; each plan is independent, so nothing is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataplan.plans.detect import Result, detect
from strataplan.sources import dumps


def watch(spark: SparkSession, paths: str, texts: str, checkpoint: str, sink: Callable[[Result, int], None], config: dict | None = None):
    """Start a query over new path files; ``texts`` holds the same plans' texts by the time their paths arrive."""
    config = config or dumps.read_config()

    def batch(new: DataFrame, number: int) -> None:
        if not new.isEmpty():
            words = dumps.read_texts(spark, texts).join(new.select("plan_id").distinct(), "plan_id", "left_semi")
            sink(detect(new, words, config), number)

    stream = spark.readStream.schema(dumps.PATHS).parquet(paths)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
