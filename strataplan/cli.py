"""spark-submit entry: detect elements on dumped plans and write detections, draw commands and SVG layers."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strataplan.plans.detect import detect
from strataplan.sources import dumps, sinks


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--paths", required=True)
    p.add_argument("--texts", required=True)
    p.add_argument("--config")
    p.add_argument("--out", required=True)
    p.add_argument("--pdfs", help="the drawings themselves, to be annotated (needs PyMuPDF)")
    p.add_argument("--dpi", type=float, default=150.0)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("strataplan").getOrCreate()
    found = detect(dumps.read_paths(spark, a.paths), dumps.read_texts(spark, a.texts), dumps.read_config(a.config))
    sinks.documents(found.objects, found.calibration, None, a.dpi).write.mode("overwrite").parquet(f"{a.out}/documents")
    sinks.to_json(sinks.detections(found.objects, found.calibration, a.dpi)).write.mode("overwrite").partitionBy("plan_id").json(f"{a.out}/detections")
    found.calibration.write.mode("overwrite").json(f"{a.out}/calibration")
    found.log.write.mode("overwrite").json(f"{a.out}/log")
    commands = sinks.draw_commands(found.objects)
    commands.write.mode("overwrite").parquet(f"{a.out}/draw_commands")
    sinks.to_svg(commands).write.mode("overwrite").parquet(f"{a.out}/svg")
    if a.pdfs:
        files = spark.read.format("binaryFile").load(a.pdfs).select(F.col("path").alias("plan_id"), "content")
        sinks.render(commands, files, found.calibration, int(a.dpi)).write.mode("overwrite").parquet(f"{a.out}/rendered")
    sinks.class_counts(found.objects).orderBy("plan_id", "ord").show(1000, False)


if __name__ == "__main__":
    main()
