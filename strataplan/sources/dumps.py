"""Drawings as tables: vector paths and texts of any number of plans, keyed by plan_id."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataplan.operators.joins import first_by

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
PATHS = f"plan_id string, idx int, type string, filled boolean, width double, rect {RECT}, items array<struct<kind:string,pts:array<struct<x:double,y:double>>>>"
TEXTS = f"plan_id string, text_id int, text string, rect {RECT}"


def read_paths(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(PATHS).format(fmt).load(path).withColumn("width", F.coalesce("width", F.lit(0.0)))


def read_texts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return clean_texts(spark.read.schema(TEXTS).format(fmt).load(path))


def clean_texts(texts: DataFrame) -> DataFrame:
    """Trimmed, not empty, the first of equal texts whose boxes agree to a point."""
    t = texts.withColumn("text", F.trim("text")).filter("text <> ''")
    rounded = [F.bround(f"rect.{c}").alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")]
    return first_by(t.select("*", *rounded), ["plan_id", "text", "_x0", "_y0", "_x1", "_y1"], ["text_id"]).drop("_x0", "_y0", "_x1", "_y1")


def read_config(path: str | None = None) -> dict:
    return tomllib.loads(Path(path or Path(__file__).parents[1] / "plans" / "rules.toml").read_text())


def read_pdfs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(paths, texts) of the first pages of PDF files. Needs PyMuPDF on the executors; says so where it is absent."""
    import importlib.util

    if importlib.util.find_spec("pymupdf") is None:
        raise RuntimeError("reading PDF files needs PyMuPDF, which is not installed; read a dump of paths and texts instead")
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("plan_id"), "content")

    def pages(batches, what):
        import pandas as pd
        import pymupdf

        for b in batches:
            rows = []
            for plan, content in zip(b["plan_id"], b["content"]):
                page = pymupdf.open(stream=content, filetype="pdf")[0]
                rows += _paths(plan, page) if what == "paths" else _texts(plan, page)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in (PATHS if what == "paths" else TEXTS).split(", ")])

    return files.mapInPandas(lambda it: pages(it, "paths"), PATHS), clean_texts(files.mapInPandas(lambda it: pages(it, "texts"), TEXTS))


def _xy(p) -> dict:
    return {"x": float(p[0]), "y": float(p[1])}


def _box(r) -> dict:
    return {"x0": float(r[0]), "y0": float(r[1]), "x1": float(r[2]), "y1": float(r[3])}


def _paths(plan, page) -> list:
    out = []
    for i, d in enumerate(page.get_drawings()):
        items = []
        for kind, *rest in d["items"]:
            if kind == "re":
                x0, y0, x1, y1 = rest[0]
                pts = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
            elif kind == "qu":
                q = rest[0]
                pts = [q.ul, q.ur, q.lr, q.ll]
            else:
                pts = rest
            items.append({"kind": kind, "pts": [_xy(p) for p in pts]})
        out.append((plan, i, d["type"], d.get("fill") is not None, float(d.get("width") or 0.0), _box(d["rect"]), items))
    return out


def _texts(plan, page) -> list:
    return [(plan, i, a.info.get("content", ""), _box(a.rect)) for i, a in enumerate(page.annots())]
