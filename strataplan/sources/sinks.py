"""Results out of the engine: detection rows as JSON, draw commands, SVG pages, class counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataplan.functions import geometry as G
from strataplan.plans import rules
from strataplan.tolerances import CLASS_COLOURS, CLASS_NAME, CLASS_ORDER, ELEMENT_TYPE, GROUP_FACTS, KIND_WORDS, UNNAMED_COLOUR, Tolerances

_lookup = rules.lookup


def boxy(o: DataFrame) -> Column:
    """Is an object drawn as its box? Traced shapes if they are rectangles, others if they stay within a thickness of it."""
    traced = F.col("kind").isin("outline", "stamped_region")
    return F.when(traced, F.col("o.rectness") >= 0.99).otherwise(G.box_fits(F.col("ring"), F.col("o.obb")))


def display_label(o: DataFrame) -> Column:
    """Class word, type (as printed, ~ where inferred), size and, off boxes, area; the group's tag where there is no class."""
    named = rules.display_text(_lookup(CLASS_NAME, F.col("class")), F.coalesce("key", F.lit("")), F.col("type_source").startswith("inferred"), F.col("length"), F.col("width"), F.col("area"), boxy(o))
    return F.when(F.col("class").isNull(), rules.group_tag(F.col("cluster"))).otherwise(named)


def _scaled(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct((p["x"] * F.col("k")).alias("x"), (p["y"] * F.col("k")).alias("y")))


def _px_box(px: Column) -> Column:
    edge = lambda f, i: f(F.transform(px, lambda p: p[i]))
    return F.array(edge(F.array_min, 0), edge(F.array_min, 1), edge(F.array_max, 0), edge(F.array_max, 1))


def detections(objects: DataFrame, calibration: DataFrame, dpi: float = 150.0) -> DataFrame:
    """plan_id, number, and the detection's columns; pixel coordinates at ``dpi``."""
    o = objects.filter("class is not null").join(calibration.select("plan_id", "k"), "plan_id")
    px = G.pixels(_scaled(F.col("ring")), dpi)
    return o.select(
        "plan_id", F.col("number").alias("id"), F.coalesce(_lookup(ELEMENT_TYPE, F.col("class")), F.lit("other")).alias("element_type"), "class", display_label(o).alias("display_label"), "type_key", "type_source", "label",
        F.col("named_by").alias("class_named_by"), "building", F.col("kind").alias("drawing_kind"),
        _px_box(px).alias("bbox_px"), G.pixels(_scaled(F.col("o.obb")), dpi).alias("obb_px"),
        F.struct(F.bround("length", 3).alias("length"), F.bround("width", 3).alias("width")).alias("size_m"), F.bround("o.angle_deg", 1).alias("angle_deg"), F.bround("area", 3).alias("area_m2"),
        F.when(~boxy(o), px).alias("polygon_px"), F.bround("net_length", 2).alias("net_length_m"), F.col("nested").alias("nested_boxes_m"),
    )


OPTIONAL = ["polygon_px", "net_length_m", "nested_boxes_m"]


def json_of(required: list[str], optional: list[str]) -> Column:
    """One JSON object: required columns are there even when null, optional ones only when set."""
    must = F.to_json(F.struct(*required), {"ignoreNullFields": "false"})
    may = F.to_json(F.struct(*optional))
    return F.when(may == "{}", must).otherwise(F.concat(F.substring(must, F.lit(1), F.length(must) - 1), F.lit(","), F.substring(may, F.lit(2), F.length(may))))


def to_json(found: DataFrame) -> DataFrame:
    """plan_id, id, json."""
    return found.select("plan_id", "id", json_of([c for c in found.columns if c not in [*OPTIONAL, "plan_id"]], OPTIONAL).alias("json"))


def class_counts(objects: DataFrame) -> DataFrame:
    order = _lookup({c: i for i, c in enumerate(CLASS_ORDER)}, F.col("class"))
    return objects.filter("class is not null").groupBy("plan_id", "class").agg(F.count(F.lit(1)).alias("n")).withColumn("ord", order)


def _range(name: str, tolerance: float) -> Column:
    """Smallest to largest, one number where they are the same."""
    lo, hi = F.format_string("%.2f", F.min(name)), F.format_string("%.2f", F.max(name))
    return F.when(F.max(name) - F.min(name) <= tolerance, lo).otherwise(F.concat(lo, F.lit("-"), hi))


def description(kind: Column, length: str, width: str, facts: list[tuple[str, str]], holds: Column, tolerance: float) -> Column:
    """An aggregate: what the members of a group have in common, in words. ``kind`` is a grouping column."""
    n = F.count(F.lit(1))
    word = F.when(n == 1, _lookup({k: v[0] for k, v in KIND_WORDS.items()}, kind)).otherwise(_lookup({k: v[1] for k, v in KIND_WORDS.items()}, kind))
    size = F.when(kind == "band", F.concat(_range(width, tolerance), F.lit(" m apart, "), _range(length, tolerance), F.lit(" m long"))).otherwise(F.concat(_range(length, tolerance), F.lit(" x "), _range(width, tolerance), F.lit(" m")))
    most = [F.when(F.count_if(F.col(c) > 0) > n / 2, words) for c, words in facts]
    band = F.when(kind == "band", F.when(F.count_if(holds) > n / 2, "holding filled shapes").otherwise("empty"))
    said = F.concat_ws(", ", *most, band)
    return F.concat(n.cast("string"), F.lit(" "), F.coalesce(word, kind), F.lit(", "), size, F.when(said != "", F.concat(F.lit("; "), said)).otherwise(""))


def unidentified_groups(objects: DataFrame, calibration: DataFrame, dpi: float = 150.0, t: Tolerances = Tolerances()) -> DataFrame:
    """plan_id, place (1 the largest), group, drawing_kind, count, description, members: objects no label could name."""
    o = objects.filter("class is null").join(calibration.select("plan_id", "k"), "plan_id").withColumn("group", rules.group_tag(F.col("cluster")))
    px = G.pixels(_scaled(F.col("ring")), dpi)
    size = F.struct(F.bround("length", 3).alias("length"), F.bround("width", 3).alias("width"))
    member = F.struct(F.col("number").alias("id"), _px_box(px).alias("bbox_px"), G.pixels(_scaled(F.col("o.obb")), dpi).alias("obb_px"), size.alias("size_m"))
    g = o.groupBy("plan_id", "group", F.col("kind").alias("drawing_kind")).agg(
        F.count(F.lit(1)).alias("count"), description(F.col("kind"), "length", "width", GROUP_FACTS, F.col("holds"), t.size_tol).alias("description"), F.array_sort(F.collect_list(member)).alias("members")
    )
    order = Window.partitionBy("plan_id").orderBy(F.desc("count"), "group", "drawing_kind")
    return g.select("plan_id", F.row_number().over(order).alias("place"), "group", "drawing_kind", "count", "description", "members")


def documents(objects: DataFrame, calibration: DataFrame, pages: DataFrame | None = None, dpi: float = 150.0) -> DataFrame:
    """plan_id, json: one document a plan, with image, calibration, counts, detections in order of id, unidentified groups.

    pages: plan_id, width, height in points, where known; else the extent of what was found stands for the page.
    """
    found = to_json(detections(objects, calibration, dpi))
    if pages is None:
        edge = lambda f, c: f(F.transform("ring", lambda p: p[c]))
        pages = objects.join(calibration.select("plan_id", "k"), "plan_id").groupBy("plan_id").agg(F.max(edge(F.array_max, "x") * F.col("k")).alias("width"), F.max(edge(F.array_max, "y") * F.col("k")).alias("height"))
    listed = found.groupBy("plan_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "json"))), lambda x: x["json"]), ","), F.lit("]")).alias("_found"))
    counts = class_counts(objects).groupBy("plan_id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("ord", "class", "n"))), lambda x: F.struct(x["class"], x["n"]))).alias("_counts"))
    groups = unidentified_groups(objects, calibration, dpi)
    groups = groups.select("plan_id", "place", F.to_json(F.struct("group", "drawing_kind", "count", "description", "members"), {"ignoreNullFields": "false"}).alias("_g"))
    groups = groups.groupBy("plan_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "_g"))), lambda x: x["_g"]), ","), F.lit("]")).alias("_groups"))
    all_ = calibration.filter("status = 'ok'").select("plan_id", "k", "scale").join(pages.select("plan_id", "width", "height"), "plan_id", "left")
    for more in (listed, counts, groups):
        all_ = all_.join(more, "plan_id", "left")
    px = lambda c: F.bround(F.col(c) * dpi / 72).cast("int")
    image = F.to_json(F.struct(F.lit(dpi).alias("dpi"), px("width").alias("width_px"), px("height").alias("height_px"), F.lit("pixels of the page rendered at this dpi, origin top-left, y down").alias("coordinates")))
    scale = F.to_json(F.struct(F.bround("k", 4).alias("pt_per_m"), F.concat(F.lit("1/"), F.bround("scale").cast("long").cast("string")).alias("scale")))
    parts = {"source": F.to_json(F.struct(F.col("plan_id").alias("v"))), "image": image, "calibration": scale, "counts": F.coalesce(F.to_json("_counts"), F.lit("{}")), "detections": F.coalesce("_found", F.lit("[]")), "unidentified_groups": F.coalesce("_groups", F.lit("[]"))}
    parts["source"] = F.regexp_extract(parts["source"], r'^\{"v":(.*)\}$', 1)
    return all_.select("plan_id", F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items())), F.lit("}")).alias("json"))


def draw_commands(objects: DataFrame) -> DataFrame:
    """plan_id, layer, colour, ring, bbox, text, anchor: one per object, for any renderer; hidden layers for unnamed groups.

    What is not a box is drawn as its own outline, and its upright box dashed (``bbox``).
    """
    shade = lambda c: "#%02x%02x%02x" % tuple(round(255 * v) for v in c)
    colour = _lookup({k: shade(c) for k, c in CLASS_COLOURS.items()}, F.col("class"))
    edge = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    o = objects.withColumn("_boxy", boxy(objects)).withColumn("_text", display_label(objects))
    box = F.struct(edge(F.array_min, "x").alias("x0"), edge(F.array_min, "y").alias("y0"), edge(F.array_max, "x").alias("x1"), edge(F.array_max, "y").alias("y1"))
    along = F.col("_boxy") & (F.col("width") > 0) & (F.col("length") >= 3 * F.col("width"))
    return o.select(
        "plan_id", F.coalesce("class", F.concat(F.lit("unidentified "), rules.group_tag(F.col("cluster")))).alias("layer"), F.col("class").isNotNull().alias("shown"),
        F.coalesce(colour, F.lit(shade(UNNAMED_COLOUR))).alias("colour"), F.when(F.col("_boxy"), F.col("o.obb")).otherwise(F.col("ring")).alias("ring"), F.when(~F.col("_boxy"), box).alias("bbox"), F.col("_text").alias("text"),
        G.anchor(F.col("o.obb"), 0.6, along, box["x0"], box["y0"]).alias("anchor"), "number",
    )


def to_svg(commands: DataFrame) -> DataFrame:
    """plan_id, layer, svg: a group of shapes and labels per layer, in order of number."""
    points = F.array_join(F.transform("ring", lambda p: F.concat(F.bround(p["x"], 3).cast("string"), F.lit(","), F.bround(p["y"], 3).cast("string"))), " ")
    shape = F.concat(F.lit('<polygon fill="none" stroke="'), "colour", F.lit('" points="'), points, F.lit('"/>'))
    safe = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    dashed = F.format_string('<rect fill="none" stroke="%s" stroke-dasharray="2 2" x="%.3f" y="%.3f" width="%.3f" height="%.3f"/>', F.col("colour"), F.col("bbox.x0"), F.col("bbox.y0"), F.expr("bbox.x1 - bbox.x0"), F.expr("bbox.y1 - bbox.y0"))
    shape = F.when(F.col("bbox").isNull(), shape).otherwise(F.concat(shape, dashed))
    label = F.format_string('<text transform="translate(%.3f %.3f) rotate(%.1f)">%s</text>', F.col("anchor.x"), F.col("anchor.y"), F.col("anchor.angle"), safe)
    rows = commands.withColumn("_svg", F.when(F.col("text").isNull(), shape).otherwise(F.concat(shape, label)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "_svg"))), lambda x: x["_svg"]), "\n")
    g = F.concat(F.lit('<g id="'), "layer", F.lit('" visibility="'), F.when(F.first("shown"), "visible").otherwise("hidden"), F.lit('">\n'), body, F.lit("\n</g>"))
    return rows.groupBy("plan_id", "layer").agg(g.alias("svg"))


def render(commands: DataFrame, pdfs: DataFrame, calibration: DataFrame, dpi: int = 150) -> DataFrame:
    """plan_id, pdf, png: the drawings' own pages with the commands drawn on them in layers. pdfs: plan_id, content.

    Needs PyMuPDF on the executors; says so where it is absent. A task holds one drawing.
    """
    import importlib.util

    if importlib.util.find_spec("pymupdf") is None:
        raise RuntimeError("rendering pages needs PyMuPDF, which is not installed; the SVG layers hold the same drawing")
    k = calibration.select("plan_id", "k")
    point = F.transform("ring", lambda p: F.struct((p["x"] * F.col("k")).alias("x"), (p["y"] * F.col("k")).alias("y")))
    rows = commands.join(k, "plan_id").select("plan_id", "layer", "shown", "colour", point.alias("ring"), "text", (F.col("anchor.x") * F.col("k")).alias("ax"), (F.col("anchor.y") * F.col("k")).alias("ay"), F.col("anchor.angle").alias("angle"))

    def draw(page_rows, shapes):
        import pandas as pd
        import pymupdf

        out = []
        for plan, content in zip(page_rows["plan_id"], page_rows["content"]):
            doc = pymupdf.open(stream=bytes(content), filetype="pdf")
            page, layers = doc[0], {}
            for r in shapes.sort_values(["layer"]).itertuples():
                if r.layer not in layers:
                    layers[r.layer] = doc.add_ocg(r.layer, on=bool(r.shown))
                colour = tuple(int(r.colour[i : i + 2], 16) / 255 for i in (1, 3, 5))
                pts = [pymupdf.Point(p["x"], p["y"]) for p in r.ring]
                page.draw_polyline([*pts, pts[0]], color=colour, width=0.5, oc=layers[r.layer])
                at = pymupdf.Point(r.ax, r.ay)
                page.insert_text(at, r.text or "", fontsize=2.6, color=colour, oc=layers[r.layer], morph=(at, pymupdf.Matrix(-r.angle)) if r.angle else None)
            out.append((plan, doc.tobytes(garbage=3, deflate=True), page.get_pixmap(dpi=dpi).tobytes("png")))
        return pd.DataFrame(out, columns=["plan_id", "pdf", "png"])

    return pdfs.select("plan_id", "content").groupBy("plan_id").cogroup(rows.groupBy("plan_id")).applyInPandas(draw, "plan_id string, pdf binary, png binary")
