"""Detection of drawn elements on any number of plans at once: every relation is keyed by plan_id.

Stages, each a DataFrame in and out: calibrate, scaled, segments, solids, outlines, bands, hatches, stamps, objects,
features, clusters, labels, match, names, regions, types, ids. All coordinates are metres once scaled.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataplan.functions import geometry as G
from strataplan.operators import aggregates as A
from strataplan.operators import joins as J
from strataplan.operators import windows as W
from strataplan.operators.assign import assign
from strataplan.operators.graph import components
from strataplan.operators import shapes as S
from strataplan.operators.shapes import bounds, distinct_shapes, overlaps, with_box
from strataplan.operators.suppress import suppress
from strataplan.operators.ward import ward
from strataplan.plans import grammar, rules
from strataplan.plans import relations as R
from strataplan.runtime import save
from strataplan.tolerances import CLASS_ORDER, FAMILY, LABEL_CLASS, Tolerances

KEY = ["plan_id", "id"]


@dataclass
class Result:
    objects: DataFrame
    labels: DataFrame
    clusters: DataFrame
    matches: DataFrame
    calibration: DataFrame
    log: DataFrame | None = None


lookup = rules.lookup


# --- scale ---------------------------------------------------------------------------------------------------------


def strokes(paths: DataFrame) -> DataFrame:
    """Straight sides of stroked paths: plan_id, seg_id, idx, w, closed, ax, ay, bx, by, len, ang."""
    s = paths.filter(F.col("type").isin("s", "fs")).select("plan_id", "idx", F.bround("width", 2).alias("w"), G.is_closed(F.col("items")).alias("closed"), F.posexplode(G.item_lines(F.col("items"))).alias("part", "s"))
    s = s.select("plan_id", (F.col("idx").cast("long") * (1 << 20) + F.col("part")).alias("seg_id"), "idx", "w", "closed", *(F.col(f"s.{p}.{c}").alias(p + c) for p in "ab" for c in "xy"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    return s.withColumn("len", F.hypot(dx, dy)).withColumn("ang", F.pmod(F.atan2(dy, dx), F.lit(pi))).filter("len > 0")


def glyph_size(texts: DataFrame, share: float) -> DataFrame:
    return texts.groupBy("plan_id").agg((share * F.median(F.least(F.expr("rect.x1 - rect.x0"), F.expr("rect.y1 - rect.y0")))).alias("glyph"))


def calibrate(paths: DataFrame, texts: DataFrame, config: dict) -> DataFrame:
    """One row per plan with texts: k (points per metre), gap, scale, samples, inliers, errors in cm, status."""
    c = config["calibration"]
    glyph = glyph_size(texts, config["text"]["glyph_share_of_text_height"])
    lines = strokes(paths).join(glyph, "plan_id").filter("len > glyph")
    numbers = texts.withColumn("value", grammar.number_of(F.col("text"))).filter("value is not null")
    mid = G.centre(*(F.col(f"rect.{x}") for x in ("x0", "y0", "x1", "y1")))
    size = F.greatest(F.expr("rect.x1 - rect.x0"), F.expr("rect.y1 - rect.y0"))
    point_id = F.concat("plan_id", F.lit("\x00"), "text_id")
    points = numbers.select(point_id.alias("point_id"), F.col("plan_id").alias("plan"), "value", mid["x"].alias("x"), mid["y"].alias("y"), size.alias("size"))
    # Plans lie side by side in the grid, so one join serves all.
    lines = lines.select("plan_id", F.col("seg_id").alias("line_id"), "ax", "ay", "bx", "by")
    samples = nearest_in_plan(points, lines).select("plan_id", "value", "length")
    fit = A.robust_fit(samples, ["plan_id"], "value", "length", c["tolerance"], c["min_value_spread"])
    out = texts.select("plan_id").distinct().join(fit, "plan_id", "left").na.fill(0, ["samples", "inliers"])
    return A.guard(out, c["min_samples"], c["min_inlier_share"]).select(
        "plan_id", "k", "gap", (72 / 25.4 * 1000 / F.col("k")).alias("scale"), "samples", "inliers",
        (F.col("median_error") * 100).alias("median_error_cm"), (F.col("p95_error") * 100).alias("p95_error_cm"), "status",
    )


def nearest_in_plan(points: DataFrame, lines: DataFrame) -> DataFrame:
    p = points.select("point_id", F.col("plan").alias("plan_id"), "value", "x", "y", "size", *(e.alias(n) for n, e in (("p0", F.expr("x - size")), ("q0", F.expr("y - size")), ("p1", F.expr("x + size")), ("q1", F.expr("y + size")))))
    b = lines.select("*", F.least("ax", "bx").alias("lx0"), F.least("ay", "by").alias("ly0"), F.greatest("ax", "bx").alias("lx1"), F.greatest("ay", "by").alias("ly1"))
    near = J.grid_join(p, b, ("p0", "q0", "p1", "q1"), ("lx0", "ly0", "lx1", "ly1"), 100.0, ["plan_id"])
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    px, py = F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
    n = F.hypot(dx, dy)
    sat = near.withColumn("length", n).withColumn("along", (px * dx + py * dy) / n).withColumn("across", F.abs(px * dy - py * dx) / n)
    return J.first_by(sat.filter("along > 0 and along < length and across < size"), ["point_id"], ["across", "line_id"])


def scaled(paths: DataFrame, texts: DataFrame, calibration: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both in metres, of plans whose scale is reliable."""
    ok = calibration.filter("status = 'ok'").select("plan_id", "k")

    def rect(k):
        return F.struct(*((F.col(f"rect.{c}") / k).alias(c) for c in ("x0", "y0", "x1", "y1")))

    k = F.col("k")
    items = F.transform("items", lambda i: F.struct(i["kind"].alias("kind"), F.transform(i["pts"], lambda p: F.struct((p["x"] / k).alias("x"), (p["y"] / k).alias("y"))).alias("pts")))
    return (
        paths.join(ok, "plan_id").select("plan_id", "idx", "type", "filled", "width", rect(k).alias("rect"), items.alias("items")),
        texts.join(ok, "plan_id").select("plan_id", "text_id", "text", rect(k).alias("rect"), (1 / k).alias("pt")),
    )


# --- lines ---------------------------------------------------------------------------------------------------------


def segments(paths: DataFrame, texts: DataFrame, t: Tolerances) -> DataFrame:
    """Strokes that are not text, flagged dashed and axis_pen."""
    s = strokes(paths)
    key = ["plan_id", "seg_id"]
    box = s.select(*key, F.least("ax", "bx").alias("sx0"), F.least("ay", "by").alias("sy0"), F.greatest("ax", "bx").alias("sx1"), F.greatest("ay", "by").alias("sy1"))
    words = texts.select("plan_id", "text_id", *((F.col(f"rect.{c}") + sign * F.col("pt")).alias(f"t{c}") for c, sign in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1))))
    text = R.in_words(box, words, ("sx0", "sy0", "sx1", "sy1"), ("tx0", "ty0", "tx1", "ty1"), 1.2, 5.0, ["plan_id"])
    s = s.join(text.select(*key).distinct(), key, "left_anti")
    return mark_dashed(s, t)


def mark_dashed(s: DataFrame, t: Tolerances) -> DataFrame:
    """Short pieces of one direction and line, eight or more, that leave gaps; and the pen most of them use."""
    angle = F.col("ang")
    s = s.withColumn("_lo", F.least(G.along(F.col("ax"), F.col("ay"), angle), G.along(F.col("bx"), F.col("by"), angle))).withColumn("_hi", F.col("_lo") + F.col("len"))
    keys = ["plan_id", "_a", "_off"]
    s = s.withColumn("_a", F.bround(F.degrees("ang") / t.dash_degrees)).withColumn("_off", F.bround(G.offset(F.col("ax"), F.col("ay"), angle) / t.collinear))
    short = s.filter(F.col("len") <= t.dash_max)
    groups = R.dashed_groups(short, keys, "_lo", "_hi", t.dash_min_pieces, t.dash_cover).select(*keys, F.lit(True).alias("_d"))
    s = s.join(groups, keys, "left").withColumn("dashed", F.coalesce(F.col("_d") & (F.col("len") <= t.dash_max), F.lit(False)))
    pen = A.most_common(s.filter("dashed and w > 0"), ["plan_id"], "w", "seg_id").select("plan_id", F.col("w").alias("_pen"))
    return s.join(pen, "plan_id", "left").withColumn("axis_pen", F.coalesce(F.col("w") == F.col("_pen"), F.lit(False))).drop("_a", "_off", "_d", "_pen", "_lo", "_hi")


def usable(s: DataFrame) -> DataFrame:
    return s.filter("not dashed and not axis_pen")


# --- objects -------------------------------------------------------------------------------------------------------


def _rings(paths: DataFrame) -> DataFrame:
    r = paths.select("plan_id", "idx", F.col("width").alias("pen"), F.posexplode(G.chains(F.col("items"))).alias("part", "ring"))
    return S.repaired(r).withColumn("area", G.area(F.col("ring"))).filter("area > 0").withColumn("id", F.xxhash64("plan_id", "idx", "part"))


def solids(paths: DataFrame, t: Tolerances) -> tuple[DataFrame, DataFrame]:
    """(filled rectangles, each once however often it is drawn, with straight stretches of bent fills; other fills).

    Fills painted one after another that touch are one shape.
    """
    painted = S.paint_groups(_rings(paths.filter("type in ('f', 'fs') and filled")).select("plan_id", "idx", "ring"), t.paint_gap, t.touch)
    painted = painted.withColumn("area", G.area(F.col("ring"))).filter("area > 0").withColumn("id", F.xxhash64("plan_id", "idx", "ring"))
    r = save(with_box(painted), "fills")
    straight = (F.col("o.rectness") > t.rectness) & (F.col("o.width") >= t.min_side)
    as_box = F.when(F.size("ring") == 4, F.col("ring")).otherwise(F.col("o.obb"))
    boxes = distinct_shapes(save(r.filter(straight).withColumn("ring", as_box), "rectangles"), t.dup_iou)
    other = r.filter(~straight)
    usual = boxes.groupBy("plan_id").agg(F.median("o.width").alias("_w"))
    bent = other.join(usual, "plan_id", "left").filter(
        (F.col("area") >= t.bent_fill_min_area) & rules.thin_fill(F.col("area"), G.perimeter(F.col("ring")), F.coalesce(2 * F.col("_w"), F.lit(t.thin_default)))
    )
    legs = S.stretches(bent, boxes, t.stretch_thickness, t.stretch_min_len).withColumn("id", F.xxhash64("plan_id", "of", "part", "ring")).withColumn("area", G.area(F.col("ring")))
    every = save(boxes.select("plan_id", "id", "ring", "o", "area").unionByName(with_box(legs).select("plan_id", "id", "ring", "o", "area")), "solids")
    pens = outline_pens(paths, every, t)
    return every.join(pens, KEY, "left").select("plan_id", "id", F.lit("solid").alias("kind"), "ring", "o", "area", F.coalesce("outline_pen", F.lit(0.0)).alias("pen")), other.select("plan_id", "id", "ring", "area")


def outline_pens(paths: DataFrame, found: DataFrame, t: Tolerances) -> DataFrame:
    """plan_id, id, outline_pen: of the strokes that run along a shape's border."""
    lines = strokes(paths.filter("type = 's'"))
    on = R.on_borders(lines, R.sides_of(found, "id"), t.on_border, per=["id"]).join(lines.select("plan_id", "seg_id", "w"), ["plan_id", "seg_id"])
    on = on.join(found.select(*KEY, G.perimeter(F.col("ring")).alias("_border")), KEY).withColumn("_on", F.col("share") * F.col("len"))
    return R.pen_along(on, KEY, "w", "_on", "len", "_border")


def outlines(paths: DataFrame, found: DataFrame, t: Tolerances) -> DataFrame:
    """Closed stroked rectangles that are not the border of something found by its fill or hatch, nor of a stamped region."""
    closed = paths.filter("type = 's'").filter(G.is_closed(F.col("items")))
    r = with_box(_rings(closed).filter((F.col("area") >= t.outline_min_area) & (F.col("area") <= t.outline_max_area)))
    r = distinct_shapes(save(r.filter(F.col("o.rectness") > t.outline_rectness), "outlines"), 0.96)
    walls = found.filter("kind <> 'stamped_region'")
    border = R.covered_shares(r, walls, t.grow).filter("share > 0.8").select(*KEY)
    alike = overlaps(r, found.select("plan_id", "id", "ring")).filter("common > 0.8 * area_a and common > 0.8 * area_b").select("plan_id", F.col("a").alias("id"))
    left = r.join(border.unionByName(alike).distinct(), KEY, "left_anti")
    return left.select("plan_id", "id", F.lit("outline").alias("kind"), "ring", "o", "area", "pen")


def nested_boxes(shapes: DataFrame, t: Tolerances) -> DataFrame:
    """Outlines inside another around one centre leave; the outer one keeps their sizes, largest first."""
    o = shapes.select("plan_id", "id", "ring", "area", "o", ((F.col("ring")[0]["x"] + F.col("ring")[2]["x"]) / 2).alias("cx"), ((F.col("ring")[0]["y"] + F.col("ring")[2]["y"]) / 2).alias("cy"))
    pairs = overlaps(o, o).filter("a <> b and area_b < area_a and common >= 0.95 * area_b")
    a = o.select(F.col("id").alias("a"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("o.angle_deg").alias("aa"))
    b = o.select(F.col("id").alias("b"), F.col("cx").alias("bx"), F.col("cy").alias("by"), F.col("o.angle_deg").alias("ba"), F.col("o.length").alias("l"), F.col("o.width").alias("w"))
    centred = pairs.join(a, "a").join(b, "b").filter((F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) <= t.size_tol) & (G.folded_degrees(F.col("aa"), F.col("ba")) <= t.parallel_deg))
    outer = centred.join(centred.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
    sizes = outer.groupBy(F.col("a").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.bround("l", 3).alias("length"), F.bround("w", 3).alias("width"))), False).alias("nested"))
    return shapes.join(centred.select(F.col("b").alias("id")).distinct(), "id", "left_anti").join(sizes, "id", "left")


def band_pairs(s: DataFrame, found: DataFrame, t: Tolerances) -> DataFrame:
    """Facing parallel lines of one pen with spacing, extent, lines between and the share filled by solids."""
    angle = F.bround(F.col("ang") / 0.005) * 0.005
    lines = usable(s).filter(F.col("len") >= t.line_min).withColumn("a", F.pmod(angle, F.lit(pi)))
    at = F.col("a")
    lo, hi = (f(G.along(F.col("ax"), F.col("ay"), at), G.along(F.col("bx"), F.col("by"), at)) for f in (F.least, F.greatest))
    off = (G.offset(F.col("ax"), F.col("ay"), at) + G.offset(F.col("bx"), F.col("by"), at)) / 2
    lines = save(lines.select("plan_id", "w", "a", "closed", "idx", F.col("seg_id").alias("id"), off.alias("off"), lo.alias("lo"), hi.alias("hi")), "band-lines")
    on = ["plan_id", "w", "a"]
    pairs = J.parallel_pairs(lines, on, t.band_min, t.band_max, overlap=t.overlap_min)
    side = lines.select(*on, "id", "closed", "idx")
    pairs = pairs.join(J.renamed(side, "i_", on).withColumnRenamed("i_id", "i"), [*on, "i"]).join(J.renamed(side, "j_", on).withColumnRenamed("j_id", "j"), [*on, "j"])
    pairs = pairs.filter((~F.col("i_closed") & ~F.col("j_closed")) | (F.col("i_idx") == F.col("j_idx")))
    pairs = J.between(pairs, lines, on, t.inside_margin, 0.3, t.band_max)
    mid = (F.col("off_i") + F.col("off_j")) / 2
    pairs = pairs.withColumn("ring", G.run_polygon(F.col("a"), mid, F.col("from"), F.col("to"), F.col("spacing"))).withColumn("id", F.xxhash64("plan_id", "i", "j"))
    pairs = save(pairs.withColumn("mid", mid).withColumn("overlap", F.col("to") - F.col("from")), "band-pairs")
    # Lines that run along a solid's border are its edge: they bound no band, and between two lines they are no other element's.
    lined = usable(s).filter(F.col("len") >= t.line_min)
    edge = save(R.on_borders(lined, R.sides_of(found), t.on_border).filter("share > 0.5").select("plan_id", F.col("seg_id").alias("_e")), "edge-lines")
    own = [pairs.join(edge.withColumnRenamed("_e", side), ["plan_id", side], "left_semi").select("id") for side in "ij"]
    bounded = own[0].unionByName(own[1]).distinct()
    foreign = lines.join(edge.withColumnRenamed("_e", "id"), ["plan_id", "id"], "left_anti")
    strange = J.between(pairs.drop("inside"), foreign, on, t.inside_margin, 0.3, t.band_max).select("id", F.col("inside").alias("foreign_inside"))
    fill = overlaps(pairs, found.select("plan_id", "id", "ring")).groupBy(F.col("a").alias("id")).agg((F.sum("common") / F.max("area_a")).alias("filled"))
    pairs = pairs.join(fill, "id", "left").join(hatched_pairs(pairs, s, t), "id", "left").join(strange, "id").join(bounded.withColumn("edges_on_solid", F.lit(True)), "id", "left")
    pairs = pairs.na.fill(0.0, ["filled"]).na.fill(False, ["hatched", "edges_on_solid"])
    return pairs.withColumn("filled", F.when(F.col("hatched"), F.greatest(F.col("filled"), F.lit(1.0))).otherwise(F.col("filled")))


def hatched_pairs(pairs: DataFrame, s: DataFrame, t: Tolerances) -> DataFrame:
    """id, hatched: pairs with one family of short oblique strokes between them along most of their length."""
    short = usable(s).filter(F.col("len") < t.stroke_max).select("plan_id", "seg_id", "ax", "ay", "bx", "by", F.col("ang").alias("sang"))
    near = J.grid_join(bounds(pairs.select("plan_id", "id", "ring", "a", "from", "to", "mid", "spacing", "overlap")), R.boxed(short, "s"), R.BOX, R.prefixed("s"), 2.0, ["plan_id"], t.stroke_reach)
    at, half = F.col("a"), F.col("spacing") / 2 + t.stroke_reach
    within = F.lit(True)
    for p in "ab":
        u, v = G.along(F.col(f"{p}x"), F.col(f"{p}y"), at), G.offset(F.col(f"{p}x"), F.col(f"{p}y"), at)
        within = within & (u >= F.col("from") - t.stroke_reach) & (u <= F.col("to") + t.stroke_reach) & (F.abs(v - F.col("mid")) <= half)
    inner = near.filter(within & (F.abs(F.sin(F.col("sang") - at)) > 0.3))
    inner = inner.select("id", F.bround(F.degrees("sang") / 5).alias("dir"), G.along((F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2, at).alias("at"), "overlap")
    return R.hatched(inner, ["id"], "dir", "at", "overlap", 3.0, t.hatch_spread).select("id", F.lit(True).alias("hatched"))


def paired(t: Tolerances) -> Column:
    """Pairs that make a family: two lines with nothing between them, or that hold a solid, and no edge on a solid's face."""
    holds = (F.col("filled") >= t.band_holds[0]) & (F.col("foreign_inside") == 0)
    return ~F.col("edges_on_solid") & (F.col("filled") <= t.band_holds[1]) & ((F.col("inside") == 0) | holds)


def band_families(pairs: DataFrame, t: Tolerances) -> DataFrame:
    """plan_id, family width, share filled: peaks of the paired length by spacing, at the median spacing under each."""
    p = pairs.filter(paired(t))
    h = W.histogram(p, ["plan_id"], "spacing", "overlap", t.band_bin, int(t.band_max / t.band_bin) + 2)
    tops = W.peaks(h, ["plan_id"], t.band_peak_min, t.band_peak_share).select("plan_id", F.col("bin").cast("double").alias("bin"))
    under = J.band_join(tops.withColumn("_at", F.col("bin") * t.band_bin), p.select("plan_id", "spacing", "overlap"), "_at", "spacing", 1.5 * t.band_bin, ["plan_id"])
    width = A.weighted_median(under, ["plan_id", "bin"], "spacing", "overlap", "width").withColumn("width", F.bround("width", 3))
    kept = W.accepted_ascending(width, ["plan_id"], "width", t.band_tol)
    pieces = J.band_join(kept, p.select("plan_id", "spacing", "overlap", "filled"), "width", "spacing", t.band_tol, ["plan_id"])
    return A.weighted_mean(pieces, ["plan_id", "width"], F.col("filled"), F.col("overlap"), "share")


def band_runs(pieces: DataFrame, t: Tolerances) -> DataFrame:
    """Runs of pieces (band: their width) on one line, gaps closed; a run inside a longer one is a duplicate."""
    p = pieces.withColumn("_line", F.bround(F.col("mid") / t.band_offset))
    keys = ["plan_id", "band", "a", "_line"]
    runs = W.islands(p, keys, "from", "to", t.band_run_gap, "id").groupBy(*keys, "island").agg(
        F.min("from").alias("lo"), F.max("to").alias("hi"), F.min_by("mid", F.struct("from", "id")).alias("off"), F.first("share").alias("share"), F.min("w").alias("pen")
    )
    ring = G.run_polygon(F.col("a"), F.col("off"), F.col("lo"), F.col("hi"), F.col("band"))
    runs = runs.withColumn("ring", ring).withColumn("id", F.xxhash64(*keys, "island")).withColumn("area", (F.col("hi") - F.col("lo")) * F.col("band")).withColumn("span", F.col("hi") - F.col("lo"))
    runs = save(runs, "runs")
    # Inside another, grown by run_dup: less than its whole area may stick out by the tolerance along its sides.
    wider = save(runs.select("plan_id", "id", R.grown_run(t.run_dup).alias("ring")), "wider-runs")
    within = overlaps(runs, wider).filter((F.col("a") != F.col("b")) & (F.col("common") >= F.col("area_a") * (1 - 1e-9)))
    ranked = runs.select("id", F.struct((-F.col("span")).alias("s"), "id").alias("rank"))
    size = runs.select("id", "span")
    longer = within.join(size.select(F.col("id").alias("a"), F.col("span").alias("sa")), "a").join(size.select(F.col("id").alias("b"), F.col("span").alias("sb")), "b")
    longer = longer.filter((F.col("sb") > F.col("sa")) | ((F.col("sb") == F.col("sa")) & (F.col("b") < F.col("a"))))
    return runs.join(suppress(ranked, longer.select("a", "b")), "id", "left_semi")


def bands(pairs: DataFrame, families: DataFrame, t: Tolerances) -> DataFrame:
    p = J.band_join(families.select("plan_id", F.col("width").alias("band"), "share"), pairs, "band", "spacing", t.band_tol, ["plan_id"])
    runs = band_runs(p.filter(paired(t)), t)
    return runs.select(
        "plan_id", "id", F.lit("band").alias("kind"), "ring", G.oriented_rectangle(F.col("ring")).alias("r"), "area", "pen", "band", (F.col("share") >= t.band_holding).alias("holds"), "span",
        *(e.alias(n) for n, e in _axis_ends()),
    )


def _axis_ends():
    for p, u in (("a", "lo"), ("b", "hi")):
        yield f"{p}x", F.col(u) * F.cos("a") - F.col("off") * F.sin("a")
        yield f"{p}y", F.col(u) * F.sin("a") + F.col("off") * F.cos("a")


def hatches(s: DataFrame, t: Tolerances) -> DataFrame:
    """Areas of many short parallel strokes: their box, whether two families cross, and the number of strokes."""
    c = s.filter((F.col("len") >= t.hatch_len[0]) & (F.col("len") <= t.hatch_len[1]))
    c = c.select("plan_id", "seg_id", "len", "ang", "ax", "ay", "bx", "by", F.least("ax", "bx").alias("x0"), F.least("ay", "by").alias("y0"), F.greatest("ax", "bx").alias("x1"), F.greatest("ay", "by").alias("y1"))
    other = J.renamed(c, "t_", ["plan_id"])
    box, tbox = ("x0", "y0", "x1", "y1"), ("t_x0", "t_y0", "t_x1", "t_y1")
    near = J.grid_join(c, other, box, tbox, 1.0, ["plan_id"], t.hatch_search).filter("seg_id <> t_seg_id")
    twin = G.parallel(F.col("ang"), F.col("t_ang"), 0.02) & (F.abs(F.col("t_len") - F.col("len")) < 0.15 * F.col("len"))
    has = near.filter(twin).groupBy("plan_id", "seg_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= t.hatch_neighbours).drop("n")
    h = save(c.join(has, ["plan_id", "seg_id"], "left_semi"), "hatch-strokes")
    node = F.concat("plan_id", F.lit("\x00"), "seg_id")
    close = J.grid_join(h, J.renamed(h, "t_", ["plan_id"]), box, tbox, 1.0, ["plan_id"], 2 * t.hatch_gap).filter("seg_id < t_seg_id")
    roots = components(close.select(node.alias("u"), F.concat("plan_id", F.lit("\x00"), "t_seg_id").alias("v")))
    m = h.withColumn("node", node).join(roots, "node")
    big = with_box(S.hatch_blobs(m, ["plan_id", "root"], t.hatch_min_strokes, t.hatch_gap, t.hatch_local))
    length = F.col("area") / F.nullif("thickness", F.lit(0.0))
    big = big.filter(length >= t.hatch_min_len)
    kind = F.when(F.col("crossed"), "cross_hatch").otherwise("single_hatch")
    box = F.struct(F.col("o.length").alias("length"), F.col("o.width").alias("width"), F.col("o.angle_deg").alias("angle_deg"), F.coalesce(F.col("area") / F.nullif(F.col("o.length") * F.col("o.width"), F.lit(0.0)), F.lit(0.0)).alias("rectness"), F.col("o.obb").alias("obb"))
    return big.select("plan_id", F.xxhash64("plan_id", "root").alias("id"), kind.alias("kind"), F.col("o.obb").alias("ring"), box.alias("o"), "area", F.lit(0.0).alias("pen"), "strokes", "stroke_len", "thickness", length.alias("hatch_length"))


def legs_of_hatches(found: DataFrame, pairs: DataFrame, t: Tolerances) -> DataFrame:
    """Hatched areas, the bent ones as the straight legs between their border lines."""
    pieces = pairs.filter("hatched and inside = 0").withColumn("band", F.bround("spacing", 2)).withColumn("share", F.lit(0.0))
    legs = band_runs(pieces, t)
    crossed, rest = found.filter("kind = 'cross_hatch'"), found.filter("kind <> 'cross_hatch'")
    share = overlaps(legs, crossed.select("plan_id", "id", "ring")).select("plan_id", F.col("a").alias("leg"), F.col("b").alias("region"), (F.col("common") / F.col("area_a")).alias("share"))
    stay, used = R.replaced_by_legs(crossed.withColumn("rectness", F.col("o.rectness")), legs, share)
    used = save(used.select("plan_id", "id", "ring", "area", "region"), "legs")
    ranked = used.select("id", F.struct((-F.col("area")).alias("s"), "id").alias("rank"))
    clash = overlaps(used, used).filter("a < b and common >= 0.5 * least(area_a, area_b)").select("a", "b")
    used = with_box(used.join(suppress(ranked, clash), "id", "left_semi"))
    of = found.select("plan_id", F.col("id").alias("region"), "strokes", "stroke_len")
    used = used.join(of, ["plan_id", "region"]).select(
        "plan_id", "id", F.lit("cross_hatch").alias("kind"), "ring", "o", "area", F.lit(0.0).alias("pen"), "strokes", "stroke_len",
        F.least("o.width", F.lit(1.0)).alias("thickness"), F.col("o.length").alias("hatch_length"), F.lit(True).alias("leg_of_region"),
    )
    return rest.unionByName(stay.drop("rectness")).unionByName(used, allowMissingColumns=True)


def one_wall_once(fills: DataFrame, hatched: DataFrame, t: Tolerances) -> tuple[DataFrame, DataFrame]:
    """(solids, hatched areas): a wall that is filled and hatched is one solid, which takes the extent of both."""
    shape = lambda df: df.select("plan_id", "id", F.col("o.width").alias("width"), F.col("o.angle_deg").alias("deg"), "area")
    pairs = overlaps(hatched.select("plan_id", "id", "ring"), fills.select("plan_id", "id", "ring"))
    twice = save(R.drawn_twice(shape(hatched), shape(fills), pairs, t.size_tol, t.parallel_deg), "drawn-twice")
    more = twice.join(hatched.select("plan_id", F.col("id").alias("hatch"), F.col("o.obb").alias("_more")), ["plan_id", "hatch"]).groupBy("plan_id", F.col("solid").alias("id")).agg(F.flatten(F.collect_list("_more")).alias("_more"))
    grown = with_box(fills.join(more, KEY).withColumn("_all", F.concat("ring", "_more")), "_all", "_box")
    box = F.struct(*(F.col(f"_box.{c}").alias(c) for c in ("length", "width", "angle_deg")), F.lit(1.0).alias("rectness"), F.col("_box.obb").alias("obb"))
    grown = grown.select("plan_id", "id", "kind", F.col("_box.obb").alias("ring"), box.alias("o"), (F.col("_box.length") * F.col("_box.width")).alias("area"), "pen")
    fills = fills.join(more, KEY, "left_anti").unionByName(grown)
    return fills, hatched.join(twice.select("plan_id", F.col("hatch").alias("id")), KEY, "left_anti")


def borders_of_walls(closed: DataFrame, walls: DataFrame, t: Tolerances) -> tuple[DataFrame, DataFrame]:
    """(outlines that are no wall's border; (wall, ring, o) of walls that take their outline's exact shape)."""
    covered = R.covered_shares(closed, walls, t.grow).filter("share > 0.8").select(*KEY)
    left = save(closed.join(covered, KEY, "left_anti"), "open-outlines")
    hatch = walls.filter("kind <> 'solid'")
    grown = save(left.select("plan_id", "id", R.grown_box(t.grow).alias("ring")), "grown-outlines")
    share = overlaps(hatch.select("plan_id", "id", "ring"), grown).select("plan_id", F.col("a").alias("wall"), F.col("b").alias("outline"), (F.col("common") / F.col("area_a")).alias("share"), F.col("area_a").alias("wall_area"))
    share = share.join(left.select("plan_id", F.col("id").alias("outline"), F.col("o.angle_deg").alias("outline_deg")), ["plan_id", "outline"]).join(hatch.select("plan_id", F.col("id").alias("wall"), F.col("o.angle_deg").alias("wall_deg")), ["plan_id", "wall"])
    taken = R.wall_in_outline(share, t.parallel_deg)
    shape = left.select("plan_id", F.col("id").alias("outline"), F.col("ring").alias("_ring"), F.col("o").alias("_o"), F.col("area").alias("_area"))
    new = J.first_by(taken.join(shape, ["plan_id", "outline"]), ["plan_id", "wall"], [F.desc("_area"), "outline"])
    return left.join(taken.select("plan_id", F.col("outline").alias("id")), KEY, "left_anti"), new.select("plan_id", F.col("wall").alias("id"), "_ring", "_o")


def stamps(paths: DataFrame, s: DataFrame, walls: DataFrame, t: Tolerances) -> DataFrame:
    """Circles that at least three long lines from different directions end on, first come first: the outline those lines
    point to, or their far ends' hull."""
    circle = G.circle_of(F.col("items"), *(F.col(f"rect.{x}") for x in ("x0", "y0", "x1", "y1")))
    c = paths.filter("type = 's'").withColumn("c", circle).filter("c is not null").select("plan_id", "idx", "c.cx", "c.cy", "c.r")
    rays = s.filter((F.col("len") >= t.ray_min) & ~F.col("dashed")).select("plan_id", "seg_id", "ax", "ay", "bx", "by", "ang")
    found = save(R.stamped(R.ray_hits(c, rays, t.ray_start, t.ray_reach)).withColumn("id", F.xxhash64("plan_id", "idx", F.lit("stamp"))), "stamps")
    near = J.grid_join(found.select("plan_id", "id", "idx", "cx", "cy", "r"), J.renamed(found.select("plan_id", "id", "idx", "cx", "cy"), "e_", ["plan_id"]), ("cx", "cy", "cx", "cy"), ("e_cx", "e_cy", "e_cx", "e_cy"), 2.0, ["plan_id"], 1.0)
    later = near.filter("e_idx < idx and hypot(cx - e_cx, cy - e_cy) < r").select(F.col("id").alias("a"), F.col("e_id").alias("b"))
    found = found.join(suppress(found.select("id", F.struct("idx", "id").alias("rank")), later), "id", "left_semi")
    lines = usable(s).filter(F.col("len") >= t.trace_min_line)
    g = with_box(S.traced_outlines(found.select("plan_id", "idx", "id", "cx", "cy", "rays", "corners"), lines, walls, t.trace_zone, t.trace_snap, t.trace_wall_reach))
    return g.select("plan_id", "id", F.lit("stamped_region").alias("kind"), "ring", "o", G.area(F.col("ring")).alias("area"), F.lit(0.0).alias("pen"), "traced", F.col("cx").alias("stamp_x"), F.col("cy").alias("stamp_y"))


def objects(paths: DataFrame, texts: DataFrame, t: Tolerances) -> tuple[DataFrame, DataFrame]:
    """(objects, segments): everything found by geometry alone, near the filled shapes."""
    segs = save(segments(paths, texts, t), "segments")
    fills, loose = solids(paths, t)
    fills, loose = save(fills, "solid-objects"), save(loose.filter(F.col("area") > 0.02), "loose-fills")
    hatched = save(hatches(segs, t), "hatches")
    rafts = save(stamps(paths, segs, fills.select("plan_id", "ring"), t), "rafts")
    shape = ["plan_id", "id", "kind", "ring"]
    found = fills.select(*shape).unionByName(hatched.filter("kind = 'cross_hatch'").select(*shape)).unionByName(loose.select("plan_id", "id", F.lit("fill").alias("kind"), "ring"))
    closed = save(outlines(paths, found.unionByName(rafts.select(*shape)), t), "closed")
    pairs = save(band_pairs(segs, found, t), "pairs")
    hatched = save(legs_of_hatches(hatched, pairs, t), "hatched")
    fills, hatched = one_wall_once(fills, hatched, t)
    fills, hatched = save(fills, "solid-objects"), save(hatched, "hatched")
    walls = fills.select(*shape, "o").unionByName(hatched.select(*shape, "o"))
    closed, bordered = borders_of_walls(closed, walls, t)
    closed, bordered = save(nested_boxes(closed, t), "closed"), save(bordered, "bordered")
    hatched = hatched.join(bordered, KEY, "left").withColumn("ring", F.coalesce("_ring", "ring")).withColumn("o", F.coalesce("_o", "o")).drop("_ring", "_o")
    runs = save(bands(pairs, band_families(pairs, t), t), "bands")
    runs = runs.join(R.net_lengths(runs, closed), KEY, "left").withColumn("net_length", F.col("span") - F.coalesce("crossed", F.lit(0.0)))
    runs = runs.withColumn("o", F.struct(F.col("r.length").alias("length"), F.col("r.width").alias("width"), F.col("r.angle_deg").alias("angle_deg"), F.col("r.rectness").alias("rectness"), F.col("ring").alias("obb"))).drop("r", "crossed", "ax", "ay", "bx", "by")
    every = fills
    for more in (hatched, rafts, closed, runs):
        every = every.unionByName(more, allowMissingColumns=True)
    measured = (F.col("kind") == "cross_hatch") & F.col("thickness").isNotNull()
    every = every.withColumn("length", F.coalesce("span", F.when(measured, F.col("hatch_length")), F.col("o.length"))).withColumn("width", F.coalesce("band", F.when(measured, F.col("thickness")), F.col("o.width")))
    every = save(every.withColumn("holds", F.coalesce("holds", F.lit(False))), "every")
    # The drawing area: within reach of a solid (title blocks and legends have none).
    near = J.grid_join(bounds(every.select(*KEY, "ring")).select(*KEY, *_middle()), J.renamed(bounds(fills.select("plan_id", F.col("id").alias("s"), "ring")), "s_", ["plan_id"]), ("mx", "my", "mx", "my"), ("s_x0", "s_y0", "s_x1", "s_y1"), t.area_buffer, ["plan_id"], t.area_buffer)
    near = near.filter(J.box_distance(*(F.col(c) for c in ("mx", "my", "s_x0", "s_y0", "s_x1", "s_y1"))) <= t.area_buffer).select(*KEY).distinct()
    return save(every.join(near, KEY, "left_semi"), "objects"), segs


def _middle():
    return [((F.col("x0") + F.col("x1")) / 2).alias("mx"), ((F.col("y0") + F.col("y1")) / 2).alias("my")]


# --- features and clusters -----------------------------------------------------------------------------------------


def features(objs: DataFrame, paths: DataFrame, t: Tolerances) -> DataFrame:
    """Objects with counts of what lies in and around them; mx, my is the middle of their box."""
    o = bounds(objs)
    box, obox = R.BOX, R.prefixed("q_")
    other = J.renamed(o.select("plan_id", "id", *box), "q_", ["plan_id"])
    touch = J.grid_join(o.select("plan_id", "id", *box), other, box, obox, 4.0, ["plan_id"], t.touch).filter("id <> q_id")
    touch = touch.select("plan_id", "id", F.col("q_id").alias("b"), F.lit(True).alias("touching"))
    share = overlaps(objs, objs, grow=t.touch).filter("a <> b").select("plan_id", F.col("a").alias("id"), "b", "area_a", "area_b", "common")
    around = touch.join(share, ["plan_id", "id", "b"], "full").na.fill(False, ["touching"]).join(objs.select("plan_id", F.col("id").alias("b"), F.col("kind").alias("kb"), F.col("holds").alias("hb")), ["plan_id", "b"])
    strips = R.covered_shares(objs.filter("kind <> 'band'"), objs.filter("kind = 'band' and holds"), 0.0).filter("share > 0.5").select(*KEY, F.lit(1).alias("in_band_holding_solid"))
    dots = paths.filter(F.greatest(F.expr("rect.x1 - rect.x0"), F.expr("rect.y1 - rect.y0")) < t.dot_max).select("plan_id", F.expr("(rect.x0 + rect.x1) / 2").alias("dx"), F.expr("(rect.y0 + rect.y1) / 2").alias("dy"))
    spots = J.grid_join(o.select("plan_id", "id", "ring", *box), dots, box, ("dx", "dy", "dx", "dy"), 4.0, ["plan_id"]).filter(G.inside(F.col("dx"), F.col("dy"), F.col("ring"))).groupBy(*KEY).agg(F.count(F.lit(1)).alias("dots_inside"))
    counts = ["touches_solid", "empty_bands_touching", "solids_inside", "inside_outline", "in_band_holding_solid", "on_stamped_region", "dots_inside"]
    f = o.join(R.feature_counts(around, KEY), KEY, "left").join(strips, KEY, "left").join(spots, KEY, "left").na.fill(0, counts)
    top = f.groupBy("plan_id").agg(F.max(F.when(F.col("kind") == "solid", F.col("pen"))).alias("_top"))
    f = f.join(top, "plan_id").withColumn("outline_pen", F.when(F.col("kind") == "solid", F.coalesce(F.col("pen") / F.nullif("_top", F.lit(0.0)), F.lit(0.0))).otherwise(0.0)).drop("_top")
    f = f.withColumn("nested_boxes", (F.coalesce(F.size("nested"), F.lit(0)) > 0).cast("int")).select("*", *_middle())
    return f.join(perimeter(f, t), KEY, "left").withColumn("on_perimeter", F.coalesce("on_perimeter", F.lit(0)))


def perimeter(f: DataFrame, t: Tolerances) -> DataFrame:
    """plan_id, id, on_perimeter: walls beside and parallel to the edge of the building's footprint."""
    walls = f.filter("kind in ('solid', 'cross_hatch')")
    at = f.filter("kind in ('solid', 'cross_hatch', 'outline')").select("plan_id", F.col("id").cast("string").alias("point"), F.col("mx").alias("x"), F.col("my").alias("y"))
    none = at.select("plan_id", *(F.col("x").alias(c) for c in ("ax", "ay", "bx", "by"))).limit(0)
    sites = S.footprints(walls, at, none, t.footprint_grow, t.footprint_close, t.joint_cut, t.region_min_area)
    near = sites.filter(F.col("edge") <= t.footprint_grow + t.edge_margin).select("plan_id", F.col("point").cast("long").alias("id"), "edge_dir")
    along = R.runs_along(F.col("edge_dir"), F.col("o.angle_deg"), t.parallel_deg)
    return f.join(near, KEY).filter(along).select(*KEY, F.lit(1).alias("on_perimeter"))


def vectors(f: DataFrame) -> DataFrame:
    """Features and weights of solids and outlines. Logarithms are standardised per plan and kind."""
    cap = lambda c, n: F.least(F.col(c), F.lit(n)) / n
    f = f.withColumn("ll", F.ln(F.greatest("length", F.lit(0.05)))).withColumn("lw", F.ln(F.greatest("width", F.lit(0.05)))).withColumn("la", F.ln(F.greatest(F.col("length") / F.nullif("width", F.lit(0.0)), F.lit(1.0))))
    f = A.z_scores(f.filter("kind in ('solid', 'outline')").na.fill(0.0, ["la"]), ["plan_id", "kind"], ["ll", "lw", "la"])
    ec2 = F.when(rules.column_section_cm(F.col("length"), F.col("width")), 1.0).otherwise(0.0)
    solid = [F.col("ll"), F.col("lw"), F.col("la"), ec2 * 2.0, cap("touches_solid", 2) * 3.0, F.col("inside_outline") * 0.7, F.col("in_band_holding_solid") * 1.0, F.col("on_stamped_region") * 0.7, F.col("outline_pen") * 3.0, F.col("on_perimeter") * 2.0]
    nested = F.col("nested_boxes") * 3.0
    outline = [F.col("ll"), F.col("lw"), cap("solids_inside", 3) * 3.0, F.least(F.log1p("dots_inside") / 4, F.lit(1.0)), cap("empty_bands_touching", 3) * 0.5, nested]
    return f.withColumn("x", F.when(F.col("kind") == "solid", F.array(*[c.cast("double") for c in solid])).otherwise(F.array(*[c.cast("double") for c in outline]))).select("plan_id", "kind", "id", "x")


def clusters(f: DataFrame, t: Tolerances) -> DataFrame:
    """plan_id, id, cluster (a name): by Ward for solids and outlines, by width for bands, by kind for the rest."""
    w = ward(vectors(f), ["plan_id", "kind"], "id", "x", t.clusters[0], t.clusters[1], 3 * t.clusters[0]).select("plan_id", "id", F.concat_ws(" ", "kind", F.col("cluster").cast("string")).alias("cluster"))
    rest = f.filter("kind not in ('solid', 'outline')").select("plan_id", "id", F.when(F.col("kind") == "band", F.concat(F.lit("band "), F.bround("band", 3).cast("string"))).otherwise(F.col("kind")).alias("cluster"))
    return w.unionByName(rest)


# --- labels and names ----------------------------------------------------------------------------------------------


def labels(texts: DataFrame, paths: DataFrame, config: dict, t: Tolerances) -> DataFrame:
    """Every label of the plans: plan_id, label_id, text_id, kind, key, wall_key, building, numbers, x, y, dir, text_len."""
    anchored, banded = grammar.rules_of(config)
    base = texts.select("plan_id", "text_id", "text", F.expr("(rect.x0 + rect.x1) / 2").alias("x"), F.expr("(rect.y0 + rect.y1) / 2").alias("y"))
    own = grammar.parsed_labels(base, "text", anchored).drop("dims")
    band = grammar.band_labels(base, "text", banded)
    regions = config["region_labels"]
    raft = base.filter(grammar.region_word(F.col("text"), regions["raft"]["pattern"], regions["raft"].get("exclude")))
    said = F.nullif(F.regexp_extract("text", regions["raft"]["thickness"], 1), F.lit(""))
    numbers = base.filter(F.col("text").rlike(f"^(?:{regions['raft']['number']})$")).select("plan_id", F.col("text_id").alias("n_id"), F.col("text").alias("n_text"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    under = J.nearest_join(raft, numbers, "text_id", "n_id", ("x", "y"), ("nx", "ny"), t.label_radius, 1, ["plan_id"]).select("plan_id", "text_id", "n_text")
    raft = raft.join(under, ["plan_id", "text_id"], "left").select(*base.columns, F.lit("raft").alias("kind"), F.concat_ws(" ", F.lit(regions["raft"]["key"]), F.coalesce(said, "n_text")).alias("key"))
    pit = base.filter(grammar.region_word(F.col("text"), regions["pit"]["pattern"])).select(*base.columns, F.lit("pit").alias("kind"), F.lit(regions["pit"]["key"]).alias("key"))
    every = own
    for more in (band, raft, pit):
        every = every.unionByName(more, allowMissingColumns=True)
    # One text that names a wall and the strip under it is one label with the strip's key.
    wall = F.when(F.col("kind") == "retaining_wall", F.col("key"))
    per_text = every.groupBy("plan_id", "text_id").agg(F.collect_set("kind").alias("_kinds"), F.min(wall).alias("wall_key"))
    every = every.join(per_text, ["plan_id", "text_id"])
    both = F.array_contains("_kinds", "retaining_wall") & F.array_contains("_kinds", "strip_footing")
    every = every.filter(~(both & (F.col("kind") == "retaining_wall"))).withColumn("kind", F.when(both & (F.col("kind") == "strip_footing"), "retaining_wall+strip_footing").otherwise(F.col("kind")))
    every = every.join(text_directions(texts, paths), ["plan_id", "text_id"], "left")
    return every.drop("_kinds").withColumn("label_id", F.xxhash64("plan_id", "text_id", "kind", "key"))


def text_directions(texts: DataFrame, paths: DataFrame) -> DataFrame:
    """plan_id, text_id, dir, text_len: from the glyph strokes inside each text's box."""
    glyphs = strokes(paths.filter("type = 's'"))
    glyphs = R.boxed(glyphs.select("plan_id", "seg_id", "ax", "ay", "bx", "by", "len"), "g")
    words = texts.select("plan_id", "text_id", *(F.col(f"rect.{c}").alias(f"t{c}") for c in R.BOX))
    tall = 1.2 * F.least(F.expr("tx1 - tx0"), F.expr("ty1 - ty0"))
    held = J.grid_join(glyphs, words, R.prefixed("g"), R.prefixed("t"), 2.0, ["plan_id"]).filter(F.expr("gx0 >= tx0 and gy0 >= ty0 and gx1 <= tx1 and gy1 <= ty1") & (F.col("len") <= tall))
    ends = F.explode(F.array(*(F.struct(F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y")) for p in "ab")))
    points = held.select("plan_id", "text_id", ends.alias("_e")).select("plan_id", "text_id", "_e.x", "_e.y")
    return R.text_directions(points, ["plan_id", "text_id"])


def candidate_edges(l: DataFrame, f: DataFrame, t: Tolerances) -> DataFrame:
    """Labels and the objects within reach: distance, cost, slots."""
    o = f.select("plan_id", F.col("id").alias("obj_id"), F.col("kind").alias("obj_kind"), "ring", "band", "length", "width", F.col("o.angle_deg").alias("deg"), "stamp_x", "stamp_y", "x0", "y0", "x1", "y1")
    near = J.grid_join(l, o, ("x", "y", "x", "y"), ("x0", "y0", "x1", "y1"), 4.0, ["plan_id"], t.label_radius)
    d = G.label_distance(F.col("obj_kind"), F.col("x"), F.col("y"), F.col("ring"), F.lit(t.near))
    d = F.when(F.col("stamp_x").isNotNull(), F.hypot(F.col("x") - F.col("stamp_x"), F.col("y") - F.col("stamp_y"))).otherwise(d)
    slots = F.when(F.col("length") > t.long_object, 1 + F.floor(F.col("length") / t.long_object)).otherwise(1).cast("int")
    near = near.withColumn("d", d).filter(F.col("d") <= t.label_radius).withColumn("slots", slots)
    mis = rules.misalignment(F.col("dir"), F.col("text_len"), F.col("deg"), F.col("length"), F.col("width"))
    return near.withColumn("cost", F.col("d") / t.distance_unit + t.align_weight * mis).withColumn("agrees", G.sizes_agree(F.col("obj_kind"), F.col("band"), F.col("numbers"), t.size_tol))


def spoken_for(matched: DataFrame, f: DataFrame) -> DataFrame:
    """``matched`` (with x, y of the label) with a row for each object that a label names."""
    on = matched.filter("kind = 'retaining_wall+strip_footing' and obj_kind = 'band'").select("plan_id", "label_id", "obj_id", "x", "y")
    bands_ = f.join(on.select("plan_id", F.col("obj_id").alias("id")).distinct(), KEY, "left_semi").select("plan_id", "id", "ring")
    held = overlaps(bands_, f.filter("kind = 'solid'").select("plan_id", "id", "ring")).filter("common > 0.5 * area_b").select("plan_id", F.col("a").alias("obj_id"), F.col("b").alias("solid_id"))
    near = on.join(held, ["plan_id", "obj_id"]).join(f.select("plan_id", F.col("id").alias("solid_id"), "ring"), ["plan_id", "solid_id"])
    gap = F.when(G.inside(F.col("x"), F.col("y"), F.col("ring")), 0.0).otherwise(G.ring_distance(F.col("x"), F.col("y"), F.col("ring")))
    inside = J.first_by(near.withColumn("_g", gap), ["plan_id", "label_id", "obj_id"], ["_g", "solid_id"]).select("plan_id", "obj_id", "label_id", "solid_id")
    return R.compound_targets(matched, inside)


def size_meaning(config: dict) -> tuple[dict[str, bool], dict[str, bool], dict[str, bool]]:
    """(does a label kind's key fix the width only, the same by class, are a class's types per building), from the rules.
    Kinds that are not listed say nothing about the size."""
    labels_ = config["labels"]
    width = {kind: r.get("size_match") == "width" for kind, r in labels_.items()} | {kind: True for kind in config["bands"]}
    width |= {f"footing:{x}": width["footing"] for x in labels_.get("footing", {}).get("series_subclass", {})} if "footing" in width else {}
    width["retaining_wall+strip_footing"] = True
    of = {"column": "column", "shear_wall": "wall", "retaining_wall": "retaining_wall", "isolated_footing": "footing", "combined_footing": "footing"}
    by_class = {c: width[kind] for c, kind in of.items() if kind in labels_}
    return width, by_class, {c: bool(labels_[kind].get("per_building", False)) for c, kind in of.items() if kind in labels_}


def names(matched: DataFrame, f: DataFrame, cl: DataFrame, config: dict, t: Tolerances) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clusters with votes and names, label kinds with their home kinds, (cluster, kind, object) of each vote)."""
    width_only = lookup(size_meaning(config)[0], F.col("kind"))
    same = F.when(width_only, F.lit(0.0)).otherwise(F.bround(F.col("length") / t.size_tol))
    landed = matched.withColumn("_l", F.when(width_only.isNotNull(), same)).withColumn("_w", F.when(width_only.isNotNull(), F.bround(F.col("width") / t.size_tol)))
    scores = R.landing_scores(landed.select("plan_id", F.col("kind").alias("label"), F.col("obj_kind").alias("on"), "key", "_l", "_w"), ["plan_id", "label"], "on", ["key", "_l", "_w"], t.name_min_votes)
    scores = scores.filter("score > 0").select("plan_id", "label", "on", F.col("score").alias("n"))
    key = F.concat_ws("\x00", "plan_id", "label")
    home = A.affinity(scores.withColumn("_l", key), "_l", "on").filter("home").select("plan_id", F.col("label").alias("kind"), F.col("on").alias("obj_kind"))
    voting = matched.filter("agrees").join(home, ["plan_id", "kind", "obj_kind"], "left_semi")
    voters = save(spoken_for(voting, f).select("plan_id", "obj_id", "kind").join(cl.select("plan_id", F.col("id").alias("obj_id"), "cluster"), ["plan_id", "obj_id"]), "voters")
    votes = voters.groupBy("plan_id", "cluster", "kind").agg(F.count(F.lit(1)).alias("n"))
    sizes = cl.groupBy("plan_id", "cluster").agg(F.count(F.lit(1)).alias("members"))
    named = A.named_by_vote(votes, sizes, ["plan_id", "cluster"], "kind", t.name_min_votes, t.name_margin, t.name_small, t.name_min_labelled)
    most = votes.groupBy("plan_id", "cluster").agg(F.max("n").alias("_m"))
    tops = votes.join(most, ["plan_id", "cluster"]).filter("n = _m").groupBy("plan_id", "cluster").agg(F.collect_set(lookup(LABEL_CLASS, F.col("kind"))).alias("tops"))
    named = named.join(tops, ["plan_id", "cluster"], "left")
    return named.withColumn("class", lookup(LABEL_CLASS, F.col("name"))).withColumn("named_by", F.when(F.col("name").isNotNull(), "label vote").otherwise("")), home, voters


def centroids(f: DataFrame, cl: DataFrame) -> DataFrame:
    """plan_id, kind, cluster, centre: mean feature vectors of solids and outlines."""
    v = vectors(f).join(cl, KEY).select("plan_id", "kind", "cluster", F.posexplode("x").alias("i", "x"))
    mean = v.groupBy("plan_id", "kind", "cluster", "i").agg(F.avg("x").alias("x"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"])
    return mean.groupBy("plan_id", "kind", "cluster").agg(listed.alias("centre"))


def similar_names(named: DataFrame, centres: DataFrame, t: Tolerances) -> DataFrame:
    """Unnamed clusters take the class of the nearest one of their kind that labels named: if close, or if that class is
    among their own top votes."""
    voted = centres.join(named.filter("named_by = 'label vote'").select("plan_id", "cluster", F.col("class").alias("near_class")), ["plan_id", "cluster"])
    voted = voted.select("plan_id", "kind", F.col("cluster").alias("near"), "centre", "near_class")
    asked = centres.join(named.filter("class is null").select("plan_id", "cluster"), ["plan_id", "cluster"]).withColumnRenamed("centre", "x")
    best = R.nearest_centroid(asked, voted, ["plan_id", "kind"], "cluster", "x", "near", "centre").select("plan_id", "cluster", "near", "near_class", "dist")
    j = named.join(best, ["plan_id", "cluster"], "left")
    take = F.col("class").isNull() & F.col("near_class").isNotNull() & ((F.col("dist") <= t.similar_max) | F.coalesce(F.array_contains("tops", F.col("near_class")), F.lit(False)))
    said = F.concat(F.lit("similar to cluster "), "near", F.format_string(" (distance %.2f)", F.col("dist")))
    j = j.withColumn("_take", F.coalesce(take, F.lit(False)))
    return j.withColumn("named_by", F.when(F.col("_take"), said).otherwise(F.col("named_by"))).withColumn("class", F.when(F.col("_take"), F.col("near_class")).otherwise(F.col("class"))).drop("near", "near_class", "dist", "_take")


def unstretched(f: DataFrame, named: DataFrame, voters: DataFrame, t: Tolerances) -> DataFrame:
    """Members far outside the sizes that their cluster's labels cover lose its class (kept as ``cluster_class``)."""
    top = named.filter("named_by = 'label vote'").select("plan_id", "cluster", F.col("name").alias("kind"))
    v = voters.join(top, ["plan_id", "cluster", "kind"], "left_semi").join(f.select("plan_id", F.col("id").alias("obj_id"), "length", "width"), ["plan_id", "obj_id"])
    checked = A.within_envelope(f, v, ["plan_id", "cluster"], ["length", "width"], t.size_tol)
    out = (F.col("named_by") == "label vote") & F.col("kind").isin("solid", "outline") & ~F.col("inside")
    checked = checked.withColumn("_out", out).withColumn("cluster_class", F.col("class"))
    said = F.concat(F.lit("outside the sizes that the labels of cluster "), "cluster", F.lit(" cover"))
    return checked.withColumn("class", F.when(~F.col("_out"), F.col("class"))).withColumn("named_by", F.when(F.col("_out"), said).otherwise(F.col("named_by"))).drop("_out", "inside")


def wall_pieces(f: DataFrame, matched: DataFrame, t: Tolerances) -> DataFrame:
    """Column-shaped pieces drawn like walls are set aside: their outline has a pen that no labelled column has, or they
    continue a wall of the same thickness."""
    on = matched.filter("kind = 'column'").select("plan_id", F.col("obj_id").alias("id")).join(f.filter("class = 'column'").select(*KEY, "pen"), KEY)
    pens = A.usual(on, ["plan_id"], "pen", t.pen_share).select("plan_id", "pen", F.lit(True).alias("_usual"))
    any_ = pens.select("plan_id", F.lit(True).alias("_known")).distinct()
    column = F.coalesce("class", "cluster_class") == "column"
    walls = f.filter((F.col("kind") == "solid") & ~F.coalesce(F.col("class") == "column", F.lit(False)))
    on_wall = R.touching_equal(f.filter(column), walls, ["plan_id"], "id", "width", t.touch, t.width_tol).withColumn("_wall", F.lit(True))
    j = f.join(pens, ["plan_id", "pen"], "left").join(any_, "plan_id", "left").join(on_wall, KEY, "left").na.fill(False, ["_usual", "_known", "_wall"])
    piece = F.coalesce(column, F.lit(False)) & ((F.col("_known") & ~F.col("_usual")) | F.col("_wall"))
    return j.withColumn("piece", piece).withColumn("class", F.when(piece, "core_wall").otherwise(F.col("class"))).withColumn("named_by", F.when(piece, "rule: column-shaped piece drawn like a wall (outline pen or continuity)").otherwise(F.col("named_by"))).drop("_usual", "_known", "_wall")


# --- buildings -----------------------------------------------------------------------------------------------------


def joints(s: DataFrame, t: Tolerances) -> DataFrame:
    """plan_id, ax .. by: one line of each expansion joint, two long parallel lines of one pen a few centimetres apart."""
    long_ = usable(s).filter(F.col("len") >= t.joint_min_len).withColumn("a", F.pmod(F.bround(F.col("ang") / 0.005) * 0.005, F.lit(pi)))
    at = F.col("a")
    lo, hi = (g(G.along(F.col("ax"), F.col("ay"), at), G.along(F.col("bx"), F.col("by"), at)) for g in (F.least, F.greatest))
    off = (G.offset(F.col("ax"), F.col("ay"), at) + G.offset(F.col("bx"), F.col("by"), at)) / 2
    lines = long_.select("plan_id", "w", "a", F.col("seg_id").alias("id"), off.alias("off"), lo.alias("lo"), hi.alias("hi"))
    pairs = J.parallel_pairs(lines, ["plan_id", "w", "a"], *t.joint_gap, share=0.8)
    return pairs.select("plan_id", F.col("i").alias("seg_id")).distinct().join(s, ["plan_id", "seg_id"]).select("plan_id", "ax", "ay", "bx", "by")


def regions(f: DataFrame, l: DataFrame, s: DataFrame, t: Tolerances) -> DataFrame:
    """plan_id, what (o or l), id, region, depth, building: parts of the footprint between joints, with the building that
    the labels in them agree on."""
    at = f.select("plan_id", F.concat(F.lit("o"), "id").alias("point"), F.col("mx").alias("x"), F.col("my").alias("y"))
    at = at.unionByName(l.filter("building is not null").select("plan_id", F.concat(F.lit("l"), "label_id").alias("point"), "x", "y"))
    sites = save(S.footprints(f.filter("kind in ('solid', 'outline')"), at, joints(s, t), t.footprint_grow, t.footprint_close, t.joint_cut, t.region_min_area), "sites")
    sites = sites.filter("region > 0").select("plan_id", F.substring("point", 1, 1).alias("what"), F.expr("substring(point, 2)").cast("long").alias("id"), "region", "depth")
    said = sites.filter("what = 'l'").join(l.select("plan_id", F.col("label_id").alias("id"), "building"), KEY)
    vote = A.dominant(said, ["plan_id", "region"], "building", "id", t.region_dominant)
    return sites.join(vote, ["plan_id", "region"], "left")


def nearest_building(points: DataFrame, said: DataFrame, on: list[str], t: Tolerances) -> DataFrame:
    """plan_id, id, b: the majority of the nearest labels that have a building."""
    near = J.nearest_join(points, said, "id", "b_id", ("mx", "my"), ("bx", "by"), t.building_radius, t.building_k, on)
    return A.most_common(near, KEY, "b", "rank").select(*KEY, "b")


def buildings(o: DataFrame, l: DataFrame, where: DataFrame, t: Tolerances) -> DataFrame:
    """An object's building (own_building: of its own label), and region_building where it stands well inside a region."""
    here = where.filter("what = 'o'").select(*KEY, F.col("region"), "depth", F.col("building").alias("_dominant"))
    said = l.filter("building is not null").select("plan_id", F.col("label_id").alias("b_id"), F.col("building").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    said_in = said.join(where.filter("what = 'l'").select("plan_id", F.col("id").alias("b_id"), "region"), ["plan_id", "b_id"])
    points = o.select(*KEY, "mx", "my")
    anywhere = nearest_building(points, said, ["plan_id"], t).withColumnRenamed("b", "_anywhere")
    inside = nearest_building(points.join(here.select(*KEY, "region"), KEY), said_in, ["plan_id", "region"], t).withColumnRenamed("b", "_inside")
    j = o.join(here, KEY, "left").join(inside, KEY, "left").join(anywhere, KEY, "left")
    j = j.withColumn("building", rules.building_of(F.col("own_building"), F.col("_dominant"), F.col("_inside"), F.col("_anywhere")))
    return j.withColumn("region_building", F.when(F.col("depth") >= t.joint_margin, F.col("_dominant"))).drop("_dominant", "_inside", "_anywhere", "depth", "region")


def match(edges: DataFrame, t: Tolerances, penalty: Column | None = None) -> DataFrame:
    """One global assignment; ``penalty``: further cost of an edge, null where it is forbidden."""
    cost = F.col("cost") if penalty is None else F.col("cost") + penalty
    return assign(edges.select("plan_id", "label_id", "obj_id", "slots", cost.alias("cost")), t.unmatched_cost)


def second_costs(edges: DataFrame, home: DataFrame, f: DataFrame, t: Tolerances) -> DataFrame:
    """Costs of the second pass: null where class, home kind or printed size forbid; dearer for objects without a sure class.

    f: with class, named_by, near_class (of the nearest cluster that labels named).
    """
    e = edges.join(f.select("plan_id", F.col("id").alias("obj_id"), "class", "named_by", "near_class"), ["plan_id", "obj_id"])
    e = e.join(home.withColumn("_home", F.lit(True)), ["plan_id", "kind", "obj_kind"], "left").join(home.select("plan_id", "kind", F.lit(True).alias("_has")).distinct(), ["plan_id", "kind"], "left")
    parts = (F.col("kind") == "retaining_wall+strip_footing") & F.col("obj_kind").isin("band", "solid")
    at_home = F.col("_has").isNull() | F.coalesce(F.col("_home"), F.lit(False)) | parts
    wanted = rules.classes_named(F.col("kind"), LABEL_CLASS)
    families = F.transform(wanted, lambda c: lookup(FAMILY, c))
    penalty = rules.compatibility(F.col("agrees"), at_home, wanted, F.coalesce("class", F.lit("")), F.col("class").isNotNull() & (F.col("named_by") == "label vote"), lookup(FAMILY, F.col("near_class")), families, t.unnamed_penalty)
    return e.withColumn("cost", F.col("cost") + penalty).drop("_home", "_has")


def checked_costs(edges: DataFrame, close: DataFrame, placed: DataFrame, t: Tolerances) -> DataFrame:
    """Dearer edges to objects that do not have the size which the closest labels of the type agree on, or that stand in
    another building's region (placed: plan_id, id, region_building)."""
    sure = close.filter((F.col("d") <= t.sure_distance) & F.col("kind").isin("column", "wall", "footing:S", "footing:SC"))
    sizes = A.agreed_size(sure, ["plan_id", "key"], "d", ["length", "width"], t.size_tol, "label_id").select("plan_id", "key", F.col("length").alias("_l"), F.col("width").alias("_w"))
    e = edges.join(sizes, ["plan_id", "key"], "left").join(placed.select("plan_id", F.col("id").alias("obj_id"), "region_building"), ["plan_id", "obj_id"], "left")
    cost = rules.checked(F.col("cost"), F.col("length"), F.col("width"), F.col("_l"), F.col("_w"), t.size_tol, t.size_penalty, F.col("building"), F.col("region_building"), t.region_penalty)
    return e.withColumn("cost", cost).drop("_l", "_w", "region_building")


def printed_types(f: DataFrame, matched: DataFrame) -> DataFrame:
    """Objects with the cheapest label that names them: key, label, label_kind, own_building; type_source where there is one."""
    spoken = spoken_for(matched, f)
    best = J.first_by(spoken, ["plan_id", "obj_id"], ["cost", "label_id"]).select("plan_id", F.col("obj_id").alias("id"), "key", F.col("text").alias("label"), F.col("building").alias("own_building"), F.col("kind").alias("label_kind"))
    return f.join(best, KEY, "left").withColumn("type_source", F.when(F.col("key").isNotNull(), "printed label").otherwise(""))


def own_label(o: DataFrame) -> DataFrame:
    """Evidence ranks: a cluster's label vote, the element's own label, a guess by similarity."""
    own = lookup(LABEL_CLASS, F.col("label_kind"))
    takes = (F.coalesce("named_by", F.lit("")) != "label vote") & own.isNotNull() & ~own.eqNullSafe(F.col("class")) & F.col("type_source").startswith("printed")
    o = o.withColumn("_own", F.coalesce(takes, F.lit(False)))
    return o.withColumn("named_by", F.when(F.col("_own"), "its own label (the cluster's class was only a guess)").otherwise(F.col("named_by"))).withColumn("class", F.when(F.col("_own"), own).otherwise(F.col("class"))).drop("_own")


def validated(o: DataFrame, config: dict, t: Tolerances) -> DataFrame:
    """Printed types against the sizes of the other elements that carry them: an odd one out takes the type of its region's
    or label's building that has its size, keeps a question, or, where only two disagree, stays and is flagged."""
    width_only, _ = size_meaning(config)[1:]
    kinds = {"column": "column", "wall": "shear_wall", "retaining_wall": "retaining_wall"}
    p = o.withColumn("g_class", lookup(kinds, F.col("label_kind"))).filter("key is not null and g_class is not null").withColumn("width_only", F.coalesce(lookup(size_meaning(config)[1], F.col("g_class")), F.lit(False)))
    p = save(p.select(*KEY, "g_class", "key", "length", "width", "building", "region_building", "width_only"), "printed")
    verdicts = A.two_size_consistency(p, ["plan_id", "g_class", "key"], "length", "width", "id", t.size_tol, t.width_tol, "width_only").select(*KEY, "verdict")
    usual = p.groupBy("plan_id", F.col("g_class").alias("class"), "key").agg(F.min_by("building", "id").alias("building"), F.median("length").alias("length"), F.median("width").alias("width"))
    odd = p.join(verdicts.filter("verdict = 'retype'"), KEY).withColumn("class", F.col("g_class")).select(*KEY, "class", "key", "length", "width", "width_only", "region_building", "building")
    new = R.retyped(odd, usual, ["region_building", "building"], t.size_tol, t.width_tol).select(*KEY, F.col("keys").alias("_keys"))
    j = o.join(verdicts, KEY, "left").join(new, KEY, "left")
    misfit = F.concat(F.lit("printed "), "key", F.lit(" does not fit that type's size; "))
    source = (
        F.when(F.col("verdict") == "conflict", F.concat(F.lit("printed label; size differs from the other "), "key", F.lit(" (conflict, check)")))
        .when(F.col("verdict") == "retype", F.when(F.col("_keys").isNull(), F.concat(misfit, F.lit("no type of its building fits"))).when(F.col("_keys").contains("|"), F.concat(misfit, F.lit("several types of its building fit"))).otherwise(F.concat(misfit, F.lit("the size fits "), "_keys")))
        .otherwise(F.col("type_source"))
    )
    key = F.when(F.col("verdict") == "retype", F.col("_keys")).otherwise(F.col("key"))
    return j.withColumn("type_source", source).withColumn("key", key).drop("verdict", "_keys")


def inferred(o: DataFrame, config: dict, t: Tolerances) -> DataFrame:
    """Unlabelled members of a class that has types take the types of their size (in their building, where types are per
    building), that of the nearest element first."""
    _, width_only, per_building = size_meaning(config)
    o = save(o, "typed")
    told = F.col("type_source").startswith("printed")
    has = lookup({c: True for c in width_only}, F.col("class"))
    scope = F.when(lookup(per_building, F.col("class")), F.coalesce("building", F.lit(""))).otherwise(F.lit(""))
    members = o.filter(told & has & F.col("key").isNotNull()).select("plan_id", F.col("class").alias("g_class"), F.col("key").alias("g_key"), scope.alias("g_scope"), "length", "width", F.col("x0").alias("p0"), F.col("y0").alias("q0"), F.col("x1").alias("p1"), F.col("y1").alias("q1"))
    groups = members.groupBy("plan_id", "g_class", "g_key", "g_scope").agg(F.median("length").alias("gl"), F.median("width").alias("gw"))
    lone = o.filter(~told & has & F.col("key").isNull()).select(*KEY, F.col("class").alias("g_class"), scope.alias("g_scope"), "length", "width", "x0", "y0", "x1", "y1")
    fits = J.band_join(lone, groups, "width", "gw", t.width_tol, ["plan_id", "g_class", "g_scope"])
    fits = fits.filter(rules.fits_size(F.col("length"), F.col("width"), F.col("gl"), F.col("gw"), F.coalesce(lookup(width_only, F.col("g_class")), F.lit(False)), t.size_tol, t.width_tol))
    near = fits.drop("gl", "gw").join(members.drop("length", "width"), ["plan_id", "g_class", "g_key", "g_scope"])
    gap = F.hypot(F.greatest(F.expr("p0 - x1"), F.expr("x0 - p1"), F.lit(0.0)), F.greatest(F.expr("q0 - y1"), F.expr("y0 - q1"), F.lit(0.0)))
    listed = A.candidate_list(near, KEY, gap, "g_key")
    o = o.join(listed, KEY, "left")
    lone_ = ~told & F.coalesce(has, F.lit(False)) & F.col("key").isNull()
    source = F.when(lone_ & F.col("candidates").contains("|"), "inferred, ambiguous: several types have this size (nearest first)").when(lone_ & F.col("candidates").isNotNull(), "inferred: the only type with this size").when(lone_, "no type has this size").otherwise(F.col("type_source"))
    return o.withColumn("type_source", source).withColumn("key", F.coalesce("key", F.when(lone_, F.col("candidates")))).drop("candidates")


def columns_by_shape(o: DataFrame, named: DataFrame, t: Tolerances) -> DataFrame:
    """On plans whose labels name no columns, an unlabelled solid of column section is one, unless it continues a wall."""
    has = named.filter("class = 'column' and named_by = 'label vote'").select("plan_id", F.lit(True).alias("_has")).distinct()
    solids_ = o.filter("kind = 'solid'")
    long_ = solids_.filter(~rules.is_column_section(F.col("length"), F.col("width")))
    on_wall = R.touching_equal(solids_, long_, ["plan_id"], "id", "width", t.touch, t.width_tol).withColumn("_wall", F.lit(True))
    j = o.join(has, "plan_id", "left").join(on_wall, KEY, "left").na.fill(False, ["_has", "_wall"])
    free = ~F.col("_has") & (F.col("kind") == "solid") & (F.col("width") > 0) & rules.is_column_section(F.col("length"), F.col("width")) & ~F.col("type_source").startswith("printed") & (F.col("named_by") != "label vote")
    column = free & ~F.col("_wall")
    said = "rule: column by shape (L <= 4 W); the plan has no labels that name columns"
    return j.withColumn("piece", F.col("piece") | (free & F.col("_wall"))).withColumn("wall_rule", F.when(column, said)).withColumn("class", F.when(column, "column").otherwise(F.col("class"))).drop("_has", "_wall")


def unlabelled_walls(o: DataFrame, t: Tolerances) -> DataFrame:
    """Wall-like objects without a printed type and without a sure class: retaining on the edge or on a strip, else core."""
    usual = o.groupBy("plan_id").agg(A.median_or(F.col("width"), F.col("class").isin("shear_wall", "retaining_wall"), t.wall_default).alias("_wall"))
    o = o.join(usual, "plan_id")
    like = rules.wall_like(F.col("kind"), F.col("length"), F.col("width"), F.col("_wall"), F.col("dots_inside"), F.col("piece"))
    free = like & rules.open_to_wall_rule(F.col("class"), F.col("key"), F.col("type_source").startswith("printed"), F.col("piece")) & ~(F.coalesce(F.col("class") == "column", F.lit(False)) & ~F.col("piece"))
    new = rules.wall_class(F.col("on_perimeter") == 1, F.col("in_band_holding_solid") == 1)
    said = F.when(new == "retaining_wall", "rule: unlabelled wall along the building edge or on a strip footing").when(F.col("piece"), F.col("named_by")).otherwise("rule: unlabelled interior wall, no type of its size")
    o = o.withColumn("_free", F.coalesce(free, F.lit(False)))
    return o.withColumn("wall_rule", F.when(F.col("_free"), F.concat(said, F.when(F.col("kind") == "outline", " (drawn as an outline with a pattern inside)").otherwise(""))).otherwise(F.col("wall_rule"))).withColumn("class", F.when(F.col("_free"), new).otherwise(F.col("class"))).drop("_wall", "_free")


def wall_thickness_types(o: DataFrame, t: Tolerances) -> DataFrame:
    """Retaining walls found by the edge rule take the type of their thickness, learned from labelled ones."""
    o = save(o, "walls")
    told = F.col("type_source").startswith("printed")
    walls = o.filter("class = 'retaining_wall'")
    listed = R.thickness_types(walls.filter("key is null and wall_rule is not null"), walls.filter(told & F.col("key").isNotNull()), t.width_tol)
    o = o.join(listed, KEY, "left")
    source = F.when(F.col("candidates").isNull(), F.col("type_source")).otherwise(F.concat(F.lit("inferred: the thickness of this retaining-wall type"), F.when(F.col("candidates").contains("|"), " (several fit, nearest first)").otherwise("")))
    return o.withColumn("type_source", source).withColumn("key", F.coalesce("key", "candidates")).drop("candidates")


def type_keys(o: DataFrame) -> DataFrame:
    """The printed form of a type: ~ before inferred ones, ? for none."""
    shown = F.when(F.col("type_source").startswith("inferred"), grammar.inferred_type("key")).otherwise(F.coalesce("key", F.lit("?")))
    return o.withColumn("type_key", shown).withColumn("named_by", F.coalesce("wall_rule", "named_by"))


def numbered(o: DataFrame) -> DataFrame:
    order = lookup({c: i for i, c in enumerate(CLASS_ORDER)}, F.col("class"))
    text = lambda c: F.coalesce(F.col(c), F.lit("None"))
    return W.numbered_by(o, ["plan_id"], [text("building"), F.coalesce(order, F.lit(99)), text("class"), text("type_key"), "id"], "number")


def diagnostics(objs: DataFrame, paths: DataFrame, where: DataFrame, cuts: DataFrame) -> DataFrame:
    """plan_id, what, n: how many objects of each kind there are, hatched legs, nested boxes, traced regions, joints, regions."""
    count = F.count(F.lit(1)).alias("n")
    out = objs.groupBy("plan_id", F.concat(F.lit("objects: "), "kind").alias("what")).agg(count)
    for what, rows in (
        ("hatched legs", objs.filter("leg_of_region")), ("nested boxes merged", objs.withColumn("_n", F.explode("nested"))), ("traced regions", objs.filter("traced")),
        ("joints", cuts), ("regions", where.select("plan_id", "region").distinct()), ("paths", paths),
    ):
        out = out.unionByName(rows.groupBy("plan_id").agg(count).select("plan_id", F.lit(what).alias("what"), "n"))
    return out


def detect(paths: DataFrame, texts: DataFrame, config: dict, t: Tolerances = Tolerances()) -> Result:
    calibration = save(calibrate(paths, texts, config), "calibration")
    paths, texts = scaled(paths, texts, calibration)
    paths, texts = save(paths, "paths"), save(texts, "texts")
    objs, segs = objects(paths, texts, t)
    f = save(features(objs, paths, t), "features")
    cl = save(clusters(f, t), "clusters")
    l = save(labels(texts, paths, config, t), "labels")
    where = save(regions(f, l, segs, t), "regions")
    edges = save(candidate_edges(l, f, t), "edges")
    pick = ["plan_id", "label_id", "obj_id"]
    first = save(edges.drop("cost").join(match(edges, t), pick), "first")
    named, home, voters = names(first, f, cl, config, t)
    home, centres = save(home, "home"), save(centroids(f, cl), "centroids")
    named = save(similar_names(named, centres, t), "named")
    f = f.join(cl, KEY, "left").join(named.select("plan_id", "cluster", "class", "named_by"), ["plan_id", "cluster"], "left").withColumn("named_by", F.coalesce("named_by", F.lit("")))
    f = save(unstretched(save(f, "named-objects"), named, voters, t), "enveloped")
    f = save(wall_pieces(f, first, t), "pieces")
    voted = centres.join(named.filter("named_by = 'label vote'").select("plan_id", "cluster", "class"), ["plan_id", "cluster"]).select("plan_id", "kind", F.col("cluster").alias("near"), "centre", F.col("class").alias("near_class"))
    own = vectors(f).withColumn("_me", F.col("id").cast("string"))
    near = R.nearest_centroid(own, voted, ["plan_id", "kind"], "_me", "x", "near", "centre").select(*KEY, "near_class")
    second = save(second_costs(edges, home, f.join(near, KEY, "left"), t), "second")
    close = edges.drop("cost").join(match(second, t), pick)
    placed = where.filter(F.col("depth") >= t.joint_margin).filter("what = 'o'").select("plan_id", "id", F.col("building").alias("region_building"))
    m2 = save(edges.drop("cost").join(match(checked_costs(second, close, placed, t), t), pick), "matches")
    o = save(buildings(printed_types(f, m2), l, where, t), "placed")
    o = inferred(own_label(validated(o, config, t)), config, t)
    o = wall_thickness_types(unlabelled_walls(columns_by_shape(o, named, t), t), t)
    found = save(numbered(type_keys(o)), "detected")
    return Result(found, l, named, m2, calibration, diagnostics(objs, paths, where, joints(segs, t)))
