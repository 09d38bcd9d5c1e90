"""Scalar geometry as Column expressions. Points are struct<x, y>, rings arrays of points, angles radians."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"


def point(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def centre(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return point((x0 + x1) / 2, (y0 + y1) / 2)


def offset(x: Column, y: Column, angle: Column) -> Column:
    """Signed distance across a direction."""
    return -x * F.sin(angle) + y * F.cos(angle)


def along(x: Column, y: Column, angle: Column) -> Column:
    """Coordinate along a direction."""
    return x * F.cos(angle) + y * F.sin(angle)


def parallel(a: Column, b: Column, sine: float) -> Column:
    return F.abs(F.sin(a - b)) < sine


def folded_degrees(a: Column, b: Column) -> Column:
    """Difference of two undirected angles in degrees, 0 to 90."""
    return F.abs(F.pmod(a - b + 90, F.lit(180)) - 90)


def sides(ring: Column) -> Column:
    """Closed ring to array of struct<a, b>: each corner with the next, the last with the first."""
    return F.transform(F.sequence(F.lit(0), F.size(ring) - 1), lambda i: F.struct(ring[i].alias("a"), ring[F.pmod(i + 1, F.size(ring))].alias("b")))


def item_lines(items: Column) -> Column:
    """Straight lines of a path's items: ``l`` one, ``re`` and ``qu`` four, curves none; struct<a, b>."""
    return F.flatten(F.transform(items, lambda i: F.when(i["kind"] == "l", F.array(F.struct(i["pts"][0].alias("a"), i["pts"][1].alias("b")))).when(i["kind"].isin("re", "qu"), sides(i["pts"])).otherwise(F.array().cast(f"array<struct<a:{POINT},b:{POINT}>>"))))


def signed_area(ring: Column) -> Column:
    return F.aggregate(sides(ring), F.lit(0.0), lambda acc, s: acc + (s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return F.aggregate(sides(ring), F.lit(0.0), lambda acc, s: acc + F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]))


def chains(items: Column, near: float = 1e-3) -> Column:
    """Sub-polygons of a path: closed items by themselves, others chained while the next starts where the last ended;
    three points or more. array<array<point>>."""
    none = F.array().cast(f"array<{POINT}>")
    zero = F.struct(none.alias("chain"), F.array().cast(f"array<array<{POINT}>>").alias("out"))

    def flushed(acc):
        return F.when(F.size(acc["chain"]) >= 3, F.concat(acc["out"], F.array(acc["chain"]))).otherwise(acc["out"])

    def step(acc, i):
        last = F.element_at(acc["chain"], -1)
        goes_on = (F.size(acc["chain"]) > 0) & (F.hypot(last["x"] - i["pts"][0]["x"], last["y"] - i["pts"][0]["y"]) < near)
        closed = i["kind"].isin("re", "qu")
        return F.struct(
            F.when(closed, none).when(goes_on, F.concat(acc["chain"], F.slice(i["pts"], 2, F.size(i["pts"])))).otherwise(i["pts"]).alias("chain"),
            F.when(closed, F.concat(flushed(acc), F.array(i["pts"]))).when(goes_on, acc["out"]).otherwise(flushed(acc)).alias("out"),
        )

    return F.aggregate(items, zero, step, flushed)


def is_closed(items: Column, near: float = 1e-3) -> Column:
    """Does the path hold a closed item, or one chain of four points or more that returns to its start?"""
    ends = chains(items, near)
    back = F.exists(ends, lambda c: (F.size(c) >= 4) & (F.hypot(c[0]["x"] - F.element_at(c, -1)["x"], c[0]["y"] - F.element_at(c, -1)["y"]) < near))
    return F.exists(items, lambda i: i["kind"].isin("re", "qu")) | back


def oriented_rectangle(ring: Column) -> Column:
    """Of a four-cornered rectangle: length, width, angle in degrees in [0, 180), rectness."""
    a = F.hypot(ring[1]["x"] - ring[0]["x"], ring[1]["y"] - ring[0]["y"])
    b = F.hypot(ring[2]["x"] - ring[1]["x"], ring[2]["y"] - ring[1]["y"])
    p, q = F.when(a >= b, ring[0]).otherwise(ring[1]), F.when(a >= b, ring[1]).otherwise(ring[2])
    return F.struct(
        F.greatest(a, b).alias("length"), F.least(a, b).alias("width"),
        F.pmod(F.degrees(F.atan2(q["y"] - p["y"], q["x"] - p["x"])), F.lit(180.0)).alias("angle_deg"),
        F.coalesce(area(ring) / F.nullif(a * b, F.lit(0.0)), F.lit(0.0)).alias("rectness"),
    )


def run_polygon(angle: Column, off: Column, lo: Column, hi: Column, width: Column) -> Column:
    """Corners of a straight run given in its own direction."""
    def at(u, v):
        return point(u * F.cos(angle) - v * F.sin(angle), u * F.sin(angle) + v * F.cos(angle))

    half = width / 2
    return F.array(at(lo, off - half), at(hi, off - half), at(hi, off + half), at(lo, off + half))


def segment_distance(x: Column, y: Column, s: Column) -> Column:
    """From a point to struct<a, b>."""
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - s["a"]["x"]) * dx + (y - s["a"]["y"]) * dy) / square)))
    return F.hypot(x - (s["a"]["x"] + t * dx), y - (s["a"]["y"] + t * dy))


def ring_distance(x: Column, y: Column, ring: Column) -> Column:
    """From a point to a ring's nearest side."""
    return F.array_min(F.transform(sides(ring), lambda s: segment_distance(x, y, s)))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting: an odd number of sides to the right."""
    crossing = F.filter(
        sides(ring),
        lambda s: ((s["a"]["y"] > y) != (s["b"]["y"] > y)) & (x < (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / F.nullif(s["b"]["y"] - s["a"]["y"], F.lit(0.0)) + s["a"]["x"]),
    )
    return F.pmod(F.size(crossing), F.lit(2)) == 1


def label_distance(kind: Column, x: Column, y: Column, ring: Column, near: Column) -> Column:
    """To an outline: its edge, 0 when closer than ``near``; to other shapes: 0 inside, else the edge."""
    edge = ring_distance(x, y, ring)
    return F.when(kind == "outline", F.when(edge < near, 0.0).otherwise(edge)).otherwise(F.when(inside(x, y, ring), 0.0).otherwise(edge))


def sizes_agree(kind: Column, band: Column, numbers: Column, tolerance: float) -> Column:
    """Does one of the printed numbers equal a band's width? Other kinds agree with anything."""
    return (kind != "band") | numbers.isNull() | F.exists(numbers, lambda n: F.abs(band - n) <= tolerance)


def circle_of(items: Column, x0: Column, y0: Column, x1: Column, y1: Column, low: float = 0.85, high: float = 1.15) -> Column:
    """struct<cx, cy, r> of a path that is all curves in a nearly square box, else null."""
    w, h = x1 - x0, y1 - y0
    shape = h / F.nullif(w, F.lit(0.0))
    round_ = (F.size(items) > 0) & F.forall(items, lambda i: i["kind"] == "c") & (w > 0) & (shape > low) & (shape < high)
    return F.when(round_, F.struct(((x0 + x1) / 2).alias("cx"), ((y0 + y1) / 2).alias("cy"), (F.greatest(w, h) / 2).alias("r")))


def anchor(ring: Column, gap: float, along: Column, x0: Column, y0: Column) -> Column:
    """struct<x, y, angle>: where a label is written. ``along`` a long box: from the left end of its upper long side, moved
    out along the side's normal (y points down), read left to right; else above the corner (x0, y0)."""
    by_length = F.array_sort(F.transform(sides(ring), lambda s: F.struct((-F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])).alias("n"), (s["a"]["y"] + s["b"]["y"]).alias("h"), s["a"].alias("a"), s["b"].alias("b"))))
    top = F.array_min(F.transform(F.slice(by_length, 1, 2), lambda s: F.struct(s["h"].alias("h"), s["a"].alias("a"), s["b"].alias("b"))))
    turned = (top["b"]["x"] < top["a"]["x"]) | ((top["b"]["x"] == top["a"]["x"]) & (top["b"]["y"] > top["a"]["y"]))
    p, q = F.when(turned, top["b"]).otherwise(top["a"]), F.when(turned, top["a"]).otherwise(top["b"])
    angle = F.atan2(q["y"] - p["y"], q["x"] - p["x"])
    beside = F.struct((p["x"] + gap * F.sin(angle)).alias("x"), (p["y"] - gap * F.cos(angle)).alias("y"), F.degrees(angle).alias("angle"))
    return F.when(along, beside).otherwise(F.struct(x0.cast("double").alias("x"), (y0 - gap).cast("double").alias("y"), F.lit(0.0).alias("angle")))


def pixels(ring: Column, dpi: float) -> Column:
    """Points to rounded pixels, [x, y] each."""
    return F.transform(ring, lambda p: F.array(F.bround(p["x"] * dpi / 72, 1), F.bround(p["y"] * dpi / 72, 1)))


def box_fits(ring: Column, box: Column) -> Column:
    """Is every corner of the shape within the box's thickness of the box's sides?"""
    far = F.array_max(F.transform(ring, lambda p: ring_distance(p["x"], p["y"], box)))
    return far <= F.least(F.hypot(box[1]["x"] - box[0]["x"], box[1]["y"] - box[0]["y"]), F.hypot(box[2]["x"] - box[1]["x"], box[2]["y"] - box[1]["y"]))
