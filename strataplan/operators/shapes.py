"""Relations of convex shapes: smallest boxes, overlaps, duplicates. Arrow batches through NumPy kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataplan.operators.joins import grid_join, renamed
from strataplan.operators.suppress import suppress
from strataplan.runtime import ship

RING = "array<struct<x:double,y:double>>"
BOX = f"struct<length:double,width:double,angle_deg:double,rectness:double,obb:{RING}>"
_EDGES = {"x0": F.array_min, "y0": F.array_min, "x1": F.array_max, "y1": F.array_max}


def bounds(df: DataFrame, ring: str = "ring") -> DataFrame:
    """Add the ring's upright box as x0, y0, x1, y1."""

    def edge(pick, axis):
        return pick(F.transform(ring, lambda p: p[axis]))

    return df.select("*", *(edge(f, c[0]).alias(c) for c, f in _EDGES.items()))


def with_box(df: DataFrame, ring: str = "ring", out: str = "o") -> DataFrame:
    """Add the smallest rectangle around the ring's points: BOX."""
    ship(df.sparkSession)

    @F.pandas_udf(BOX)
    def box(rings):
        import numpy as np
        import pandas as pd

        from strataplan.functions.kernels import area, smallest_box

        rows = []
        for r in rings:
            pts = np.array([[p["x"], p["y"]] for p in r], float)
            b = smallest_box(pts)
            size = b["length"] * b["width"]
            rows.append((b["length"], b["width"], b["angle_deg"], area(pts) / size if size else 0.0, [{"x": float(x), "y": float(y)} for x, y in b["corners"]]))
        return pd.DataFrame(rows, columns=["length", "width", "angle_deg", "rectness", "obb"])

    return df.withColumn(out, box(F.col(ring)))


def repaired(df: DataFrame, ring: str = "ring") -> DataFrame:
    """Rings that cross themselves give way to their largest part."""
    ship(df.sparkSession)

    @F.pandas_udf(RING)
    def valid(rings):
        import pandas as pd

        from strataplan.functions.polygons import largest_valid

        return pd.Series([_ring(largest_valid(_points(r))) for r in rings])

    return df.withColumn(ring, valid(F.col(ring)))


def overlaps(left: DataFrame, right: DataFrame, cell: float = 4.0, grow: float = 0.0) -> DataFrame:
    """Pairs (a, b) of shapes (plan_id, id, ring; convex on the right) whose boxes touch, with areas and common area."""
    ship(left.sparkSession)
    a = bounds(left.select("plan_id", F.col("id").alias("a"), F.col("ring").alias("ra")), "ra")
    b = renamed(bounds(right.select("plan_id", F.col("id").alias("b"), F.col("ring").alias("rb")), "rb"), "b_", ["plan_id", "b", "rb"])

    def common(batches):
        import pyarrow as pa

        from strataplan.functions.kernels import areas, overlap_areas, ring_array

        for t in batches:
            x, y = ring_array(t.column(3)), ring_array(t.column(4))
            yield pa.RecordBatch.from_arrays([*t.columns[:3], *(pa.array(v, pa.float64()) for v in (areas(x), areas(y), overlap_areas(x, y)))], ["plan_id", "a", "b", "area_a", "area_b", "common"])

    near = grid_join(a, b, ("x0", "y0", "x1", "y1"), ("b_x0", "b_y0", "b_x1", "b_y1"), cell, ["plan_id"], grow).select("plan_id", "a", "b", "ra", "rb")
    kinds = dict(near.dtypes)
    return near.mapInArrow(common, f"plan_id {kinds['plan_id']}, a {kinds['a']}, b {kinds['b']}, area_a double, area_b double, common double")


def distinct_shapes(shapes: DataFrame, iou: float) -> DataFrame:
    """Larger first, shapes that overlap a kept one by more than ``iou`` leave. Ids must be unique over all plans."""
    pairs = overlaps(shapes, shapes).filter((F.col("a") < F.col("b")) & (F.col("common") > iou * (F.col("area_a") + F.col("area_b") - F.col("common"))))
    ranked = shapes.select("id", F.struct((-F.col("area")).alias("s"), "id").alias("rank"))
    return shapes.join(suppress(ranked, pairs.select("a", "b")), "id", "left_semi")


def _points(r):
    import numpy as np

    return np.array([[p["x"], p["y"]] for p in r], float)


def _ring(points) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in points]


def paint_groups(fills: DataFrame, gap: int, touch: float) -> DataFrame:
    """Fills drawn one after another that touch are one shape: plan_id, idx (the first), ring, one row per part.

    fills: plan_id, idx, ring, a row per sub-polygon. A path joins the group before it if it comes at most ``gap`` paths
    later and within ``touch`` of what the group covers so far. The state is one ordered pass per island of near indices;
    a task holds one island of one drawing.
    """
    ship(fills.sparkSession)
    order = Window.partitionBy("plan_id").orderBy("idx").rangeBetween(Window.unboundedPreceding, -1)
    before = F.max("idx").over(order)
    new = F.when(before.isNull() | (F.col("idx") - before > gap), F.col("idx"))
    cut = fills.withColumn("_island", F.max(new).over(Window.partitionBy("plan_id").orderBy("idx")))

    def fold(table):
        import numpy as np
        import pyarrow as pa

        from strataplan.functions.polygons import fused, ring_gap

        plan, paths = table["plan_id"][0].as_py(), {}
        for i, r in sorted(zip(table["idx"].to_pylist(), map(_points, table["ring"].to_pylist())), key=lambda x: x[0]):
            paths.setdefault(i, []).append(r)
        groups: list = []
        for i, rings in paths.items():
            low, high = np.vstack(rings).min(0) - touch, np.vstack(rings).max(0) + touch
            last = groups[-1][1] if groups else []
            if any((q.min(0) <= high).all() and (q.max(0) >= low).all() and ring_gap(q, r) < touch for q in last for r in rings):
                last += rings
            else:
                groups.append((i, list(rings)))
        rows = [(plan, i, _ring(r)) for i, rings in groups for r in (rings if len(rings) == 1 else fused(rings, touch / 2) or rings)]
        return pa.Table.from_pylist([{"plan_id": a, "idx": b, "ring": c} for a, b, c in rows], table.select(["plan_id", "idx", "ring"]).schema)

    return cut.select("plan_id", F.col("idx").cast("int").alias("idx"), "ring", "_island").groupBy("plan_id", "_island").applyInArrow(fold, f"plan_id string, idx int, ring {RING}")


def stretches(bent: DataFrame, solids: DataFrame, thickness: tuple[float, float], least: float) -> DataFrame:
    """plan_id, part, ring: straight stretches of bent fills (plan_id, id, ring). Where a solid already covers over half of
    one, what sticks out of the solids is kept if it is as long as it is thick."""
    ship(bent.sparkSession)
    s = renamed(bounds(solids.select("plan_id", F.col("ring").alias("r")), "r"), "s_", ["plan_id", "r"])
    near = grid_join(bounds(bent.select("plan_id", "id", "ring")), s, ("x0", "y0", "x1", "y1"), ("s_x0", "s_y0", "s_x1", "s_y1"), 4.0, ["plan_id"])
    held = near.groupBy("plan_id", "id").agg(F.collect_list("r").alias("rings"))

    @F.pandas_udf(f"array<{RING}>")
    def pieces(rings, others):
        import pandas as pd

        from strataplan.functions.polygons import rest_of, straight_stretches

        out = []
        for ring, around in zip(rings, others):
            around = [_points(x) for x in (around if around is not None else [])]
            out.append([_ring(p) for q in straight_stretches(_points(ring), thickness, least) for p in rest_of(q, around)])
        return pd.Series(out)

    found = bent.join(held, ["plan_id", "id"], "left").withColumn("_p", pieces("ring", "rings"))
    return found.select("plan_id", F.posexplode("_p").alias("part", "ring"), F.col("id").alias("of"))


def traced_outlines(stamps: DataFrame, lines: DataFrame, walls: DataFrame, zone: float, snap: float, wall_reach: float) -> DataFrame:
    """Stamps (plan_id, idx, cx, cy, rays, corners) with the ring of their region and whether it was traced.

    lines: plan_id, seg_id, ax .. by; walls: plan_id, ring. A task holds one stamp with the lines around its corners.
    """
    ship(stamps.sparkSession)
    key = ["plan_id", "idx"]
    c = bounds(stamps.select(*key, "corners"), "corners")
    l = lines.select("plan_id", "seg_id", "ax", "ay", "bx", "by", *((f(f"a{x}", f"b{x}")).alias(f"l_{x}{n}") for x in "xy" for n, f in (("0", F.least), ("1", F.greatest))))
    box = ("x0", "y0", "x1", "y1")
    near = grid_join(c, l, box, ("l_x0", "l_y0", "l_x1", "l_y1"), 8.0, ["plan_id"], zone)
    segs = near.groupBy(*key).agg(F.collect_list(F.struct("seg_id", "ax", "ay", "bx", "by")).alias("lines"))
    w = renamed(bounds(walls.select("plan_id", F.col("ring").alias("r")), "r"), "w_", ["plan_id", "r"])
    shut = grid_join(c, w, box, ("w_x0", "w_y0", "w_x1", "w_y1"), 8.0, ["plan_id"], zone).groupBy(*key).agg(F.collect_list("r").alias("walls"))

    @F.pandas_udf(f"struct<ring:{RING},traced:boolean>")
    def trace(cx, cy, rays, corners, lines, walls):
        import numpy as np
        import pandas as pd

        from strataplan.functions.kernels import hull
        from strataplan.functions.polygons import traced

        out = []
        for x, y, own, far, some, shut in zip(cx, cy, rays, corners, lines, walls):
            far, own = _points(far), set(own)
            s = np.array([[r["ax"], r["ay"], r["bx"], r["by"]] for r in (some if some is not None else []) if r["seg_id"] not in own], float).reshape(-1, 4)
            ring = traced(s, far, np.array([x, y]), [_points(q) for q in (shut if shut is not None else [])], snap, wall_reach)
            out.append((_ring(hull(far) if ring is None else ring), ring is not None))
        return pd.DataFrame(out, columns=["ring", "traced"])

    return stamps.join(segs, key, "left").join(shut, key, "left").withColumn("_t", trace("cx", "cy", "rays", "corners", "lines", "walls")).select(*stamps.columns, "_t.ring", "_t.traced").filter(F.size("ring") >= 3)


def footprints(shapes: DataFrame, points: DataFrame, cuts: DataFrame, grow: float, close: float, cut_width: float, least: float) -> DataFrame:
    """plan_id, point, edge (distance to the building's edge), edge_dir (its direction there), region (0: none), depth.

    What the shapes (plan_id, ring) cover, grown and with gaps closed, cut along joints (plan_id, ax .. by). points: plan_id,
    point (text), x, y. A task holds one drawing's shapes on a grid of a quarter of a metre.
    """
    ship(shapes.sparkSession)
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    numbers = ("x", "y", "bx", "by")
    every = (
        shapes.select("plan_id", F.lit(0).alias("what"), "ring", none("point", "string"), *(none(c, "double") for c in numbers))
        .unionByName(points.select("plan_id", F.lit(1).alias("what"), none("ring", RING), "point", "x", "y", none("bx", "double"), none("by", "double")))
        .unionByName(cuts.select("plan_id", F.lit(2).alias("what"), none("ring", RING), none("point", "string"), F.col("ax").alias("x"), F.col("ay").alias("y"), "bx", "by"))
    )

    def solve(table):
        import numpy as np
        import pyarrow as pa

        from strataplan.functions.polygons import Footprint

        what = table["what"].to_numpy()
        rings = [_points(r) for r, k in zip(table["ring"].to_pylist(), what) if k == 0]
        at = np.stack([table["x"].to_numpy(zero_copy_only=False), table["y"].to_numpy(zero_copy_only=False)], 1)
        ends = np.stack([table["bx"].to_numpy(zero_copy_only=False), table["by"].to_numpy(zero_copy_only=False)], 1)
        names = [n for n, k in zip(table["point"].to_pylist(), what) if k == 1]
        if not rings or not names:
            rows = []
        else:
            f = Footprint(rings, grow, close, np.hstack([at, ends])[what == 2], cut_width=cut_width, least=least)
            rows = [(table["plan_id"][0].as_py(), n, *e, *r) for n, e, r in zip(names, f.edge_of(at[what == 1]), f.region_of(at[what == 1]))]
        cols = list(zip(*rows)) or [()] * 6
        kinds = (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.float64())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], ["plan_id", "point", "edge", "edge_dir", "region", "depth"])

    return every.groupBy("plan_id").applyInArrow(solve, "plan_id string, point string, edge double, edge_dir double, region int, depth double")


def hatch_blobs(strokes: DataFrame, keys: list[str], least: int, gap: float, local: float, samples: int = 60) -> DataFrame:
    """Of hatch strokes by blob (keys, seg_id, len, ang, ax .. by): strokes, stroke_len, crossed, thickness, area, ring.

    Thickness is the median short side of the boxes around stroke ends within ``local`` of a systematic sample of strokes;
    the area is counted on a grid after closing ``gap``. A task holds one blob.
    """
    ship(strokes.sparkSession)
    kinds = dict(strokes.dtypes)

    def solve(table):
        import numpy as np
        import pyarrow as pa

        from strataplan.functions.polygons import grid_area, hatch_families, local_thickness

        out = []
        if table.num_rows >= least:
            order = np.argsort(table["seg_id"].to_numpy(), kind="stable")
            a, b = (np.stack([table[f"{p}{c}"].to_numpy()[order] for c in "xy"], 1) for p in "ab")
            middles = (a + b)[:: max(1, len(a) // samples)] / 2
            out.append({
                **{k: table[k][0].as_py() for k in keys}, "strokes": len(a), "stroke_len": float(np.median(table["len"].to_numpy())),
                "crossed": hatch_families(table["ang"].to_numpy()[order]), "thickness": local_thickness(np.vstack([a, b]), middles, local),
                "area": grid_area(a, b, gap), "ring": _ring(np.vstack([a, b])),
            })
        names = [(k, table.schema.field(k).type) for k in keys] + [("strokes", pa.int64()), ("stroke_len", pa.float64()), ("crossed", pa.bool_()), ("thickness", pa.float64()), ("area", pa.float64()), ("ring", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))]
        return pa.Table.from_pylist(out, pa.schema(names))

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"strokes long, stroke_len double, crossed boolean, thickness double, area double, ring {RING}"])
    return strokes.select(*keys, "seg_id", "len", "ang", "ax", "ay", "bx", "by").groupBy(*keys).applyInArrow(solve, schema)
