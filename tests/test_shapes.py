"""Kernels on polygons and the relations built on them, against grids, closed forms and plain passes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataplan.functions import geometry as G
from strataplan.functions import kernels, polygons
from strataplan.operators import shapes
from strataplan.operators.joins import between
from strataplan.operators.suppress import suppress
from strataplan.sources import dumps
from tests.synthetic import plan


def box(x0, y0, x1, y1):
    return np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], float)


def turned(ring, degrees):
    a = np.radians(degrees)
    return ring @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])


def lines(ring):
    return np.hstack([ring, np.roll(ring, -1, 0)])


def test_union_area_equals_cells():
    rng = random.Random(1)
    for _ in range(20):
        boxes = [(x, y, x + rng.randint(1, 6), y + rng.randint(1, 6)) for x, y in ((rng.randint(0, 9), rng.randint(0, 9)) for _ in range(6))]
        cells = {(i, j) for x0, y0, x1, y1 in boxes for i in range(x0, x1) for j in range(y0, y1)}
        assert abs(polygons.union_area([turned(box(*b), 31) for b in boxes]) - len(cells)) < 1e-6
    assert polygons.union_area([]) == 0 and polygons.covered_share(box(0, 0, 2, 2), [box(1, 0, 9, 9), box(1, 1, 9, 9)]) == 0.5


def test_overlap_areas_equal_one_by_one():
    rng = np.random.default_rng(4)
    a = np.array([turned(box(0, 0, *rng.uniform(0.5, 4, 2)), rng.uniform(0, 90)) + rng.uniform(0, 3, 2) for _ in range(200)])
    b = np.array([turned(box(0, 0, *rng.uniform(0.5, 4, 2)), rng.uniform(0, 90))[:: rng.choice([1, -1])] + rng.uniform(0, 3, 2) for _ in range(200)])
    want = [kernels.overlap_area(x, y) for x, y in zip(a, b)]
    assert np.allclose(kernels.overlap_areas(a, b), want) and min(want) == 0 < max(want)


def test_a_bow_tie_keeps_its_larger_half():
    tie = np.array([[0, 0], [4, 0], [0, 2], [2, 2]], float)
    assert abs(kernels.area(polygons.largest_valid(tie)) - 8 / 3) < 1e-6
    assert polygons.largest_valid(box(0, 0, 1, 1)).tolist() == box(0, 0, 1, 1).tolist()


def test_fused_rings_are_one():
    one = polygons.fused([box(0, 0, 2, 1), box(2, 0, 3, 1), box(8, 8, 9, 9)])
    assert sorted(round(kernels.area(r), 6) for r in one) == [1, 3]


@pytest.mark.parametrize("missing", [0, 1, 2])
def test_traced_outline(missing):
    """All sides; one side with a gap, joined; one side absent, where a wall runs along it."""
    ring = box(0, 0, 6, 4)
    s = lines(ring)
    walls = []
    if missing == 1:
        s[3, 3] = 1.5
    if missing == 2:
        s = s[:3]
        walls = [box(-0.3, -1, -0.02, 5)]
    clutter = np.array([[20, 20, 21, 20], [6, 4, 7, 5.0]])
    got = polygons.traced(np.vstack([s, clutter]), ring, np.array([3.0, 2.0]), walls)
    assert got is not None and abs(kernels.area(got) - 24) < 1.5
    assert polygons.traced(clutter, ring, np.array([3.0, 2.0]), []) is None


def test_straight_stretches_and_what_solids_leave():
    bent = np.array([[0, 0], [5, 0], [5, 0.2], [0.2, 0.2], [0.2, 3], [0, 3]])
    got = polygons.straight_stretches(bent)
    assert sorted(round(kernels.area(p), 3) for p in got) == [0.56, 0.96]
    long_ = max(got, key=kernels.area)
    rest = polygons.rest_of(long_, [box(0.2, -1, 3.2, 1)])
    assert [round(kernels.area(p), 3) for p in rest] == [0.36] and len(polygons.rest_of(long_, [box(0, -1, 1, 1)])) == 1


def test_footprint_regions_and_edges():
    columns = [box(x, y, x + 0.5, y + 0.5) for x in range(0, 25, 4) for y in range(0, 13, 4)]
    f = polygons.Footprint(columns, 1.0, 3.0, np.array([[10.2, 1, 10.2, 11]]))
    (a, da), (b, _), (none, _) = f.region_of([[5, 6], [15, 6], [40, 40]])
    assert {a, b} == {1, 2} and none == 0 and da > 4
    (gap, angle), (deep, _) = f.edge_of([[0.25, 4.25], [12, 6]])
    assert abs(gap - 1.25) < 0.3 and abs(np.sin(angle - np.pi / 2)) < np.sin(np.radians(15)) and deep > 4
    whole = polygons.Footprint(columns, 1.0, 3.0)
    assert len({k for k, _ in whole.region_of([[5, 6], [15, 6]])}) == 1


def test_hatch_measures():
    a = np.array([[i * 0.05, 0.0] for i in range(60)])
    b = a + [0, 0.3]
    assert abs(polygons.local_thickness(np.vstack([a, b]), (a + b)[::7] / 2) - 0.3) < 1e-9
    assert abs(polygons.grid_area(a, b, 0.06) - 2.95 * 0.3) < 0.25
    assert polygons.hatch_families(np.radians([45] * 10 + [135] * 4)) and not polygons.hatch_families(np.radians([45] * 10 + [135] * 2))


def test_a_long_chain_of_conflicts(spark):
    """More links than rounds, and a rank that runs along the chain: what is undecided is passed through in order."""
    nodes = spark.createDataFrame([(i, i) for i in range(40)], "id long, rank long")
    clash = spark.createDataFrame([(i, i + 1) for i in range(39)], "a long, b long")
    assert sorted(r.id for r in suppress(nodes, clash, rounds=3).collect()) == list(range(0, 40, 2))
    assert suppress(nodes, clash.limit(0)).count() == 40


def test_painted_pieces_are_one_shape(spark):
    def fill(idx, ring):
        return ("p", idx, [{"x": float(x), "y": float(y)} for x, y in ring])

    rows = [fill(1, box(0, 0, 1, 1)), fill(3, box(1.01, 0, 2, 1)), fill(9, box(2, 0, 3, 1)), fill(10, box(7, 7, 8, 8))]
    df = spark.createDataFrame(rows, f"plan_id string, idx int, ring {shapes.RING}")
    got = [(r.idx, round(r.a, 2)) for r in shapes.paint_groups(df, 3, 0.02).select("idx", G.area(F.col("ring")).alias("a")).orderBy("idx").collect()]
    assert [i for i, _ in got] in ([1, 9, 10], [1, 1, 9, 10]) and abs(sum(a for _, a in got) - 4) < 0.05


def test_anchor_beside_a_turned_box(spark):
    """From the left end of the upper long side, out along its normal; above the corner for compact elements."""
    ring = [{"x": float(x), "y": float(y)} for x, y in turned(box(0, 0, 10, 1), 45)]
    df = spark.createDataFrame([(ring,)], f"ring {shapes.RING}")
    a = df.select(G.anchor(F.col("ring"), 0.6, F.lit(True), F.lit(0), F.lit(0)).alias("a")).first().a
    assert abs(a.angle - 45) < 1e-9 and abs(a.x - 0.6 * np.sin(np.pi / 4)) < 1e-9 and abs(a.y + 0.6 * np.cos(np.pi / 4)) < 1e-9
    c = df.select(G.anchor(F.col("ring"), 0.6, F.lit(False), F.lit(2), F.lit(3)).alias("a")).first().a
    assert (c.x, c.y, c.angle) == (2.0, 2.4, 0.0)


def test_lines_between_equal_all_pairs(spark):
    rng = random.Random(6)
    rows = [("a", i, rng.uniform(0, 60), lo, lo + rng.uniform(1, 9)) for i in range(60) for lo in [rng.uniform(0, 9)]]
    df = spark.createDataFrame(rows, "plan string, id long, off double, lo double, hi double")
    pairs = [("a", p[1], q[1], p[2], q[2], max(p[3], q[3]), min(p[4], q[4])) for p in rows for q in rows if p[1] < q[1] and abs(p[2] - q[2]) <= 8 and min(p[4], q[4]) > max(p[3], q[3])]
    got = between(spark.createDataFrame(pairs, "plan string, i long, j long, off_i double, off_j double, `from` double, `to` double"), df, ["plan"], 0.1, 0.3, 8.0)
    want = {}
    for _, i, j, u, v, lo, hi in pairs:
        want[i, j] = sum(k[1] not in (i, j) and min(u, v) + 0.1 < k[2] < max(u, v) - 0.1 and min(k[4], hi) - max(k[3], lo) > 0.3 * (hi - lo) for k in rows)
    assert {(r.i, r.j): r.inside for r in got.collect()} == want and max(want.values()) > 1


def test_stages_on_the_drawn_plan(spark):
    """Footprint, regions, pens and text directions of the synthetic building."""
    from strataplan.plans import detect as D
    from strataplan.tolerances import Tolerances

    paths, texts = plan("p")
    t = Tolerances()
    p, x = spark.createDataFrame(paths, dumps.PATHS), dumps.clean_texts(spark.createDataFrame(texts, dumps.TEXTS))
    p, x = D.scaled(p, x, D.calibrate(p, x, dumps.read_config()))
    found, loose = D.solids(p, t)
    assert found.count() == 29 and loose.count() == 0 and {r.pen for r in found.collect()} == {0.0}
    assert D.joints(D.segments(p, x, t), t).count() == 0
    assert D.text_directions(x, p).count() == 0
    width, by_class, per_building = D.size_meaning(dumps.read_config())
    assert width["retaining_wall"] and not width["column"] and by_class["retaining_wall"] and set(per_building) == set(by_class)


def test_ward_equals_a_plain_pass():
    """Every cut of the merges against clusters joined one pair at a time by the growth of their squares."""
    from strataplan.operators import ward

    rng = np.random.default_rng(5)
    x = rng.normal(size=(24, 3))
    groups = [[i] for i in range(24)]
    pairs = ward.merges(x)
    while len(groups) > 1:
        cost = {(a, b): len(p) * len(q) / (len(p) + len(q)) * ((x[p].mean(0) - x[q].mean(0)) ** 2).sum() for a, p in enumerate(groups) for b, q in enumerate(groups) if a < b}
        a, b = min(cost, key=cost.get)
        groups = [g for k, g in enumerate(groups) if k not in (a, b)] + [groups[a] + groups[b]]
        labels = ward.cut(pairs, 24, len(groups))
        assert {frozenset(np.flatnonzero(labels == k).tolist()) for k in range(len(groups))} == {frozenset(g) for g in groups}
    labels = ward.cut(pairs, 24, 4)
    d = np.sqrt(ward.squares(x))
    plain = []
    for i in range(24):
        own = [d[i, j] for j in range(24) if j != i and labels[j] == labels[i]]
        other = min(np.mean([d[i, j] for j in range(24) if labels[j] == k]) for k in range(4) if k != labels[i])
        plain.append((other - np.mean(own)) / max(other, np.mean(own)) if own else 0)
    assert abs(ward.silhouette(d, labels) - np.mean(plain)) < 1e-9
