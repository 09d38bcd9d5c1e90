"""Registered queries against their SQL, and the operators' invariants against brute force."""

import itertools
import random

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from strataplan.functions import kernels
from strataplan.operators import assign, ward, windows
from strataplan.operators.graph import components
from strataplan.operators.joins import grid_join
from strataplan.operators.suppress import suppress
from strataplan.plans import queries as own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(own.ORACLE_SQL))
def test_query_equals_sql(name, spark, small, db):
    got, want = own.QUERIES[name](spark, small).toPandas(), db.sql(own.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True).astype(str) for x in (got, want))
    assert a.equals(b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_ordered_groups(spark):
    rng = random.Random(5)
    rows = [(k, i, *sorted((rng.uniform(0, 20), rng.uniform(0, 20)))) for k in range(3) for i in sorted(rng.sample(range(200), 40))]
    df = spark.createDataFrame(rows, "k int, i long, lo double, hi double")
    got = {(r.k, r.i): r.group_no for r in windows.order_groups(df, ["k"], "i", "lo", "hi", 4, 0.5).collect()}
    last, group = {}, {}
    for k, i, lo, hi in rows:
        p = last.get(k)
        if p and i - p[0] <= 4 and lo <= p[2] + 0.5 and hi >= p[1] - 0.5:
            p = (i, min(p[1], lo), max(p[2], hi), p[3])
        else:
            p = (i, lo, hi, (p[3] if p else 0) + 1)
        last[k], group[k, i] = p, p[3]
    assert got == group


def test_suppress_equals_sequential_pass(spark):
    rng = random.Random(2)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(120)}
    kept = suppress(spark.createDataFrame([(i, (i * 37) % 61) for i in range(60)], "id long, rank long"), spark.createDataFrame(sorted(pairs), "a long, b long"))
    want: set = set()
    for i in sorted(range(60), key=lambda i: (i * 37) % 61):
        if not any(tuple(sorted((i, j))) in pairs for j in want):
            want.add(i)
    assert {r.id for r in kept.collect()} == want


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_components_of_all_rows(spark, small, db):
    """Every customer, order and part with a line is in a row; one component is a chain of all customers."""
    edges = db.sql("SELECT 3 * c_custkey, 3 * c_custkey + 3 FROM customer UNION ALL SELECT 3 * l_orderkey + 1, 3 * l_partkey + 2 FROM lineitem").fetchall()
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = own.QUERIES["j01_components_all"](spark, small).collect()
    assert len(got) == len(root) and {r.node: r.root for r in got} == {n: find(n) for n in root}
    assert sum(r.root == 0 for r in got) == db.sql("SELECT count(*) FROM customer").fetchall()[0][0] + 1 > 100


def test_assignment_equals_brute_force(spark):
    rng = random.Random(4)
    for _ in range(30):
        n, m = rng.randint(1, 5), rng.randint(1, 6)
        cost = np.array([[rng.uniform(0, 5) for _ in range(n + m)] for _ in range(n)])
        got = assign.cheapest(cost)
        assert abs(cost[np.arange(n), got].sum() - min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n + m), n))) < 1e-9
    edges = [("p", 1, 1, 1, 0.2), ("p", 2, 1, 1, 1.0), ("q", 1, 1, 2, 0.2), ("q", 2, 1, 2, 1.0), ("q", 3, 1, 2, 3.6), ("q", 4, 2, 1, None)]
    got = assign.assign(spark.createDataFrame(edges, "plan_id string, label_id long, obj_id long, slots int, cost double"), 3.5)
    assert sorted((r.plan_id, r.label_id) for r in got.collect()) == [("p", 1), ("q", 1), ("q", 2)]


def test_ward():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.05, (8, 2)) for c in ((0, 0), (3, 0), (0, 3), (3, 3), (6, 0), (6, 6), (9, 9))])
    k, labels, s = ward.best_cut(x, 6, 14)
    assert k == 7 and s > 0.9 and len({tuple(labels[i : i + 8]) for i in range(0, 56, 8)}) == 7
    coarse, fine = ward.cut(ward.merges(x), 56, 6), ward.cut(ward.merges(x), 56, 9)
    assert all(len(set(coarse[fine == c])) == 1 for c in range(9))


def test_kernels():
    rng = np.random.default_rng(1)
    for _ in range(50):
        w, h, a = rng.uniform(1, 5), rng.uniform(0.2, 0.9), rng.uniform(0, np.pi)
        box = np.array([[0, 0], [w, 0], [w, h], [0, h]]) @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])
        got = kernels.smallest_box(box)
        assert abs(got["length"] - w) < 1e-9 and abs(got["width"] - h) < 1e-9
        turn = abs(got["angle_deg"] - np.degrees(a) % 180) % 180
        assert min(turn, 180 - turn) < 1e-6
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1.0]])
    assert abs(kernels.overlap_area(square, square + [0.04, 0]) - 0.96) < 1e-12 and kernels.overlap_area(square, square + 2) == 0


def test_kernels_equal_jts(spark):
    geom = spark._jvm.org.locationtech.jts.io.WKTReader()
    rng = np.random.default_rng(3)

    def wkt(p):
        return "POLYGON((" + ", ".join(f"{x} {y}" for x, y in np.vstack([p, p[:1]])) + "))"

    for _ in range(20):
        a, b = (kernels.hull(rng.uniform(0, 3, (8, 2))) for _ in range(2))
        assert abs(geom.read(wkt(a)).intersection(geom.read(wkt(b))).getArea() - kernels.overlap_area(a, b)) < 1e-9


def test_grid_join_equals_all_pairs(spark):
    rng = random.Random(8)
    boxes = [(i, x, y, x + rng.uniform(0, 3), y + rng.uniform(0, 3)) for i in range(60) for x, y in [(rng.uniform(-5, 15), rng.uniform(-5, 15))]]
    a = spark.createDataFrame(boxes, "i int, x0 double, y0 double, x1 double, y1 double")
    b = a.toDF("j", "u0", "v0", "u1", "v1")
    got = [(r.i, r.j) for r in grid_join(a, b, ("x0", "y0", "x1", "y1"), ("u0", "v0", "u1", "v1"), 2.0, reach=0.5).collect()]
    want = {(p[0], q[0]) for p in boxes for q in boxes if p[1] - 0.5 <= q[3] and q[1] <= p[3] + 0.5 and p[2] - 0.5 <= q[4] and q[2] <= p[4] + 0.5}
    assert len(got) == len(set(got)) and set(got) == want


def test_theta_joins_are_planned_as_equi_joins(spark, small):
    for name in ("d10_parallel_pairs", "d30_label_edges", "d32_joint_pairs", "d34_knn_vote"):
        plan = own.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan
