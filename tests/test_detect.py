"""The whole detection on a drawn plan, with its stages' results known."""

import json

import pytest

from strataplan.plans.detect import detect
from strataplan.sources import dumps, sinks
from tests.synthetic import K, plan


@pytest.fixture(scope="module")
def found(spark):
    paths, texts = plan("p")
    bad_texts = [("empty", 0, "P1/128", {"x0": 0.0, "y0": 0.0, "x1": 9.0, "y1": 3.0})]
    p = spark.createDataFrame(paths, dumps.PATHS)
    t = dumps.clean_texts(spark.createDataFrame(texts + bad_texts, dumps.TEXTS))
    return detect(p, t, dumps.read_config())


def test_scale(found):
    got = {r.plan_id: r for r in found.calibration.collect()}
    assert got["p"].status == "ok" and abs(got["p"].k - K) < 1e-3 and abs(got["p"].gap - 3.0) < 1e-2
    assert got["empty"].status == "too few samples"


def test_objects_and_classes(found):
    rows = found.objects.collect()
    kinds = {k: sum(r.kind == k for r in rows) for k in ("solid", "outline", "band")}
    assert kinds == {"solid": 29, "outline": 24, "band": 4}
    by = {}
    for r in rows:
        by.setdefault((r.kind, r["class"]), []).append(r)
    assert len(by[("solid", "column")]) == 24 and len(by[("outline", "isolated_footing")]) == 24 and len(by[("band", "grade_beam")]) == 4
    assert {r.type_key for r in by[("band", "grade_beam")]} == {"LG40x15"}
    assert {r.type_key for r in by[("solid", "column")]} == {"P1/128"}
    walls = [r for r in rows if r.kind == "solid" and r["class"] != "column"]
    assert len(walls) == 5 and sum(r.type_key == "V3/128" for r in walls) == 4
    assert sorted(r.number for r in rows) == list(range(1, len(rows) + 1))
    assert all(abs(r.width - 0.4) < 1e-6 and abs(r.length - 38) < 1e-6 for r in by[("band", "grade_beam")])


def test_sinks(found):
    rows = sinks.detections(found.objects, found.calibration)
    one = [json.loads(r.json) for r in sinks.to_json(rows).collect()]
    assert len(one) == rows.count() and all({"id", "class", "bbox_px", "label", "building"} <= set(r) for r in one)
    beam = next(r for r in one if r["class"] == "grade_beam")
    assert beam["element_type"] == "beam" and "net_length_m" in beam and beam["display_label"].startswith("Grade beam LG40x15 38.00 × 0.40 m")
    assert "net_length_m" not in next(r for r in one if r["class"] == "column")
    assert {r["class"]: r.n for r in sinks.class_counts(found.objects).collect()}["column"] == 24
    svg = sinks.to_svg(sinks.draw_commands(found.objects)).collect()
    assert any(r.layer == "column" and r.svg.count("<polygon") == 24 for r in svg)
    assert all(r.place > 0 and r.members for r in sinks.unidentified_groups(found.objects, found.calibration).collect())


def test_documents(found):
    one = {r.plan_id: json.loads(r.json) for r in sinks.documents(found.objects, found.calibration).collect()}
    assert list(one) == ["p"] and one["p"]["calibration"]["scale"] == "1/200" and one["p"]["source"] == "p"
    assert one["p"]["counts"]["column"] == 24 and list(one["p"]["counts"])[0] == "column" and one["p"]["image"]["dpi"] == 150
    ids = [d["id"] for d in one["p"]["detections"]]
    assert ids == sorted(ids) and len(ids) == sum(one["p"]["counts"].values())
    assert {"group", "drawing_kind", "count", "description", "members"} <= set(one["p"]["unidentified_groups"][0]) if one["p"]["unidentified_groups"] else True
    log = {(r.plan_id, r.what): r.n for r in found.log.collect()}
    assert log["p", "objects: solid"] == 29 and log["p", "paths"] == 75


@pytest.fixture(scope="module")
def more(spark):
    paths, texts = plan("m", more=True)
    return detect(spark.createDataFrame(paths, dumps.PATHS), dumps.clean_texts(spark.createDataFrame(texts, dumps.TEXTS)), dumps.read_config())


def test_stamped_raft_is_traced_and_named(more):
    raft = [r for r in more.objects.collect() if r.kind == "stamped_region"]
    assert len(raft) == 1 and raft[0].traced and abs(raft[0].area - 64) < 0.1
    assert raft[0]["class"] == "raft" and raft[0].key == "Radier 60" and raft[0].label == "Radier 60 CM"


def test_hatched_bent_and_painted_walls(more):
    rows = more.objects.collect()
    hatch = [r for r in rows if r.kind in ("single_hatch", "cross_hatch")]
    assert len(hatch) == 1 and abs(hatch[0].length - 6) < 0.5 and abs(hatch[0].thickness - 0.26) < 0.05
    new = sorted((round(r.length, 2), round(r.width, 2)) for r in rows if r.kind == "solid" and r.y0 > 33)
    assert new == [(3.75, 0.25), (4.0, 0.25), (5.75, 0.25)]
    assert sum(r.kind == "solid" for r in rows) == 29 + 3


def test_joint_cuts_the_building(more):
    log = {r.what: r.n for r in more.log.collect()}
    assert log["joints"] == 1 and log["regions"] >= 2 and log["traced regions"] == 1
    assert {r.class_ for r in more.objects.selectExpr("class as class_").collect()} >= {"column", "isolated_footing", "grade_beam", "raft"}


def test_render_says_what_it_needs(found):
    import importlib.util

    if importlib.util.find_spec("pymupdf") is None:
        with pytest.raises(RuntimeError, match="PyMuPDF"):
            sinks.render(sinks.draw_commands(found.objects), found.calibration, found.calibration)


def test_stream(spark, tmp_path):
    from strataplan.streaming.plans import watch

    paths, texts = plan("s")
    spark.createDataFrame(paths, dumps.PATHS).write.parquet(str(tmp_path / "paths"))
    spark.createDataFrame(texts, dumps.TEXTS).write.parquet(str(tmp_path / "texts"))
    seen = []
    q = watch(spark, str(tmp_path / "paths"), str(tmp_path / "texts"), str(tmp_path / "state"), lambda r, n: seen.append(r.calibration.first().status))
    q.awaitTermination(300)
    assert seen == ["ok"]


def test_pdf_source_says_what_it_needs(spark):
    import importlib.util

    if importlib.util.find_spec("pymupdf") is None:
        with pytest.raises(RuntimeError, match="PyMuPDF"):
            dumps.read_pdfs(spark, "/nowhere")
