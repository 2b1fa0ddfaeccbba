"""Scenarios for boxes, clouds, rectangles, replies and files, on hand-made rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxfield.functions import geometry as G
from boxfield.functions import text as T
from boxfield.operators import estimators as E
from boxfield.operators import layout as L
from boxfield.operators import profiles as P
from boxfield.operators import rects as R
from boxfield.operators import support as S
from boxfield.sources import layouts as J
from boxfield.sources import ply

BOX = "box_id bigint, cx double, cy double, cz double, sl double, sw double, sh double, yaw double, confidence string, source string, device_type string, score double"


def boxes(spark, *rows):
    return spark.createDataFrame([(i, cx, cy, sh / 2, sl, sw, sh, yaw, "mid", "coarse_seg", "rack", 0.5) for i, cx, cy, sl, sw, sh, yaw in rows], BOX)


def cloud(spark, xyz):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "pt_id bigint, x double, y double, z double")


def turned(points, yaw, cx=0.0, cy=0.0):
    c, s = math.cos(yaw), math.sin(yaw)
    return [(x * c - y * s + cx, x * s + y * c + cy, z) for x, y, z in points]


def sheet(y, n=11, step=0.1, length=1.0, height=2.0):
    return [(x, y, z) for x in np.arange(-length / 2 + 0.05, length / 2, step) for z in np.arange(0.05, height, step)]


@pytest.mark.parametrize("yaw", [0.0, 0.4, -1.2])
def test_faces_do_not_depend_on_direction(spark, yaw):
    two = sheet(0.5) + sheet(-0.5)
    b = boxes(spark, (1, 3.0, 2.0, 1.0, 1.0, 2.0, yaw), (2, 9.0, 9.0, 1.0, 1.0, 2.0, yaw))
    got = {r.box_id: (r.matched_faces, r.new_confidence) for r in S.face_support(cloud(spark, turned(two, yaw, 3.0, 2.0)), b).collect()}
    assert got == {1: (2, "high"), 2: (0, "low")}


def test_support_counts_voxels_once(spark):
    b = boxes(spark, (1, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0))
    one = S.support_fraction(cloud(spark, [(0.01, 0.01, 0.55)] * 10), b).first()
    assert (one.n_pts, one.support) == (10, 1 / 1000)
    assert S.support_fraction(cloud(spark, [(0.01, 0.01, 0.55)] * 4), b).first().support == 0.0


def test_scenes_do_not_meet(spark):
    p = cloud(spark, [(0.01 * i, 0.0, 0.5) for i in range(20)])
    two = p.withColumn("scene_id", F.lit("a")).unionByName(p.withColumn("scene_id", F.lit("b")).where("pt_id < 10"))
    b = boxes(spark, (1, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0)).withColumn("scene_id", F.lit("a")).unionByName(boxes(spark, (2, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0)).withColumn("scene_id", F.lit("b")))
    assert {r.box_id: r.n_pts for r in S.support_fraction(two, b).collect()} == {1: 20, 2: 10}
    assert {(r.box_id, r.n) for r in S.own_points(two, b).groupBy("box_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {(1, 20), (2, 10)}
    assert L.overlaps(b, b).where("box_id <> other").count() == 0
    t = E.floor_tiles(two.withColumn("z", F.col("z") + F.when(F.col("scene_id") == "b", 3.0).otherwise(0.0)))
    assert {(r.scene_id, r.floor_z) for r in t.collect()} == {("a", 0.5), ("b", 3.5)}
    assert E.height_above_floor(two, t).count() == 30


def test_tall_box_needs_overhead_points(spark):
    tray = [(0.0, 0.0, 3.0 + 0.3 + 0.001 * i) for i in range(40)]
    b = boxes(spark, (1, 0.0, 0.0, 1.0, 1.0, 3.0, 0.0), (2, 5.0, 5.0, 1.0, 1.0, 3.0, 0.0))
    got = {r.box_id: r.new_confidence for r in S.structural_filter(cloud(spark, tray), b).collect()}
    assert got == {1: "mid", 2: "low"}


def test_own_points_are_in_no_other_box(spark):
    b = boxes(spark, (1, 0.0, 0.0, 1.0, 1.0, 2.0, 0.0), (2, 0.6, 0.0, 1.0, 1.0, 2.0, 0.0))
    got = {(r.box_id, r.pt_id) for r in S.own_points(cloud(spark, [(-0.4, 0, 1), (0.3, 0, 1), (0.9, 0, 1), (0.3, 0.8, 1)]), b).collect()}
    assert got == {(1, 0), (2, 2), (1, 3), (2, 3)}


def test_thin_points_are_dropped(spark):
    blob = [(x, y, z) for x in np.arange(0.15, 1.2, 0.3) for y in np.arange(0.15, 1.2, 0.3) for z in np.arange(0.15, 1.2, 0.3)]
    wire = [(8.0, 8.0, z) for z in np.arange(0.15, 3, 0.3)]
    kept = E.thick_points(cloud(spark, blob + wire)).collect()
    assert len(kept) == len(blob) and max(r.x for r in kept) < 2


def test_noise_is_dropped(spark):
    rng = np.random.default_rng(1)
    body = rng.uniform(0, 1, (400, 3)).tolist()
    kept = E.denoised(cloud(spark, [*body, (1.9, 1.9, 1.9)]), k=5, cell=1.0, least=100)
    assert kept.where("x > 1.5").count() == 0 and kept.count() > 350


def test_iou_and_matching(spark):
    a = boxes(spark, (1, 0.0, 0.0, 1.0, 1.0, 2.0, 0.0), (2, 5.0, 0.0, 1.0, 1.0, 2.0, 0.3))
    b = boxes(spark, (7, 0.5, 0.0, 1.0, 1.0, 2.0, 0.0), (8, 0.1, 0.0, 1.0, 1.0, 2.0, 0.0), (9, 5.0, 0.0, 1.0, 1.0, 2.0, 0.3))
    got = {(r.box_id, r.other): r for r in L.overlaps(a, b).collect()}
    assert abs(got[1, 7].iou - 1 / 3) < 0.03 and abs(got[1, 7].contained - 0.5) < 0.03 and got[2, 9].iou > 0.97
    row = L.evaluate(a, b).first()
    assert (row.n_gt, row.n_pred, row.n_matched, row.recall) == (2, 3, 2, 1.0)
    assert L.evaluate(a, b.limit(0)).first().n_matched == 0


def test_greedy_equals_the_ordered_loop(spark):
    draw = random.Random(3)
    rows = sorted({(t, p): round(draw.random(), 2) for t in range(8) for p in range(8) if draw.random() < 0.5}.items())
    want, ts, ps = set(), set(), set()
    for iou, t, p in sorted(((v, t, p) for (t, p), v in rows), reverse=True):
        if t not in ts and p not in ps:
            want.add((t, p))
            ts.add(t)
            ps.add(p)
    got = L.greedy_matches(spark.createDataFrame([(t, p, v) for (t, p), v in rows], "truth bigint, pred bigint, iou double"))
    assert {(r.truth, r.pred) for r in got.collect()} == want


def test_two_tiers(spark):
    b = boxes(spark, (1, 0.0, 0.0, 1.0, 1.0, 2.0, 0.0), (2, 0.1, 0.0, 1.0, 1.0, 2.0, 0.0), (3, 0.25, 0.0, 1.0, 1.0, 2.0, 0.0), (4, 0.6, 0.0, 1.0, 1.0, 2.0, 0.0))
    b = b.withColumns({"n_pts": F.lit(100) - F.col("box_id"), "tilt": F.col("box_id") == 4})
    assert {r.box_id for r in L.two_tier_kept(b).collect()} == {1}
    far = boxes(spark, (5, 9.0, 9.0, 1.0, 1.0, 2.0, 0.0)).withColumns({"n_pts": F.lit(1), "tilt": F.lit(True)})
    assert {r.box_id for r in L.two_tier_kept(b.unionByName(far)).collect()} == {1, 5}


def test_seams_cascade(spark):
    b = boxes(spark, (1, 0.0, 0.0, 1.0, 1.0, 2.0, 0.0), (2, 1.08, 0.0, 1.0, 1.0, 2.0, 0.0), (3, 3.0, 0.0, 1.0, 1.0, 2.0, 0.0))
    got = {r.box_id: (round(r.lo, 3), round(r.hi, 3)) for r in L.snapped_seams(L.rows(b, 0.0)).collect()}
    assert got == {1: (-0.5, 0.54), 2: (0.54, 1.58), 3: (2.5, 3.5)}


def test_clusters_join_over_one_cell(spark):
    block = lambda x0: [(x0 + 0.02 * (i % 10), 0.02 * (i // 10), 1.0) for i in range(100)]
    got = L.cell_clusters(cloud(spark, block(0.0) + block(0.65) + block(5.0) + [(9.0, 9.0, 1.0)] * 3)).collect()
    assert sorted(r.n for r in got) == [100, 200]


def test_body_top_stops_at_a_void(spark):
    z = [0.02 * (i % 100) for i in range(400)] + [3.0] * 50
    got = P.body_tops(spark.createDataFrame([(1, v) for v in z] + [(2, 1.0)] * 3, "box_id bigint, z double"), ["box_id"]).collect()
    assert len(got) == 1 and abs(got[0].top - 2.0) < 0.06


def test_repeated_columns_are_dropped(spark):
    kind = "view_id bigint, rect_id bigint, x0 double, y0 double, x1 double, y1 double"
    rows = [(1, k, 100.0, 100.0 + 320 * k, 900.0, 300.0 + 320 * k) for k in range(3)]
    towers = [(2, k, 500.0, 20.0 + 240 * k, 700.0, 260.0 + 240 * k) for k in range(4)]
    kept = R.without_repeats(spark.createDataFrame(rows + towers, kind))
    assert {(r.view_id, r.rect_id) for r in kept.collect()} == {(1, 0), (1, 1), (1, 2)}


def test_camera_round_trip(spark):
    cam = G.Camera((0.0, 3.0, 1.0), (0.0, 0.0, 1.0), fovy_deg=60, width=32, height=32)
    p = cloud(spark, [(0.2, -1.0, 0.4), (-0.5, 0.5, 0.9)])
    px, py, depth = cam.project("x", "y", "z")
    q = p.select("x", "y", "z", px.alias("px"), py.alias("py"), depth.alias("d"))
    back = cam.at_depth("px", "py", "d")
    for r in q.select("x", "y", "z", *(v.alias(f"b{i}") for i, v in enumerate(back))).collect():
        assert all(abs(a - b) < 1e-9 for a, b in zip(r[:3], r[3:]))


def test_replies():
    assert T.last_json('draft {"a": 1} then {"b": {"c": 2}}') == {"b": {"c": 2}}
    assert T.last_json('cut [1, 2', "[") is None and T.last_json(None) is None
    assert T.last_json('{"open": {"in": 3}', "{") == {"in": 3}
    text = 'first [{"bbox_2d": [0.1, 0.1, 0.2, 0.2], "label": "x"}] then\n{"bbox_2d": [1, 2, 30, 40]}\n{"bbox_2d": [5, 6, 70, 80], "label": "rack"}\nquality: good'
    assert T.box_groups(text) == [([1.0, 2.0, 30.0, 40.0], ""), ([5.0, 6.0, 70.0, 80.0], "rack")]
    assert T.box_groups('{"candidate_groups": [{"box": [0, 0, 1000, 1000]}, {"box": [5, 5, 1, 1]}]}') == [([0.0, 0.0, 1000.0, 1000.0], "")]
    assert T.box_groups(None) == []


def test_polygon_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    cols = {c: rng.normal(size=50).astype("f4") for c in ply.SPLAT}
    (tmp_path / "a.ply").write_bytes(ply.ply_bytes(cols))
    (tmp_path / "b.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty double y\nproperty float z\nend_header\n1 2 3\n4 5 6\n")
    np.save(tmp_path / "c.npy", np.arange(12.0).reshape(4, 3))
    got = ply.read_points(spark, f"file://{tmp_path}").groupBy("file").count().collect()
    assert sorted(r["count"] for r in got) == [2, 4, 50]
    splats = ply.read_splats(spark, f"file://{tmp_path}")
    assert splats.count() == 50 and abs(splats.agg(F.sum("opacity")).first()[0] - float(cols["opacity"].astype(float).sum())) < 1e-6
    ply.PlySource.register(spark)
    assert spark.read.format("ply").load(str(tmp_path / "b.ply")).select("x", "y", "z").collect() == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]
    part = ply.ply_parts(ply.read_points(spark, f"file://{tmp_path}").where("file like '%b.ply'"), ["x", "y", "z"]).collect()
    assert sum(len(ply.vertices(bytes(r.content))["x"]) for r in part) == 2
    for bad in (b"ply\nformat ascii 1.0\nelement face 1\nproperty list uchar int v\nend_header\n", b"ply\nelement vertex 0\nend_header\n", b"ply\nformat ascii 1.0\n"):
        with pytest.raises(ValueError):
            ply.header(bad)


def test_layout_files(spark, tmp_path):
    b = boxes(spark, (1, 0.0, 0.0, 1.0, 1.0, 2.0, 0.3), (2, 2.0, 0.0, 1.0, 1.0, 2.0, 0.0))
    text = "[" + ",".join(r.value for r in J.to_json(b).collect()) + "]"
    (tmp_path / "boxes.json").write_text(text)
    assert J.read_layout(spark, str(tmp_path / "boxes.json")).orderBy("box_id").select("box_id", "yaw").collect() == [(1, 0.3), (2, 0.0)]
    (tmp_path / "objects.json").write_text('{"objects": [{"name": "CRAC unit", "centroid": {"x": 1, "y": 2, "z": 3}, "dimensions": {"length": 1, "width": 2, "height": 3}, "rotations": {"x": 0, "y": 0, "z": 90}}]}')
    r = J.read_layout(spark, str(tmp_path / "objects.json")).first()
    assert (r.device_type, r.cx, round(r.yaw, 6)) == ("ac", 1.0, round(math.pi / 2, 6))
    names = spark.createDataFrame([(1, "rack"), (2, "unknown"), (3, "rack_2"), (4, "rack")], "box_id bigint, n string")
    assert [x.name for x in J.output_names(names, F.col("n")).orderBy("box_id").collect()] == ["rack", "unknown", "rack_2", "rack_3"]


def test_replies_whole_and_broken(spark):
    replies = [
        (1, '```json\n[{"bbox_2d": [100, 200, 300, 400], "label": "rack"}]\n```'),
        (2, '{"regions": [{"x0": 10, "y0": 20, "x1": 110, "y1": 90, "label": ""}]}'),
        (3, '[{"bbox_2d": [64, 128, 1280, 512]}]'),
        (4, "no devices here"),
        (5, "({'bbox 2d': [500, 500, 600, 700], 'label': 'cabinet'}), {\"bbox _2d\": [0, 0, 250, 250]}, {bbox_2d: [1, 2, 3"),
        (6, 'draft [{"bbox_2d": [0, 0, 1, 1]}] final [{"bbox_2d": [0, 0, 500, 500]}, {"bbox_2d": [-2000, 0, 500, 500]}]'),
        (7, None),
    ]
    got = {(r.reply_id, r.k): (r.label, r.x0, r.y0, r.x1, r.y1) for r in T.grounded_rects(spark.createDataFrame(replies, "reply_id int, text string"), 1280, 1024).collect()}
    assert got == {
        (1, 0): ("rack", 128.0, 204.8, 384.0, 409.6),
        (2, 0): ("device", 10.0, 20.0, 110.0, 90.0),
        (3, 0): ("device", 64.0, 128.0, 1280.0, 512.0),
        (5, 0): ("cabinet", 640.0, 512.0, 768.0, 716.8), (5, 1): ("device", 0.0, 0.0, 320.0, 256.0),
        (6, 0): ("device", 0.0, 0.0, 640.0, 512.0), (6, 1): ("device", 0.0, 0.0, 500.0, 500.0),
    }


def test_boxes_of_a_shape_are_matched_without_rows_for_pairs(spark, monkeypatch):
    """Copies of few shapes, many overlaps alike: the matches are those of all pairs in order, and of the rounds."""
    rng = np.random.default_rng(2)
    made = lambda n, i0: [(int(i), float(x) * 0.1, float(y) * 0.2, 0.0, 1.0, 0.8, 1.0, 0.0) for i, x, y in zip(rng.permutation(n) + i0, rng.integers(0, 4, n), rng.integers(0, 3, n))]
    ddl = "box_id bigint, cx double, cy double, cz double, sl double, sw double, sh double, yaw double"
    truth, pred = spark.createDataFrame(made(50, 0), ddl), spark.createDataFrame(made(40, 100), ddl)
    rank = sorted(((r.iou, r.box_id, r.other) for r in L.overlaps(truth, pred).collect() if r.iou >= 0.3), reverse=True)
    want, used = [], set()
    for iou, t, p in rank:
        if not used & {t, p}:
            used |= {t, p}
            want.append((t, p, iou))
    rounds = sorted(map(tuple, L.matches(truth, pred).collect())) if monkeypatch.setattr(L, "MATCHED_AT_ONCE", 0) is None else None
    monkeypatch.undo()
    monkeypatch.setattr(L, "by_pair", lambda *a: pytest.fail("a row for each pair of boxes"))
    assert sorted(map(tuple, L.matches(truth, pred).collect())) == sorted(want) == rounds
    assert len(want) > 30 and len({w[2] for w in want}) < len(want)
