"""Faces on sheets, cuts and guards of boxes, on small made clouds."""

from __future__ import annotations

import numpy as np
import pandas as pd

from boxfield.operators import faces as X
from boxfield.operators import masks as M
from boxfield.operators import spans as N
from boxfield.operators import trims as T

BOX = "box_id bigint, cx double, cy double, cz double, sl double, sw double, sh double, yaw double"


def scene(spark, parts):
    """Clouds and boxes far apart, one box for each: {box_id: (points, (sl, sw, sh))}."""
    xyz, boxes = [], []
    for k, (pts, size) in parts.items():
        at = np.array([30.0 * k, 0.0, 0.0])
        xyz.append(np.asarray(pts) + at)
        boxes.append((k, *map(float, at[:2]), size[2] / 2, *map(float, size), 0.0))
    p = pd.DataFrame(np.concatenate(xyz), columns=list("xyz"))
    return spark.createDataFrame(p.reset_index(names="pt_id")), spark.createDataFrame(boxes, BOX)


def sheet(rng, y, n=1500, top=2.0, thick=0.01):
    return np.c_[rng.uniform(-1, 1, n), y + rng.uniform(-thick, thick, n), rng.uniform(0, top, n)]


def test_faces_snap_to_sheets(spark):
    rng = np.random.default_rng(1)
    back = lambda: sheet(rng, -0.5)
    size = (2.0, 1.0, 2.1)
    plateau = np.c_[rng.uniform(-1, 1, 400), rng.uniform(0.5, 0.65, 400), rng.uniform(0, 2, 400)]
    high = np.c_[rng.uniform(-1, 1, 900), 0.60 + rng.uniform(-0.01, 0.01, 900), rng.uniform(2.25, 3.0, 900)]
    pts, boxes = scene(spark, {
        0: (np.r_[back(), sheet(rng, 0.5)], size),  # on the sheets: stays
        1: (np.r_[back(), sheet(rng, 0.40)], size),  # the face is bare, a sheet stands inside
        2: (np.r_[back(), sheet(rng, 0.60)], size),  # a sheet stands outside
        3: (np.r_[back(), sheet(rng, 0.5), plateau], size),  # an open door does not move it
        4: (np.r_[back(), sheet(rng, 0.60, 60), high], size),  # what stands outside is overhead structure
        5: (np.r_[back(), sheet(rng, 0.74, 3000)], size),  # farther out, but filled all over
        6: (sheet(rng, 0.0, 30), size),  # too few points
    })
    got = {r.box_id: r for r in X.snapped_faces(pts, boxes).collect()}
    near = lambda k, depth: abs(got[k].sw - depth) < 0.035
    assert near(0, 1.0) and near(1, 0.9) and near(2, 1.1)
    assert abs(got[3].sw - 1.0) < 0.05  # within the bin next to the sheet
    assert not got[4].moved and not got[6].moved
    assert near(5, 1.24) and abs(got[5].cy - 0.12) < 0.03
    assert abs(got[1].cy + 0.05) < 0.03 and got[1].moved


def test_observed_faces_stay(spark):
    rng = np.random.default_rng(2)
    pts, boxes = scene(spark, {1: (np.r_[sheet(rng, -0.5), sheet(rng, 0.40)], (2.0, 1.0, 2.1))})
    boxes = boxes.selectExpr("*", "array('front') observed")
    assert not X.snapped_faces(pts, boxes, locked="observed").first().moved


def test_sparse_tops_are_cut(spark):
    rng = np.random.default_rng(3)
    body = np.c_[rng.uniform(-1, 1, 8000), rng.uniform(-0.5, 0.5, 8000), rng.uniform(0, 2.0, 8000)]
    tail = np.c_[rng.uniform(-1, 1, 60), rng.uniform(-0.5, 0.5, 60), rng.uniform(2.0, 2.6, 60)]
    ladder = np.c_[rng.uniform(-1, -0.8, 3000), rng.uniform(-0.5, -0.4, 3000), rng.uniform(2.0, 2.6, 3000)]
    pts, boxes = scene(spark, {1: (np.r_[body, tail], (2.0, 1.0, 2.6)), 2: (np.r_[body, ladder], (2.0, 1.0, 2.6)), 3: (body, (2.0, 1.0, 2.0))})
    got = {r.box_id: r for r in T.trimmed_tops(pts, boxes).collect()}
    assert got[1].trimmed and abs(got[1].sh - 2.0) < 0.11 and abs(got[1].cz - got[1].sh / 2) < 1e-9
    assert got[2].trimmed and abs(got[2].sh - 2.0) < 0.11
    assert not got[3].trimmed


def test_nested_boxes_are_cut_once(spark):
    rng = np.random.default_rng(5)
    own = np.c_[rng.uniform(0.5, 1.0, 400), rng.uniform(-0.5, 0.5, 400), rng.uniform(0, 2.0, 400)]
    pts = spark.createDataFrame(pd.DataFrame(own, columns=list("xyz")).reset_index(names="pt_id"))
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 2.0, 1.0, 2.0, 0.0), (2, 0.75, 0.0, 1.0, 0.5, 1.0, 2.0, 0.0), (3, -0.75, 0.0, 1.0, 0.4, 1.0, 2.0, 0.0)], BOX)
    got = {r.box_id: (round(r.cx, 3), round(r.sl, 3)) for r in T.nested_trimmed(pts, boxes).collect()}
    assert got == {1: (-0.25, 1.5), 2: (0.75, 0.5), 3: (-0.75, 0.4)}  # nothing of the third box's own is there to cut


SPAN = "view_id int, span_id int, lo double, hi double, ms double, n int, label string, px0 double, py0 double, px1 double, py1 double"


def test_spans_are_cut_in_the_middle_unless_seen_twice(spark):
    rows = [
        (1, 1, 0.0, 1.0, 0.5, 10, "a", 0.0, 0.0, 100.0, 100.0), (1, 2, 0.95, 2.0, 0.6, 20, "b", 100.0, 0.0, 200.0, 100.0),  # two devices
        (2, 1, 0.0, 1.0, 0.5, 10, "a", 0.0, 0.0, 100.0, 100.0), (2, 2, 0.1, 1.2, 0.6, 20, "b", 5.0, 0.0, 105.0, 100.0),  # one device twice
        (3, 1, 0.0, 1.0, 0.5, 10, "a", None, None, None, None), (3, 2, 0.8, 2.0, 0.6, 20, "b", None, None, None, None),
    ]
    got = {(r.view_id, r.span_id): (round(r.lo, 3), round(r.hi, 3), r.n, r.label) for r in N.merged_spans(spark.createDataFrame(rows, SPAN)).collect()}
    assert got == {(1, 1): (0.0, 0.975, 10, "a"), (1, 2): (0.975, 2.0, 20, "b"), (2, 1): (0.0, 1.2, 30, "b"), (3, 1): (0.0, 0.9, 10, "a"), (3, 2): (0.9, 2.0, 20, "b")}


def test_contested_points_go_to_the_nearer_mass(spark):
    rng = np.random.default_rng(7)
    device = np.c_[rng.uniform(0.0, 1.0, 300), rng.uniform(0, 1, 300), rng.uniform(0, 2, 300)]
    clutter = np.c_[rng.uniform(1.6, 1.9, 60), rng.uniform(0, 1, 60), rng.uniform(0, 1, 60)]
    pts = pd.DataFrame(np.r_[device, clutter, [[1.05, 0.5, 0.5]]], columns=list("xyz")).reset_index(names="pt_id")
    boxes = spark.createDataFrame([(1, 0.55, 0.5, 1.0, 1.1, 1.0, 2.0, 0.0), (2, 1.45, 0.5, 0.5, 0.9, 1.0, 1.0, 0.0)], BOX)
    got = {(r.box_id, r.pt_id) for r in M.suppressed(spark.createDataFrame(pts), boxes).collect()}
    assert (2, 360) in got and (1, 360) not in got
    assert all((1, k) in got or pts.x[k] > 1.1 + 0.6 for k in range(300, 360))


def test_layout_files_of_both_kinds(spark, tmp_path):
    from boxfield.sources import layouts as J

    (tmp_path / "in").mkdir()
    obj = '{"objects": [{"name": "rack_1", "centroid": {"x": 1, "y": 2, "z": 1}, "dimensions": {"length": 1, "width": 0.6, "height": 2}, "rotations": {"x": 0, "y": 0, "z": 90}}]}'
    for name, text in (("a.json", '[{"box_id": 7, "cx": 1.0, "cy": 2.0, "cz": 1.0, "sl": 1.0, "sw": 0.5, "sh": 2.0}]'), ("b.json", obj), ("c.json", obj)):
        (tmp_path / "in" / name).write_text(text)
    got = J.read_layout(spark, str(tmp_path / "in"))
    rows = sorted((r.file[-6:], r.box_id, r.device_type, r.score) for r in got.collect())
    assert rows == [("a.json", 7, "unknown", 0.5), ("b.json", 0, "rack", 0.5), ("c.json", 0, "rack", 0.5)]
    J.save_layout(got.where("file like '%a.json'").drop("file"), str(tmp_path / "out"))
    again = J.read_layout(spark, str(tmp_path / "out") + "/*.txt").collect()
    assert [(r.box_id, r.cx, r.confidence) for r in again] == [(7, 1.0, "mid")]


def test_reports_and_log_options(spark, tmp_path):
    import json

    from boxfield.sources import layouts as J
    from boxfield.streaming import log

    m = spark.createDataFrame([(10, 8, 8, 0.8, 1.0, 0.123456, 0.03125, 0.2)], "n_gt bigint, n_pred bigint, n_matched bigint, recall double, precision double, edge_accuracy double, mean_edge_error_m double, p90_edge_error_m double")
    assert J.rounded_metrics(m).first().edge_accuracy == 0.1235 and "8 of 10" in J.metrics_line(m).first().summary
    value = J.agent_report(spark.createDataFrame([(3,)], "box_id int"), spark.createDataFrame([(1, "split")], "box_id int, action string"), spark.createDataFrame([("fit", 1.5)], "stage string, seconds double")).first().value
    assert json.loads(value) == {"unresolved": [{"box_id": 3}], "actions_taken": [{"box_id": 1, "action": "split"}], "performance": {"fit": 1.5}}
    rows = spark.createDataFrame([(1, "confirm", 0.5)], "box_id long, kind string, confidence double").selectExpr("timestamp_seconds(60) ts", "*")
    keeper = log.Recorder()
    assert not keeper.record(rows)
    keeper.set(str(tmp_path / "log"))
    assert keeper.record(rows) and log.read(spark, str(tmp_path / "log")).first().kind == "confirm"
