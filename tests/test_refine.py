from __future__ import annotations

import numpy as np

from boxfield.operators import refine as R

BOX = "box_id bigint, cx double, cy double, cz double, sl double, sw double, sh double, yaw double"


def test_row_is_filled_once_and_walked_outwards(spark):
    rng = np.random.default_rng(0)
    body = np.c_[rng.uniform(-0.3, 3.3, 30000), rng.uniform(-0.5, 0.5, 30000), rng.uniform(0, 2, 30000)]
    pts = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(body[::6])], "pt_id bigint, x double, y double, z double")
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.6, 1.0, 2.0, 0.0), (2, 0.6, 0.0, 1.0, 0.6, 1.0, 2.0, 0.0), (3, 1.8, 0.0, 1.0, 0.6, 1.0, 2.0, 0.0)], BOX)
    got = sorted((r.place, r.step, round(r.cx, 2)) for r in R.filled_rows(pts, boxes, 0.0).collect())
    assert got == [("gap2", 1, 1.2), ("high end", 1, 2.41), ("high end", 2, 3.01)]


def test_boundary_cells_go(spark):
    cells = [(i, j, 1, i * 0.25, j * 0.25) for i in range(12) for j in range(12)]
    df = spark.createDataFrame(cells, "i bigint, j bigint, n bigint, mx double, my double")
    kept = {(r.i, r.j) for r in R.off_boundary(df).collect()}
    assert kept == {(i, j) for i in range(2, 10) for j in range(2, 10)}
    assert R.off_boundary(df.limit(5)).count() == 5
    assert R.off_boundary(df.limit(0)).count() == 0


def test_hull_turns_one_way():
    rng = np.random.default_rng(3)
    h = R.hull(np.r_[rng.uniform(-1, 1, (200, 2)), [[-2, -2], [2, -2], [2, 2], [-2, 2]]])
    assert sorted(map(tuple, h.tolist())) == [(-2, -2), (-2, 2), (2, -2), (2, 2)]


def test_faces_and_refits(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, 1.0, 2.0, 0.0), (2, 5.0, 0.0, 1.0, 1.0, 1.0, 2.0, 0.0)], BOX)
    m = spark.createDataFrame([(1, "front", 0.7, 50), (1, "front", 0.9, 10), (2, "front", 9.0, 50)], "box_id bigint, face string, plane double, points bigint")
    got = {r.box_id: (round(r.cy, 3), round(r.sw, 3)) for r in R.faces_applied(boxes, m).collect()}
    assert got == {1: (0.1, 1.2), 2: (0.0, 1.0)}


def test_boxes_join_over_bridged_gaps(spark):
    from boxfield.operators import merging as M

    rng = np.random.default_rng(4)
    part = lambda x0, x1, n: np.c_[rng.uniform(x0, x1, n), rng.uniform(-0.5, 0.5, n), rng.uniform(0, 2, n)]
    xyz = np.r_[part(0, 2.3, 2300), part(5, 6, 1000), part(6.3, 7.3, 1000)]
    pts = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "pt_id bigint, x double, y double, z double")
    boxes = spark.createDataFrame([(1, 0.5, 0.0, 1.0, 1.0, 1.0, 2.0, 0.0), (2, 1.8, 0.0, 1.0, 1.0, 1.0, 2.0, 0.0), (3, 5.5, 0.0, 1.0, 1.0, 1.0, 2.0, 0.0), (4, 6.8, 0.0, 1.0, 1.0, 1.0, 2.0, 0.0)], BOX)
    assert {r.box_id: r.group for r in M.merged_groups(pts, boxes).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_a_long_row_is_one_group(spark):
    from boxfield.operators import merging as M

    boxes = spark.range(80).toDF("box_id")
    links = spark.range(59).selectExpr("id a", "id + 1 b").union(spark.createDataFrame([(70, 71)], "a bigint, b bigint"))
    got = {r.box_id: r.group for r in M.grouped(boxes, links).collect()}
    assert got == {i: 0 if i < 60 else 70 if i == 71 else i for i in range(80)}


def test_bridged_cabinets_of_a_long_row_are_one_group(spark):
    from boxfield.operators import merging as M

    xyz = [(0.1 * k + 0.05, 0.1 * j - 0.45, 1.0) for k in range(420) for j in range(10)]
    pts = spark.createDataFrame([(i, *p) for i, p in enumerate(xyz)], "pt_id bigint, x double, y double, z double")
    boxes = spark.createDataFrame([(i, 1.05 * i + 0.5, 0.0, 1.0, 1.0, 1.0, 2.0, 0.0) for i in range(40)], BOX)
    assert {r.group for r in M.merged_groups(pts, boxes).collect()} == {0}
