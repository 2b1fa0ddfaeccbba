"""Counts of points by box taken in numpy: against all pairs, and that pairs and points are no rows."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from boxfield.operators import fitting, layout, spatial, support, tallies, trims
from boxfield.plans import registry

BOX = "box_id bigint, cx double, cy double, cz double, sl double, sw double, sh double, yaw double"


def made(spark, scenes: bool):
    rng = np.random.default_rng(3)
    p = [(i, *map(float, xyz), int(i % 3)) for i, xyz in enumerate(rng.uniform(-2, 2, (3000, 3)))]
    p += [(9000, None, 0.0, 0.0, 0), (9001, math.nan, 0.0, 0.0, 1), (9002, math.inf, 0.0, 0.0, 1)]
    b = [(i, *map(float, rng.uniform(-1, 1, 3)), *map(float, rng.uniform(0.5, 1.5, 3)), float(rng.uniform(-3, 3)), int(i % 3)) for i in range(9)]
    points, boxes = spark.createDataFrame(p, "pt_id bigint, x double, y double, z double, scene_id int"), spark.createDataFrame(b, BOX + ", scene_id int")
    return (points, boxes) if scenes else (points.drop("scene_id"), boxes.drop("scene_id"))


@pytest.mark.parametrize("scenes", (False, True))
def test_tallies_count_what_pairs_hold(spark, monkeypatch, scenes):
    """Boxes in blocks of four, points a few at a time: the counts and the marked points of the join of all pairs."""
    monkeypatch.setattr(tallies, "BOXES_AT_ONCE", 4)
    monkeypatch.setattr(tallies, "ROWS_AT_ONCE", 500)
    points, boxes = made(spark, scenes)
    size = lambda b, p: (np.array([len(tallies.within(b, p, 0.1))]),)
    got = {r.box_id: r.n for r in spatial.near_points(points, boxes, 0.1, tally=size, ddl="n bigint").groupBy("box_id").agg({"n": "sum"}).toDF("box_id", "n").collect() if r.n}
    pairs = spatial.inside(points, boxes, 0.1)
    assert got == {r.box_id: r["count"] for r in pairs.groupBy("box_id").count().collect()} and len(got) > 6

    def mark(b, p):
        hit = np.zeros(len(p.u), bool)
        hit[tallies.within(b, p, 0.1)] = True
        return hit

    met = [r.pt_id for r in spatial.near_points(points, boxes, 0.1, mark=mark).collect()]
    assert sorted(met) == sorted(r.pt_id for r in pairs.select("pt_id").distinct().collect())


def test_cells_far_apart_need_no_row_each():
    """The words of few cells in a large box are those of many in a small one."""
    cell = np.array([5, 5, 700_000_063, 64, 700_000_000])
    word, bits = tallies.occupied(cell, 10**9)
    assert [(int(w), int(b) & (2**64 - 1)) for w, b in zip(word, bits)] == [(0, 32), (1, 1), (10937500, 2**63 | 1)]
    word, bits = tallies.occupied(np.array([5, 5, 127, 64]), 130)
    assert [(int(w), int(b) & (2**64 - 1)) for w, b in zip(word, bits)] == [(0, 32), (1, 2**63 | 1)]


#: Queries that count where the points are: the join by cells is not made for them.
TALLIED = ["diag_support", "extended_face_supported", "face_coverage", "face_support", "furniture_filter", "near_boxes_mask", "probe_filled", "region_axis_span_mesh", "region_floor_and_slice"]


@pytest.mark.parametrize("name", TALLIED)
def test_pairs_are_no_rows(spark, sf, monkeypatch, name):
    for module in (spatial, support, trims):
        real = module.near_points

        def watched(*args, real=real, **more):
            assert more.get("tally") or more.get("mark"), "pairs of points and boxes are rows"
            return real(*args, **more)

        monkeypatch.setattr(module, "near_points", watched)
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_points_of_rectangles_are_no_rows(spark, sf, monkeypatch):
    """Rectangles are fitted without a join with points; only deep ones, of which there are none here, are cut by one."""
    monkeypatch.setattr(fitting, "points_in_rects", lambda *a, **k: pytest.fail("pairs of points and rectangles are rows"))
    rows = registry.QUERIES["fit_region_boxes"](spark, sf).collect()
    assert rows and {r.part for r in rows} == {0}


def test_only_the_faces_asked_for_are_counted(spark):
    """Two faces by name are those two of all five."""
    points, boxes = made(spark, False)
    rows = lambda *a, **k: sorted(map(tuple, support.face_coverage(points, boxes, 0.05, *a, **k).collect()))
    both = rows(names=("front", "back"))
    assert both == [r for r in rows() if r[1] in ("front", "back")] and any(r[2] for r in both)


def test_furniture_is_measured_where_a_box_may_be_it(spark, monkeypatch):
    """Boxes of another shape or source are not compared with points; the verdicts are those of all boxes measured."""
    points, boxes = made(spark, False)
    boxes = boxes.union(spark.createDataFrame([(i, 50.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0) for i in (9, 10, 11)], BOX))  # with nothing near
    boxes = boxes.selectExpr("*", "CASE box_id%3 WHEN 0 THEN 'agent_fix' WHEN 1 THEN 'manual' END source", "'mid' confidence")
    every = support.overhead(points, boxes).join(support.support_fraction(points, boxes).select("box_id", "support"), "box_id")
    want = {r.box_id: r.f for r in every.selectExpr("box_id", "source<>'agent_fix' AND sh<=1.2 AND least(sl,sw)>=0.45 AND NOT overhead AND support<0.25 f").collect()}
    asked, real = [], support.near_points
    monkeypatch.setattr(support, "near_points", lambda p, b, *a, **k: asked.append(b.count()) or real(p, b, *a, **k))
    got = {r.box_id: r.furniture for r in support.furniture_filter(points, boxes).collect()}
    assert got == want and asked and max(asked) < len(want) and True in got.values()


@pytest.mark.parametrize("name", ("free_row_end", "open_side"))
def test_strips_are_summed_where_the_points_are(spark, sf, monkeypatch, name):
    """Points a few at a time, boxes a few at a time: the result is that of the SQL, and splats are not joined with boxes."""
    monkeypatch.setattr(tallies, "ROWS_AT_ONCE", 700)
    monkeypatch.setattr(layout, "BOXES_AT_ONCE", 4)
    plans, real = [], layout.strip_points
    monkeypatch.setattr(layout, "strip_points", lambda *a, **k: plans.append(real(*a, **k)) or plans[-1])
    got = registry.QUERIES[name](spark, sf).toPandas()
    assert plans and "Join" not in plans[0]._jdf.queryExecution().optimizedPlan().toString()
    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(registry.SQL[name]).df()[list(got.columns)]
    pd.testing.assert_frame_equal(*(x.sort_values("box_id", ignore_index=True) for x in (got, want)), check_dtype=False, rtol=1e-9)
