"""Work that must not grow with copies: boxes of one shape are measured once, grids are numbers of bits."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from boxfield.operators import estimators, fitting, layout, masks, spatial, support, trims
from boxfield.operators import rects as R
from boxfield.plans import registry
from conftest import SF

NEAR = ((spatial, "near_points", 1), (support, "near_points", 1), (trims, "near_points", 1))


def test_covered_share_makes_no_row_per_grid_point(spark):
    rows = [(v, i, float(i * 7 % 50), float(i * 11 % 40), float(i * 7 % 50 + 20), float(i * 11 % 40 + 15)) for v in (0, 1) for i in range(12)]
    out = R.covered_share(spark.createDataFrame(rows, "view_id bigint, rect_id bigint, x0 double, y0 double, x1 double, y1 double"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "399" not in plan and "Expand" not in plan
    got = {(r.view_id, r.rect_id): r.share for r in out.collect()}
    for v, i, x0, y0, x1, y1 in rows:
        hit = 0
        for s in range(400):
            x, y = x0 + (x1 - x0) * (s % 20 + 0.5) / 20, y0 + (y1 - y0) * (s // 20 + 0.5) / 20
            hit += any(w == v and j != i and a <= x <= c and b <= y <= d for w, j, a, b, c, d in rows)
        assert got[v, i] == hit / 400


@pytest.fixture(scope="session")
def copies(tmp_path_factory) -> str:
    """The tables of sf0.001 three times over with shifted keys."""
    d = tmp_path_factory.mktemp("copies")
    for name, keys in {"lineitem": "l_orderkey+i*1500 AS l_orderkey", "supplier": "s_suppkey+i*100 AS s_suppkey"}.items():
        duckdb.sql(f"COPY (SELECT * REPLACE ({keys}) FROM '{SF}/{name}.parquet', range(3) g(i)) TO '{d}/{name}.parquet' (FORMAT parquet)")
    return str(d)


#: Queries by what joins their points or boxes: (module, function, place of the table that must hold each shape once).
SHAPED = {
    "agent_confidence": NEAR,
    "clusters_covered": ((fitting, "points_in_rects", 1),),
    "column_slice": NEAR,
    "diag_support": NEAR,
    "extended_face_supported": NEAR,
    "face_coverage": NEAR,
    "face_support": NEAR,
    "furniture_filter": NEAR,
    "near_boxes_mask": (NEAR[1],),
    "outer_wall_filter": (NEAR[0],),
    "own_points": NEAR,
    "probe_filled": NEAR,
    "region_axis_span": NEAR,
    "region_axis_span_mesh": NEAR,
    "region_floor_and_slice": NEAR,
    "free_row_end": ((layout, "strip_points", 1),),
    "trim_sparse_top": NEAR,
    "denoise_cloud": ((estimators, "nearest", 0),),
    "yaw_vote": ((estimators, "nearest", 0),),
    "aabb_gap_xy": ((spatial, "box_pairs", 0),),
}


@pytest.mark.parametrize("name", SHAPED)
def test_a_shape_is_measured_once(spark, copies, monkeypatch, name):
    """As many boxes, rectangles or places are joined as are different, and the result is that of the SQL."""
    seen = []
    for module, function, place in SHAPED[name]:
        real = getattr(module, function)

        def watched(*args, real=real, place=place, **more):
            seen.append((args[place].count(), args[place].drop("box_id", "rect_id", "n", "__n", "__held", "path").distinct().count()))
            return real(*args, **more)

        monkeypatch.setattr(module, function, watched)
    out = registry.QUERIES[name](spark, copies)
    rows = out.toPandas()
    assert seen and all(n == different for n, different in seen)
    if name in registry.SQL:
        con = duckdb.connect()
        for t in ("lineitem", "supplier"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{copies}/{t}.parquet'")
        want = con.sql(registry.SQL[name]).df()[list(rows.columns)]
        key = list(rows.columns)
        a, b = (x.sort_values(key).reset_index(drop=True) for x in (rows, want))
        pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9)


def test_visible_points_meet_the_cloud_before_boxes(spark, monkeypatch):
    """The cloud is not joined with boxes, and the rows are those of all pairs."""
    rng = np.random.default_rng(1)
    cloud = [(i, *map(float, p)) for i, p in enumerate(rng.uniform(-0.9, 0.9, (3000, 3)))]
    lifted = [(1, i, 0, *map(float, p)) for i, p in enumerate(rng.uniform(-0.9, 0.9, (60, 3)))]
    given = [(7, 0.1, 0.0, 0.0, 0.6, 0.5, 0.6, 0.3), (9, 0.1, 0.0, 0.0, 0.6, 0.5, 0.6, 0.3), (8, -0.3, 0.2, 0.1, 0.4, 0.4, 0.4, 0.0)]
    calls, real = [], masks.inside
    monkeypatch.setattr(masks, "inside", lambda *a, **k: calls.append(a[1].count()) or real(*a, **k))
    out = masks.visible_points(spark.createDataFrame(lifted, "view_id bigint, px int, py int, x double, y double, z double"), spark.createDataFrame(cloud, "pt_id bigint, x double, y double, z double"), spark.createDataFrame(given, "box_id bigint, cx double, cy double, cz double, sl double, sw double, sh double, yaw double"))
    got = sorted((r.box_id, r.px) for r in out.collect())

    def held(p, b, margin):
        dx, dy, c, s = p[0] - b[1], p[1] - b[2], math.cos(b[7]), math.sin(b[7])
        return abs(dx * c + dy * s) <= b[4] / 2 + margin and abs(dy * c - dx * s) <= b[5] / 2 + margin and abs(p[2] - b[3]) <= b[6] / 2 + margin

    want = sorted((b[0], p[1]) for b in given for p in lifted if held(p[3:], b, 0.25) and any(math.dist(p[3:], q[1:]) <= 0.06 and held(q[1:], b, 0.30) for q in cloud))
    assert got == want and len(want) > 3 and calls == [2]


def test_lifted_points_are_not_collected_to_be_broadcast(spark, sf):
    """Rows that come of arrays are far more than Catalyst takes them for; none of the joins sends them through the driver."""
    plan = registry.QUERIES["visible_mask_points"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    broadcast = [part for part in plan.split("BroadcastExchange")[1:]]
    assert "SortMergeJoin" in plan and not any("embedding" in part.split("FileScan")[1].split("\n")[0] for part in broadcast if "FileScan" in part)


def test_denoised_points_are_not_joined_back_for_sums(spark, sf):
    """The query sums over places; the cloud is read once, for these."""
    out = registry.QUERIES["denoise_cloud"](spark, sf)
    assert "LeftSemi" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.first().n > 0
