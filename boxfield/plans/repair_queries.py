"""Queries of guards, cuts, masks and ownership, with their plain SQL where there is one."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from .. import views as V
from ..functions.text import is_subtractive
from ..operators import directions as D
from ..operators import estimators as E
from ..operators import faces as X
from ..operators import layout as L
from ..operators import masks as M
from ..operators import rects as R
from ..operators import spatial
from ..operators import support as S
from ..operators import trims as T
from ..operators.rects import checkpointed
from ..operators.spatial import by_shape, inside, places
from ..operators.tallies import within
from .cloud_queries import r, rs
from .sql_views import BOX, POINTS, RECTS, given, inside as sql_inside, near
from .view_queries import CAM, PROJ, SMALL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(given(POINTS, BOX, near("1e0"), "sl AS (SELECT box_id, k-sh/2e0 o FROM near WHERE abs(u)<=greatest(0.3e0, least(0.8e0, 0.25e0*sl)) AND abs(v-sw/2e0)<=0.06e0 AND k>-sh/2e0+0.3e0)", "gd AS (SELECT box_id, count(*) n, count(*) FILTER (o<=0.05e0) body, count(*) FILTER (o>0.1e0) high, quantile_cont(o, 0.95) FILTER (o>0.1e0) p95 FROM sl GROUP BY 1)")
       + "SELECT b.box_id, coalesce(n>=12 AND body>=12 AND NOT coalesce(high>=8 AND p95>0.15e0, false) AND high<=greatest(8e0, floor(0.5e0*body)), false) ok FROM v_boxes b LEFT JOIN gd ON gd.box_id=b.box_id")
def height_boundary(spark, d):
    c = V.boxes(spark, d).withColumns({"u_at": F.lit(0.0), "v_at": F.col("sw") / 2, "end": F.lit(False)})
    return T.height_guard(V.points(spark, d), c).select("box_id", "ok")


@query()
def trim_sparse_top(spark, d):
    return T.trimmed_tops(V.points(spark, d), tall(spark, d)).select("box_id", "trimmed", r("cz").alias("cz"), r("sh").alias("sh"))


def tall(spark, d):
    """The boxes, twice as high, so that they reach above the points."""
    return V.boxes(spark, d).withColumns({"cz": F.col("cz") + F.col("sh") / 2, "sh": F.col("sh") * 2})


def nested(spark, d):
    """Long boxes three metres apart, each with a small one at its right end."""
    b = V.boxes(spark, d).withColumns({"yaw": F.lit(0.0), "cx": F.expr("(cx-0.5e0)*3e0+1.5e0"), "cy": F.expr("cy*1.5e0"), "sw": F.lit(1.0), "cz": F.lit(1.0), "sh": F.lit(2.0)})
    long, small = b.withColumns({"box_id": F.expr("box_id*2"), "sl": F.lit(2.0)}), b.withColumns({"box_id": F.expr("box_id*2+1"), "cx": F.expr("cx+0.75e0"), "sl": F.lit(0.5)})
    return long.unionByName(small)


@query()
def nested_trim(spark, d):
    c = T.nested_cuts(V.points(spark, d), nested(spark, d))
    return c.select("box_id", "small", "side", r("lo").alias("lo"), r("hi").alias("hi"))


@query()
def trim_nested_boxes(spark, d):
    b = T.nested_trimmed(V.points(spark, d), nested(spark, d))
    return b.select("box_id", *(r(c).alias(c) for c in ("cx", "cy", "sl", "sw")))


@query(given(POINTS, BOX, near("1e0")) + f"SELECT box_id, count(*) n, {rs('avg(v)')} mid FROM near WHERE abs(u)<=sl/2e0+0.05e0 AND k>0.3e0-sh/2e0 AND k<=sh/2e0 GROUP BY 1")
def column_slice(spark, d):
    def profile(shapes):
        return T.column_slice(places(V.points(spark, d)), shapes).groupBy("box_id").agg(F.sum("__n").alias("n"), (F.sum(F.col("v") * F.col("__n")) / F.sum("__n")).alias("mid"))

    return by_shape(V.boxes(spark, d), profile, "inner").select("box_id", "n", r("mid").alias("mid"))


@query("SELECT event_id, CASE WHEN event_id%90>=60 AND value/100e0+0.15e0<3.4e0-0.3e0 THEN round(value/100e0+0.15e0,6) END z_cap FROM events")
def side_z_cap(spark, d):
    e = V.table(spark, d, "events").selectExpr("event_id", "value/100e0 top", "event_id%90 n")
    cap = T.z_capped(F.col("top"), F.lit(3.4), F.col("n"))
    return e.select("event_id", F.when(cap < 1e300, F.round(cap, 6)).alias("z_cap"))


_MASK = "mk AS (SELECT DISTINCT CAST(event_id%1280 AS BIGINT) px, CAST((event_id*7)%1024 AS BIGINT) py FROM events)"


def view_mask(spark, d):
    m = V.table(spark, d, "events").selectExpr("event_id%1280 px", "(event_id*7)%1024 py").distinct()
    return m.crossJoin(V.boxes(spark, d).select("box_id"))  # the same pixels for each box


def shown(spark, d, **options):
    return M.mask_points(V.points(spark, d), V.boxes(spark, d), view_mask(spark, d), CAM, **options)


_SEEN = given(POINTS, BOX, PROJ, _MASK, near("0.25e0").replace("JOIN v_points p", "JOIN pp p"), sql_inside("0.25e0"), "sn AS (SELECT box_id, pt_id, u, c2 depth, CAST(round_even(px,0) AS BIGINT) ix, CAST(round_even(py,0) AS BIGINT) iy FROM ins)", "iv AS (SELECT * FROM sn WHERE ix BETWEEN 0 AND 1279 AND iy BETWEEN 0 AND 1023)", "zb AS (SELECT *, min(depth) OVER (PARTITION BY box_id, ix, iy) z FROM iv WHERE depth>0.05e0)")


@query(_SEEN + "SELECT box_id, pt_id FROM zb JOIN mk ON mk.px=zb.ix AND mk.py=zb.iy WHERE depth<=z+0.12e0")
def mask_to_points(spark, d):
    return shown(spark, d).select("box_id", "pt_id")


@query(_SEEN + f"SELECT box_id, {rs('quantile_cont(u,0.02)')} lo, {rs('quantile_cont(u,0.98)')} hi, count(*) n FROM iv JOIN mk ON mk.px=iv.ix AND mk.py=iv.iy GROUP BY 1 HAVING quantile_cont(u,0.98)-quantile_cont(u,0.02)>=0.1e0 AND count(*)>=5")
def mask_along_span(spark, d):
    return M.mask_spans(shown(spark, d, hidden=True), ["box_id"], least_length=0.1, least=5).withColumns({"lo": r("lo"), "hi": r("hi")})


@query()
def visible_mask_points(spark, d):
    lifted = M.depth_mask_points(V.pixels(spark, d), SMALL)
    return M.visible_points(lifted, V.points(spark, d), V.boxes(spark, d)).select("box_id", "view_id", "px", "py")


@query("WITH c AS (SELECT user_id box_id, event_id%4 group_id, event_id mask_id, value score, event_id%60 n, CASE event_id%5 WHEN 1 THEN 'Door panel' WHEN 2 THEN 'cable tray' WHEN 3 THEN 'Ladder' ELSE 'rack' END l FROM events) SELECT box_id, group_id, mask_id, score, n FROM c WHERE l='rack' AND n>=20 QUALIFY row_number() OVER (PARTITION BY box_id, group_id ORDER BY score DESC, mask_id)=1")
def side_thickness_pool(spark, d):
    c = V.table(spark, d, "events").selectExpr("user_id box_id", "event_id%4 group_id", "event_id mask_id", "value score", "event_id%60 n", "CASE event_id%5 WHEN 1 THEN 'Door panel' WHEN 2 THEN 'cable tray' WHEN 3 THEN 'Ladder' ELSE 'rack' END label")
    return M.thickness_pool(c, ["box_id", "group_id"], is_subtractive("label"))


@query()
def neighbour_suppression(spark, d):
    return M.suppressed(V.points(spark, d), V.boxes(spark, d)).groupBy("box_id").agg(F.count(F.lit(1)).alias("n"))


_CL = "cl AS (SELECT box_id rect_id, cx-0.6e0 x0, cy-0.6e0 y0, cx+0.6e0 x1, cy+0.6e0 y1 FROM v_boxes), ft AS (SELECT cx-sl/2e0-0.1e0 a0, cy-sw/2e0-0.1e0 b0, cx+sl/2e0+0.1e0 a1, cy+sw/2e0+0.1e0 b1 FROM v_boxes WHERE score>0.5e0)"


@query(given(POINTS, BOX, _CL, "ht AS (SELECT DISTINCT pt_id hit, x hx, y hy FROM v_points JOIN ft ON x BETWEEN a0 AND a1 AND y BETWEEN b0 AND b1)", "iq AS (SELECT pt_id, x, y, hit IS NOT NULL h FROM v_points LEFT JOIN ht ON hit=pt_id AND hx=x AND hy=y)") + "SELECT rect_id, count(pt_id) n, count(*) FILTER (h) inside, count(pt_id)<30 OR count(*) FILTER (h)>=0.65e0*count(pt_id) covered FROM cl LEFT JOIN iq ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1")
def clusters_covered(spark, d):
    b = V.boxes(spark, d)
    clusters = b.selectExpr("box_id rect_id", "cx-0.6e0 x0", "cy-0.6e0 y0", "cx+0.6e0 x1", "cy+0.6e0 y1")
    fitted = b.where("score > 0.5").selectExpr("cx-sl/2e0 x0", "cy-sw/2e0 y0", "cx+sl/2e0 x1", "cy+sw/2e0 y1")
    return M.clusters_covered(V.points(spark, d), clusters, fitted)


@query(given(BOX) + "SELECT box_id, source='row_completion' AND confidence='low' completed, sw<0.35e0 thin, abs((cx+0.2e0-cx)*cos(yaw)+(cy+0.1e0-cy)*sin(yaw))<=sl/2e0+0.3e0 AND abs((cy+0.1e0-cy)*cos(yaw)-(cx+0.2e0-cx)*sin(yaw))<=sw/2e0+0.3e0 in_seed FROM v_boxes")
def acceptance_rules(spark, d):
    b = V.boxes(spark, d)
    return b.select("box_id", S.low_completion().alias("completed"), S.too_thin().alias("thin"), S.piece_in_seed(F.col("cx") + 0.2, F.col("cy") + 0.1).alias("in_seed"))


@query(given(RECTS, "ov AS (SELECT a.*, b.x0 bx0, b.y0 by0, b.x1 bx1, b.y1 by1 FROM v_rects a JOIN v_rects b ON a.view_id=b.view_id AND a.rect_id<>b.rect_id AND a.x0<=b.x1 AND b.x0<=a.x1 AND a.y0<=b.y1 AND b.y0<=a.y1)", "hi AS (SELECT view_id, rect_id, count(DISTINCT s) n FROM ov, range(0,400) t(s) WHERE x0+(x1-x0)*(s%20+0.5e0)/20e0 BETWEEN bx0 AND bx1 AND y0+(y1-y0)*(floor(s/20e0)+0.5e0)/20e0 BETWEEN by0 AND by1 GROUP BY 1,2)")
       + "SELECT view_id, rect_id FROM v_rects LEFT JOIN hi USING (view_id, rect_id) WHERE coalesce(n,0)/400e0<0.25e0")
def tilt_rects_uncovered(spark, d):
    return R.covered_share(V.rects(spark, d)).where("share < 0.25").select("view_id", "rect_id")


@query()
def denoise_cloud(spark, d):
    kept = E.denoised_places(V.points(spark, d))
    mean = lambda c: F.sum(F.col(c) * F.col("__n")) / F.sum("__n")
    return kept.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n"), r(mean("x")).alias("mx"), r(mean("z")).alias("mz"))


@query()
def yaw_vote(spark, d):
    found = D.voted_yaw(V.points(spark, d))
    rows = [(k, round(a, 6), round(s, 6), round(found.yaw, 6), D.arbitration_needed(found)) for k, (a, s) in enumerate(found.candidates)]
    return spark.createDataFrame(rows, "place int, deg double, score double, yaw double, arbitration boolean")


@query()
def wall_yaw(spark, d):
    found = D.wall_yaw(V.points(spark, d))
    return spark.createDataFrame([(round(found[0], 6), round(found[1], 6))] if found else [], "yaw double, share double")


TILT = [[math.cos(0.1), 0.0, math.sin(0.1)], [0.0, 1.0, 0.0], [-math.sin(0.1), 0.0, math.cos(0.1)]]


@query()
def align_to_ground(spark, d):
    p = V.points(spark, d)
    tilted = D.levelled(p.select("pt_id", "x", "y", "z"), D.Levelling(TILT, [0.0, 0.0, 0.8]))
    flat = D.levelled(tilted, D.levelling(tilted))
    return flat.agg(F.count(F.lit(1)).alias("n"), F.round(F.min("z"), 1).alias("low"), F.round(F.max("z"), 1).alias("high"))


@query()
def same_split_continues(spark, d):
    b = V.boxes(spark, d).withColumn("split_seed", F.when(F.col("box_id") % 4 > 0, F.floor(F.col("box_id") / 10)))
    both = [L.row_continues(b, s, same="split_seed").withColumn("side", F.lit(s)) for s in (1, -1)]
    return both[0].union(both[1])


@query(given(POINTS, BOX, near("0e0"), sql_inside(), "fl AS (SELECT box_id, median(0.1e0*CAST(floor(x) AS BIGINT)) floor FROM ins GROUP BY 1)") + f"SELECT i.box_id, {rs('max(floor)')} floor, count(*) FILTER (z>=floor+greatest(0.3e0, 0.35e0*2e0) AND z<=greatest(floor+greatest(0.3e0, 0.35e0*2e0)+0.1e0, floor+0.75e0*2e0)) n_core FROM ins i JOIN fl ON fl.box_id=i.box_id GROUP BY 1")
def region_floor_and_slice(spark, d):
    def by_floor(b, p):
        at, n = np.unique(np.floor(p.x[within(b, p)]), return_counts=True)
        return at, n

    def in_core(b, p):
        z, low = p.z[within(b, p)], b.more["floor"] + max(0.30, 0.35 * 2.0)
        return (np.array([np.count_nonzero((z >= low) & (z <= max(low + 0.10, b.more["floor"] + 0.75 * 2.0)))]),)

    def slices(shapes):
        counts = spatial.near_points(V.points(spark, d), shapes, tally=by_floor, ddl="i double, n bigint").groupBy("box_id", "i").agg(F.sum("n").alias("n"))
        floors = counts.groupBy("box_id").agg(F.percentile(F.expr("0.1e0*CAST(i AS BIGINT)"), F.lit(0.5), F.col("n")).alias("floor"))
        asked = checkpointed(shapes.join(floors, "box_id"))
        cores = spatial.near_points(V.points(spark, d), asked, tally=in_core, ddl="n bigint", more=("floor",)).groupBy("box_id").agg(F.sum("n").alias("n_core"))
        return asked.select("box_id", "floor").join(cores, "box_id")

    return by_shape(V.boxes(spark, d), slices, "inner").select("box_id", r("floor").alias("floor"), "n_core")


@query()
def snap_box_faces(spark, d):
    return X.snapped_faces(V.points(spark, d), V.boxes(spark, d)).select("box_id", "moved", *(r(c).alias(c) for c in ("cx", "cy", "sw")))
