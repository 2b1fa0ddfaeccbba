"""Queries over boxes, rectangles, cameras, images and replies, with their plain SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import views as V
from ..functions import geometry as G
from ..functions import text as T
from ..operators import rects as R
from .cloud_queries import r, rs
from .sql_views import BOX, PIXELS, POINTS, RECTS, given

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Boxes and frames


def corner_sql(i: int, j: int) -> str:
    return f"SELECT box_id, {(0 if (i, j) == (-1, -1) else 1 if (i, j) == (1, -1) else 2 if (i, j) == (1, 1) else 3)} n, cx+({i})*sl/2e0*cos(yaw)-({j})*sw/2e0*sin(yaw) x, cy+({i})*sl/2e0*sin(yaw)+({j})*sw/2e0*cos(yaw) y FROM v_boxes"


CORNERS = "cn AS (" + " UNION ALL ".join(corner_sql(*s) for s in G.SIGNS) + ")"
FRAME = "fr AS (SELECT box_id, min(x) x0, min(y) y0, max(x) x1, max(y) y1 FROM cn GROUP BY box_id)"


@query(given(BOX, CORNERS) + f"SELECT box_id, CAST(n AS INT) n, {rs('x')} x, {rs('y')} y FROM cn")
def box_corners_2d(spark, d):
    xy = F.array(*(F.struct(r(x).alias("x"), r(y).alias("y")) for x, y in G.corners()))
    return V.boxes(spark, d).select("box_id", F.posexplode(xy).alias("n", "p")).select("box_id", "n", "p.x", "p.y")


@query(given(BOX, CORNERS) + f"SELECT box_id, CAST(2*n+t AS INT) n, {rs('x')} x, {rs('y')} y, {rs('cz+(2*t-1)*sh/2e0')} z FROM cn JOIN v_boxes USING (box_id), (VALUES (0),(1)) s(t)")
def box_corners_3d(spark, d):
    xyz = F.array(*(F.struct(F.lit(2 * n + t).alias("n"), r(x).alias("x"), r(y).alias("y"), r(F.col("cz") + (2 * t - 1) * F.col("sh") / 2).alias("z")) for n, (x, y) in enumerate(G.corners()) for t in (0, 1)))
    return V.boxes(spark, d).select("box_id", F.explode(xyz).alias("p")).select("box_id", "p.*")


@query(given(BOX, CORNERS, FRAME) + f"SELECT box_id, {', '.join(f'{rs(c)} {c}' for c in ('x0', 'y0', 'x1', 'y1'))} FROM fr")
def box_frame_rect(spark, d):
    return V.boxes(spark, d).select("box_id", *(r(v).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), G.frame_rect())))


@query(given(BOX) + "SELECT box_id, " + ", ".join(f"{rs(e)} {n}" for n, e in (("x0", "cx-hx"), ("y0", "cy-hy"), ("x1", "cx+hx"), ("y1", "cy+hy"))) + " FROM (SELECT *, abs(cos(yaw))*(sl/2e0+0.5e0)+abs(sin(yaw))*(sw/2e0+0.5e0) hx, abs(sin(yaw))*(sl/2e0+0.5e0)+abs(cos(yaw))*(sw/2e0+0.5e0) hy FROM v_boxes)")
def region_of_box(spark, d):
    hx, hy = G.half_extents("sl", "sw", "yaw", 0.5)
    e = {"x0": F.col("cx") - hx, "y0": F.col("cy") - hy, "x1": F.col("cx") + hx, "y1": F.col("cy") + hy}
    return V.boxes(spark, d).select("box_id", *(r(v).alias(n) for n, v in e.items()))


@query(given(BOX, CORNERS) + f"SELECT {rs('min(x)-0.4e0')} x0, {rs('min(y)-0.4e0')} y0, {rs('max(x)+0.4e0')} x1, {rs('max(y)+0.4e0')} y1 FROM cn")
def layout_bounds(spark, d):
    f = V.boxes(spark, d).select(*(v.alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), G.frame_rect())))
    return f.agg(r(F.min("x0") - 0.4).alias("x0"), r(F.min("y0") - 0.4).alias("y0"), r(F.max("x1") + 0.4).alias("x1"), r(F.max("y1") + 0.4).alias("y1"))


@query(given(POINTS) + f"SELECT pt_id, z, {rs('x')} x, {rs('y')} y, {rs('(x-3e0)*cos(0.4e0)+(y-2e0)*sin(0.4e0)')} u, {rs('(y-2e0)*cos(0.4e0)-(x-3e0)*sin(0.4e0)')} v FROM v_points")
def local_round_trip(spark, d):
    frame = (F.lit(3.0), F.lit(2.0), F.lit(1.0), F.lit(0.4))
    u, v, k = G.to_local("x", "y", "z", *frame)
    p = V.points(spark, d).select("pt_id", "z", u.alias("u"), v.alias("v"), k.alias("k"))
    x, y, _ = G.to_world("u", "v", "k", *frame)
    return p.select("pt_id", "z", r(x).alias("x"), r(y).alias("y"), r("u").alias("u"), r("v").alias("v"))


TILT = [[math.cos(0.1), 0.0, math.sin(0.1)], [0.0, 1.0, 0.0], [-math.sin(0.1), 0.0, math.cos(0.1)]]
SHIFT = [0.2, -0.1, 0.8]


@query(given(POINTS) + f"SELECT pt_id, {rs('x')} x, {rs('y')} y, {rs('z')} z, {rs(f'x*{TILT[0][0]!r}+z*{TILT[0][2]!r}+0.2e0')} ax FROM v_points")
def align_round_trip(spark, d):
    a = dict(zip(("ax", "ay", "az"), G.align("x", "y", "z", TILT, SHIFT)))
    back = G.unalign("ax", "ay", "az", TILT, SHIFT)
    return V.points(spark, d).select("pt_id", *(v.alias(n) for n, v in a.items())).select("pt_id", *(r(v).alias(n) for n, v in zip("xyz", back)), r("ax").alias("ax"))


@query(given(POINTS) + f"SELECT pt_id, {rs('x*cos(0.7e0)-y*sin(0.7e0)')} x, {rs('x*sin(0.7e0)+y*cos(0.7e0)')} y, z FROM v_points")
def rotate_xy(spark, d):
    x, y = G.rotate("x", "y", 0.7)
    return V.points(spark, d).select("pt_id", r(x).alias("x"), r(y).alias("y"), "z")


MOD = "(({0})%(pi()/2)+pi()/2)%(pi()/2)"


@query(given(BOX) + f"SELECT box_id, {rs('least(m, pi()/2-m)')} dist, {rs('f')} folded, {rs('yaw*7e0-round_even(yaw*7e0/(pi()/2),0)*(pi()/2)')} rest FROM (SELECT *, {MOD.format('abs(yaw*7e0-score)')} m, {MOD.format('yaw*7e0+pi()/4')}-pi()/4 f FROM v_boxes)")
def angle_rules(spark, d):
    wide = F.col("yaw") * 7
    return V.boxes(spark, d).select("box_id", r(G.angle_distance(wide, F.col("score"))).alias("dist"), r(G.fold_quarter(wide)).alias("folded"), r(G.remainder(wide, F.lit(math.pi / 2))).alias("rest"))


EDGES = [(0, 1), (1, 2), (2, 3), (3, 0)]


@query(given(BOX, CORNERS, "eg AS (SELECT a.box_id, a.n, a.x ax, a.y ay, b.x bx, b.y by_, greatest(CAST(floor(sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y))/0.1e0+1e-9) AS BIGINT),2) m FROM cn a JOIN cn b ON a.box_id=b.box_id AND b.n=(a.n+1)%4)", "st AS (SELECT *, unnest(range(0,m)) k FROM eg)") + f"SELECT box_id, CAST(n AS INT) edge, k, {rs('ax+(bx-ax)*k/(m-1e0)')} x, {rs('ay+(by_-ay)*k/(m-1e0)')} y FROM st")
def wireframe_points(spark, d):
    c = G.corners()
    edges = F.array(*(F.struct(F.lit(i).alias("edge"), c[i][0].alias("ax"), c[i][1].alias("ay"), c[j][0].alias("bx"), c[j][1].alias("by")) for i, j in EDGES))
    e = V.boxes(spark, d).select("box_id", F.explode(edges).alias("e")).select("box_id", "e.*")
    n = F.greatest(F.floor(F.sqrt((F.col("bx") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("by") - F.col("ay")) * (F.col("by") - F.col("ay"))) / 0.1 + 1e-9), F.lit(2).cast("bigint"))
    e = e.withColumn("m", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)))
    at = lambda a, b: r(F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / (F.col("m") - 1.0))
    return e.select("box_id", "edge", "k", at("ax", "bx").alias("x"), at("ay", "by").alias("y"))


@query(given(BOX, CORNERS, FRAME, "pr AS (SELECT a.box_id, b.box_id other, greatest(a.x0-b.x1, b.x0-a.x1, 0e0) gx, greatest(a.y0-b.y1, b.y0-a.y1, 0e0) gy FROM fr a JOIN fr b ON a.box_id<>b.box_id)") + f"SELECT box_id, other, {rs('sqrt(gx*gx+gy*gy)')} gap FROM pr WHERE gx<=0.5e0 AND gy<=0.5e0")
def aabb_gap_xy(spark, d):
    from ..operators.spatial import box_pairs, by_pair, shapes

    one = shapes(V.boxes(spark, d))
    p = box_pairs(one, one, 0.5)  # a shape beside itself too
    a, b = G.frame_rect(), G.frame_rect(cx="cx_b", cy="cy_b", length="sl_b", width="sw_b", yaw="yaw_b")
    gx, gy = F.greatest(a[0] - b[2], b[0] - a[2], F.lit(0.0)), F.greatest(a[1] - b[3], b[1] - a[3], F.lit(0.0))
    p = p.where((gx <= 0.5) & (gy <= 0.5)).select("box_id", F.col("box_id_b").alias("other"), r(G.aabb_gap(a, b)).alias("gap"))
    return by_pair(p, V.boxes(spark, d), V.boxes(spark, d)).where("box_id <> other").select("box_id", "other", "gap")


def sat_sql() -> str:
    axes = [("a.yaw", 0), ("a.yaw", 1), ("b.yaw", 0), ("b.yaw", 1)]
    dot = lambda t, yaw, q: (f"({t}.x*cos({yaw})+{t}.y*sin({yaw}))" if not q else f"({t}.y*cos({yaw})-{t}.x*sin({yaw}))")
    cols = []
    for n, (yaw, q) in enumerate(axes):
        cols.append(f"greatest(min({dot('ca', yaw, q)})-max({dot('cb', yaw, q)}), min({dot('cb', yaw, q)})-max({dot('ca', yaw, q)}))")
    return f"greatest({', '.join(cols)})"


@query(given(BOX, CORNERS) + f"SELECT a.box_id, b.box_id other, {rs(sat_sql())} gap FROM v_boxes a JOIN v_boxes b ON a.box_id<>b.box_id AND abs(a.cx-b.cx)<=1e0 AND abs(a.cy-b.cy)<=1e0 JOIN cn ca ON ca.box_id=a.box_id JOIN cn cb ON cb.box_id=b.box_id GROUP BY a.box_id, b.box_id, a.yaw, b.yaw")
def obb_sat_gap(spark, d):
    from ..operators.spatial import box_pairs

    p = box_pairs(V.boxes(spark, d), V.boxes(spark, d), 1.0).where("box_id <> box_id_b and abs(cx - cx_b) <= 1 and abs(cy - cy_b) <= 1")
    gap = G.sat_gap(G.corners(), "yaw", G.corners("cx_b", "cy_b", "sl_b", "sw_b", "yaw_b"), "yaw_b")
    return p.select("box_id", F.col("box_id_b").alias("other"), r(gap).alias("gap"))


@query(given(BOX) + "SELECT box_id, CASE WHEN least(sl,sw)>2.5e0 THEN true ELSE false END oversized, device_type IN ('rack','ac','ups','unknown') known, box_id=3 removed FROM v_boxes")
def box_predicates(spark, d):
    b = V.boxes(spark, d)
    return b.select("box_id", (F.least("sl", "sw") > 2.5).alias("oversized"), F.col("device_type").isin("rack", "ac", "ups", "unknown").alias("known"), (F.col("box_id") == 3).alias("removed"))


# Cameras

CAM = G.Camera(eye=(5.0, -4.0, 6.0), target=(5.0, 5.0, 1.0), fovy_deg=60.0, width=1280, height=1024)
_AX = CAM.axes()
_DOT = lambda i: f"(x*{_AX[i][0][0]!r}+y*{_AX[i][0][1]!r}+z*{_AX[i][0][2]!r}+({_AX[i][1]!r}))"
PROJ = f"pj AS (SELECT *, {_DOT(0)} c0, {_DOT(1)} c1, {_DOT(2)} c2 FROM v_points), pp AS (SELECT *, c0/greatest(c2,1e-6)*{CAM.focal!r}+640e0 px, c1/greatest(c2,1e-6)*{CAM.focal!r}+512e0 py FROM pj)"


@query(given(POINTS, PROJ) + f"SELECT pt_id, {rs('px', 4)} px, {rs('py', 4)} py, {rs('c2')} depth FROM pp")
def camera_project(spark, d):
    px, py, depth = CAM.project("x", "y", "z")
    return V.points(spark, d).select("pt_id", r(px, 4).alias("px"), r(py, 4).alias("py"), r(depth).alias("depth"))


@query(given(POINTS) + f"SELECT pt_id, {rs('x')} x, {rs('y')} y FROM v_points")
def unproject_ground(spark, d):
    px, py, _ = CAM.project("x", "y", "z")
    p = V.points(spark, d).select("pt_id", "z", px.alias("px"), py.alias("py"))
    x, y = CAM.to_plane("px", "py", "z")
    return p.select("pt_id", r(x).alias("x"), r(y).alias("y"))


SMALL = G.Camera(eye=(0.0, 3.0, 1.0), target=(0.0, 0.0, 1.0), fovy_deg=60.0, width=8, height=8)
_SA = SMALL.axes()


def _ray_sql(i: int) -> str:
    return f"((px+0.5e0-4e0)/{SMALL.focal!r}*({_SA[0][0][i]!r})+(py+0.5e0-4e0)/{SMALL.focal!r}*({_SA[1][0][i]!r})+({_SA[2][0][i]!r}))"


@query(given(PIXELS) + f"SELECT view_id, px, py, {', '.join(f'{rs(f'({SMALL.eye[i]!r})+depth*{_ray_sql(i)}')} {c}' for i, c in enumerate('xyz'))} FROM v_pixels WHERE mask AND depth>0.05e0 AND alpha>=0.8e0")
def unproject_depth_mask(spark, d):
    p = V.pixels(spark, d).where("mask and depth > 0.05 and alpha >= 0.8")
    xyz = SMALL.at_depth(F.col("px") + 0.5, F.col("py") + 0.5, "depth")
    return p.select("view_id", "px", "py", *(r(v).alias(c) for c, v in zip("xyz", xyz)))


@query(given(POINTS, PROJ) + f"SELECT CAST(floor(px) AS BIGINT) px, CAST(floor(py) AS BIGINT) py, {rs('min(c2)')} zbuf, count(*) n FROM pp WHERE c2>0.05e0 AND px>=0 AND px<1280 AND py>=0 AND py<1024 GROUP BY 1,2")
def depth_buffer(spark, d):
    px, py, depth = CAM.project("x", "y", "z")
    p = V.points(spark, d).select(px.alias("fx"), py.alias("fy"), depth.alias("depth")).where("depth > 0.05 and fx >= 0 and fx < 1280 and fy >= 0 and fy < 1024")
    p = p.select(F.floor("fx").alias("px"), F.floor("fy").alias("py"), "depth")
    return p.groupBy("px", "py").agg(r(F.min("depth")).alias("zbuf"), F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(l_orderkey*10+l_linenumber AS BIGINT) pt_id, " + ", ".join([rs("exp(l_tax*10e0-4e0)") + " scale", rs("1e0/(1e0+exp(-(l_discount*60e0-2e0)))") + " opacity", rs("(1e0+l_tax)/sqrt((1e0+l_tax)*(1e0+l_tax)+l_discount*l_discount+l_tax*l_tax*4e0+0.25e0)") + " qw", rs("greatest(0e0, least(1e0, 0.5e0+0.28209479177387814e0*(l_quantity/25e0-1e0)))") + " red"]) + " FROM lineitem")
def gaussian_decode(spark, d):
    from ..sources.ply import decoded

    g = decoded(V.gaussians(spark, d))
    return g.select("pt_id", r("scale").alias("scale"), r("opacity").alias("opacity"), r("qw_n").alias("qw"), r("red").alias("red"))


# Rectangles


@query(given(RECTS) + "SELECT view_id, rect_id, (x1-x0)*(y1-y0)>0.8e0*1280e0*1024e0 huge, (x1-x0)*(y1-y0)>0.0008e0*1280e0*1024e0 large FROM v_rects")
def huge_rect(spark, d):
    return V.rects(spark, d).select("view_id", "rect_id", R.huge(1280, 1024).alias("huge"), R.huge(1280, 1024, 0.0008).alias("large"))


RECT_PAIRS = "rp AS (SELECT a.view_id, a.rect_id, b.rect_id other, greatest(least(a.x1,b.x1)-greatest(a.x0,b.x0),0e0)*greatest(least(a.y1,b.y1)-greatest(a.y0,b.y0),0e0) i, (a.x1-a.x0)*(a.y1-a.y0) sa, (b.x1-b.x0)*(b.y1-b.y0) sb FROM v_rects a JOIN v_rects b ON a.view_id=b.view_id AND a.rect_id<>b.rect_id)"


@query(given(RECTS, RECT_PAIRS) + "SELECT view_id, rect_id, other FROM rp WHERE i>0 AND (i/sa>=0.6e0 OR i/sb>=0.75e0 OR i/(sa+sb-i)>=0.1e0)")
def rect_covered(spark, d):
    return R.covered(V.rects(spark, d)).select("view_id", "rect_id", F.col("rect_id_b").alias("other"))


@query(given(RECTS, RECT_PAIRS) + "SELECT view_id, rect_id, other FROM rp WHERE i>0 AND i/sb>=0.75e0")
def rect_inside(spark, d):
    return R.nested(V.rects(spark, d)).select("view_id", "rect_id", F.col("rect_id_b").alias("other"))


@query(given(RECTS, "ov AS (SELECT a.*, b.x0 bx0, b.y0 by0, b.x1 bx1, b.y1 by1 FROM v_rects a JOIN v_rects b ON a.view_id=b.view_id AND a.rect_id<>b.rect_id AND a.x0<=b.x1 AND b.x0<=a.x1 AND a.y0<=b.y1 AND b.y0<=a.y1)", "hi AS (SELECT view_id, rect_id, count(DISTINCT s) n FROM ov, range(0,400) t(s) WHERE x0+(x1-x0)*(s%20+0.5e0)/20 BETWEEN bx0 AND bx1 AND y0+(y1-y0)*(floor(s/20e0)+0.5e0)/20 BETWEEN by0 AND by1 GROUP BY 1,2)") + "SELECT view_id, rect_id, coalesce(n,0)/400e0 AS share FROM v_rects LEFT JOIN hi USING (view_id, rect_id)")
def rect_covered_share(spark, d):
    return R.covered_share(V.rects(spark, d))


def links_sql(axis: str) -> str:
    lo, hi, clo, chi = ("x0", "x1", "y0", "y1") if axis == "x" else ("y0", "y1", "x0", "x1")
    sa, sb, ca, cb = f"(a.{hi}-a.{lo})", f"(b.{hi}-b.{lo})", f"(a.{chi}-a.{clo})", f"(b.{chi}-b.{clo})"
    gap = f"(greatest(a.{lo},b.{lo})-least(a.{hi},b.{hi}))"
    return f"SELECT a.view_id, a.rect_id a, b.rect_id b FROM v_rects a JOIN v_rects b ON a.view_id=b.view_id AND a.rect_id<b.rect_id WHERE abs({ca}-{cb})<=0.2e0*least({ca},{cb}) AND least(a.{chi},b.{chi})-greatest(a.{clo},b.{clo})>=0.55e0*least({ca},{cb}) AND abs({sa}-{sb})<=0.6e0*greatest({sa},{sb}) AND {gap}>=-0.35e0*least({sa},{sb}) AND {gap}<=0.25e0*least({sa},{sb})"


@query(given(RECTS) + links_sql("x"))
def chain_links_x(spark, d):
    return R.chain_links(V.rects(spark, d), "x")


@query(given(RECTS) + links_sql("y"))
def chain_links_y(spark, d):
    return R.chain_links(V.rects(spark, d), "y")


def members_sql(axis: str) -> str:
    return f"lk_{axis} AS ({links_sql(axis)}), bo_{axis} AS (SELECT view_id, a n, b m FROM lk_{axis} UNION ALL SELECT view_id, b, a FROM lk_{axis}), re_{axis}(view_id, n, m) AS (SELECT view_id, n, n FROM bo_{axis} UNION SELECT r.view_id, r.n, b.m FROM re_{axis} r JOIN bo_{axis} b ON b.view_id=r.view_id AND b.n=r.m), ch_{axis} AS (SELECT view_id, n rect_id, min(m) chain FROM re_{axis} GROUP BY 1,2), me_{axis} AS (SELECT *, count(*) OVER (PARTITION BY view_id, chain) members FROM ch_{axis} QUALIFY count(*) OVER (PARTITION BY view_id, chain)>=3)"


@query("WITH RECURSIVE " + RECTS + ", " + members_sql("x") + " SELECT view_id, rect_id, chain, members FROM me_x")
def chain_members_x(spark, d):
    return R.chain_members(V.rects(spark, d), "x")


@query()
def chain_scores_x(spark, d):
    rects = V.rects(spark, d)
    x, y = R.chain_members(rects, "x"), R.chain_members(rects, "y")
    return R.chain_scores(rects, x, "x", y, 1280.0, 1024.0)


@query()
def hallucination_filter(spark, d):
    return R.without_repeats(V.rects(spark, d)).select("view_id", "rect_id")


# Images

EDGE = "ed AS (SELECT *, lum-lag(lum) OVER (PARTITION BY view_id, py ORDER BY px) dx, lum-lag(lum) OVER (PARTITION BY view_id, px ORDER BY py) dy FROM v_pixels), en AS (SELECT view_id, avg(CASE WHEN lum>0.1e0 THEN 1e0 ELSE 0e0 END) coverage, avg(dx*dx)+avg(dy*dy) energy FROM ed GROUP BY view_id)"


@query(given(PIXELS, EDGE) + f"SELECT view_id, {rs('energy')} energy FROM en")
def edge_energy(spark, d):
    return R.edge_energy(V.pixels(spark, d)).select("view_id", r("energy").alias("energy"))


@query(given(PIXELS, EDGE) + f"SELECT view_id, {rs('coverage')} coverage, coverage>=0.02e0 AND energy>=1e-5 good FROM en")
def view_quality(spark, d):
    return R.view_quality(V.pixels(spark, d)).select("view_id", r("coverage").alias("coverage"), "good")


@query(given(PIXELS, "mf AS (SELECT view_id, count(*) FILTER (i AND mask) inside, count(*) FILTER (NOT i AND mask) outside, count(*) FILTER (i) area FROM (SELECT *, px>=2 AND px<6 AND py>=2 AND py<6 i FROM v_pixels) GROUP BY view_id)") + f"SELECT view_id, inside, outside, {rs('inside/area')} coverage, {rs('coalesce(outside/nullif(inside+outside,0),0e0)')} leakage, {rs('inside/(area+outside)')} fit FROM mf")
def mask_grounding_fit(spark, d):
    return R.mask_fit(V.pixels(spark, d), (2, 2, 6, 6)).withColumns({c: r(c) for c in ("coverage", "leakage", "fit")})


@query(given(PIXELS, "bs AS (SELECT *, CAST(floor(greatest(0e0, least(1e0, lum))*255e0) AS BIGINT) b FROM v_pixels)") + "SELECT view_id, px, py, CASE WHEN mask THEN CAST(floor(b*140/255e0) AS BIGINT)+115 ELSE b END AS value FROM bs")
def overlay_mask(spark, d):
    return R.blended(V.pixels(spark, d))


@query(given(PIXELS) + "SELECT px, py, bool_or(mask) mask FROM v_pixels GROUP BY 1,2")
def masks_union(spark, d):
    return R.masks_union(V.pixels(spark, d))


# Replies

_B = "concat('{\"bbox_2d\": [', CAST(event_id%700 AS VARCHAR), ', ', CAST(event_id%300 AS VARCHAR), ', ', CAST(event_id%700+150 AS VARCHAR), ', ', CAST(event_id%300+200 AS VARCHAR), '], \"label\": \"', event_type, '\"}')"
_TWO = f"concat('Here it is: [', {_B}, ', ', replace({_B}, '[', '[1'), ']')"
REPLIES = f"v_replies AS (SELECT event_id reply_id, CASE event_id%4 WHEN 0 THEN concat('```json' || chr(10) || '[', {_B}, ']' || chr(10) || '```' || chr(10) || 'quality: poor') WHEN 1 THEN substring({_TWO}, 1, 40 + CAST(event_id%90 AS INT)) WHEN 2 THEN {_TWO} ELSE concat('nothing here, quality: ', CASE WHEN event_id%8=3 THEN 'good' ELSE 'no' END) END AS text FROM events)"
_N = r"\s*(-?\d+(?:\.\d+)?)\s*"
_BOXRE = r'"?bbox[ _]*2d"?\s*:\s*\[' + ",".join([_N] * 4) + r"\]"
SALVAGE = "sv AS (SELECT reply_id, unnest(range(0, len(regexp_extract_all(text, '" + _BOXRE + "')))) k, " + ", ".join(f"unnest(regexp_extract_all(text, '{_BOXRE}', {i + 1})) b{i}" for i in range(4)) + " FROM v_replies), bx AS (SELECT reply_id, CAST(k AS INT) k, " + ", ".join(f"CAST(b{i} AS DOUBLE) a{i}" for i in range(4)) + " FROM sv)"


@query(given(REPLIES, SALVAGE) + "SELECT * FROM bx")
def salvage_boxes(spark, d):
    return T.salvaged_boxes(V.replies(spark, d))


@query(given(REPLIES, SALVAGE, "rl AS (SELECT *, greatest(a0,a1,a2,a3)>1000 p FROM bx)", "xy AS (SELECT reply_id, k, CASE WHEN p THEN a0 ELSE a0/1000e0*1280 END xa, CASE WHEN p THEN a2 ELSE a2/1000e0*1280 END xb, CASE WHEN p THEN a1 ELSE a1/1000e0*1024 END ya, CASE WHEN p THEN a3 ELSE a3/1000e0*1024 END yb FROM rl)", "cl AS (SELECT reply_id, k, greatest(0e0,least(1280e0,least(xa,xb))) x0, greatest(0e0,least(1024e0,least(ya,yb))) y0, greatest(0e0,least(1280e0,greatest(xa,xb))) x1, greatest(0e0,least(1024e0,greatest(ya,yb))) y1 FROM xy)") + f"SELECT reply_id, k, {', '.join(f'{rs(c)} {c}' for c in ('x0', 'y0', 'x1', 'y1'))} FROM cl WHERE x1-x0>=8 AND y1-y0>=8")
def parse_ground_regions(spark, d):
    out = T.pixel_rects(T.salvaged_boxes(V.replies(spark, d)), 1280, 1024)
    return out.withColumns({c: r(c) for c in ("x0", "y0", "x1", "y1")})


@query(given(REPLIES) + "SELECT reply_id, CASE WHEN list_extract(regexp_extract_all(lower(text), 'quality\\W{0,4}\\s*(good|poor|true|false|yes|no)\\b', 1), -1) IN ('poor','false','no') THEN 'poor' ELSE 'good' END quality FROM v_replies")
def reply_view_quality(spark, d):
    return V.replies(spark, d).select("reply_id", T.quality_word("text").alias("quality"))


@query("SELECT event_id, lower(coalesce(json_extract_string(j, '$.is_rack'),'')) IN ('true','yes','1') is_rack, greatest(0e0, least(1e0, coalesce(TRY_CAST(json_extract_string(j, '$.confidence') AS DOUBLE), 0.5e0))) confidence FROM (SELECT event_id, concat('{\"is_rack\": ', CASE event_id%3 WHEN 0 THEN 'true' WHEN 1 THEN '\"No\"' ELSE '\"yes\"' END, CASE WHEN event_id%2=0 THEN concat(', \"confidence\": ', CAST(event_id%14 AS VARCHAR), 'e-1') ELSE '' END, '}') j FROM events)")
def rack_confirm(spark, d):
    j = V.table(spark, d, "events").selectExpr("event_id", "concat('{\"is_rack\": ', CASE event_id%3 WHEN 0 THEN 'true' WHEN 1 THEN '\"No\"' ELSE '\"yes\"' END, CASE WHEN event_id%2=0 THEN concat(', \"confidence\": ', CAST(event_id%14 AS STRING), 'e-1') ELSE '' END, '}') j")
    flag, sure = T.rack_confirm("j")
    return j.select("event_id", flag.alias("is_rack"), sure.alias("confidence"))


@query("SELECT event_id, contains(lower(l),'door') door, contains(lower(l),'ladder') OR contains(lower(l),'cable tray') ladder, contains(lower(l),'door') OR contains(lower(l),'ladder') OR contains(lower(l),'cable tray') subtractive, " + " OR ".join(f"contains(lower(l),'{w}')" for w in T.C.EQUIPMENT_TOKENS) + " equipment FROM (SELECT event_id, CASE event_id%5 WHEN 0 THEN 'Server RACK' WHEN 1 THEN 'Door panel' WHEN 2 THEN 'cable tray' WHEN 3 THEN 'Ladder' ELSE event_type END l FROM events)")
def label_predicates(spark, d):
    e = V.table(spark, d, "events").selectExpr("event_id", "CASE event_id%5 WHEN 0 THEN 'Server RACK' WHEN 1 THEN 'Door panel' WHEN 2 THEN 'cable tray' WHEN 3 THEN 'Ladder' ELSE event_type END l")
    return e.select("event_id", T.is_door("l").alias("door"), T.is_ladder("l").alias("ladder"), T.is_subtractive("l").alias("subtractive"), T.is_equipment("l").alias("equipment"))


@query()
def extract_json(spark, d):
    return V.replies(spark, d).select("reply_id", T.json_column("text", "{").alias("object"), T.json_column("text", "[").alias("array"))


@query()
def parse_box_groups(spark, d):
    return V.replies(spark, d).select("reply_id", F.posexplode(T.box_groups_column("text")).alias("k", "g")).select("reply_id", "k", "g.box", "g.label")


@query()
def ground_replies(spark, d):
    out = T.grounded_rects(V.replies(spark, d), 1280, 1024)
    return out.select("reply_id", "k", "label", *(r(c).alias(c) for c in ("x0", "y0", "x1", "y1")))
