"""Queries of cameras, rectangles of views and exports, with their plain SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import views as V
from ..functions import geometry as G
from ..operators import estimators as E
from ..operators import framing as R
from ..sources import exports as X
from .cloud_queries import r, rs
from .sql_views import BOX, POINTS, RECTS, given
from .view_queries import CAM, CORNERS, FRAME

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_FOOT = "ft AS (SELECT min(x0) a0, min(y0) b0, max(x1) a1, max(y1) b1 FROM fr), tp AS (SELECT max(cz+sh/2e0) z_top FROM v_boxes), pz AS (SELECT min(z) low, max(z) high FROM v_points), fp AS (SELECT a0-0.03e0*sqrt((a1-a0)*(a1-a0)+(b1-b0)*(b1-b0))/2e0 x0, b0-0.03e0*sqrt((a1-a0)*(a1-a0)+(b1-b0)*(b1-b0))/2e0 y0, a1+0.03e0*sqrt((a1-a0)*(a1-a0)+(b1-b0)*(b1-b0))/2e0 x1, b1+0.03e0*sqrt((a1-a0)*(a1-a0)+(b1-b0)*(b1-b0))/2e0 y1, z_top, low, high FROM ft, tp, pz)"
FOOT = given(POINTS, BOX, CORNERS, FRAME, _FOOT)


@query(FOOT + f"SELECT {', '.join(f'{rs(c)} {c}' for c in ('x0', 'y0', 'x1', 'y1', 'z_top', 'low', 'high'))} FROM fp")
def view_footprint(spark, d):
    f = R.footprint(V.points(spark, d), V.boxes(spark, d))
    return f.select(*(r(c).alias(c) for c in f.columns))


_T = repr(math.tan(math.radians(30)))


@query(FOOT + f"SELECT {rs('(x0+x1)/2e0')} ex, {rs('(y0+y1)/2e0')} ey, {rs(f'greatest(0e0, (greatest((x1-x0)/2e0/({_T}*1.25e0), (y1-y0)/2e0/{_T})+greatest(z_top, high))*1.05e0)')} ez FROM fp")
def godview_nadir(spark, d):
    c = R.nadir_camera(R.footprint(V.points(spark, d), V.boxes(spark, d)))
    return c.select(*(r(x).alias(x) for x in ("ex", "ey", "ez")))


def project_sql(px: str, py: str, pz: str, focal: str, width: int, height: int) -> tuple[str, str, str]:
    """SQL of (pixel x, pixel y, depth) for an eye ex, ey, ez and a target tx, ty, tz."""
    n = "sqrt((tx-ex)*(tx-ex)+(ty-ey)*(ty-ey)+(tz-ez)*(tz-ez))"
    h = "sqrt((tx-ex)*(tx-ex)+(ty-ey)*(ty-ey))"
    depth = f"((({px})-ex)*(tx-ex)+(({py})-ey)*(ty-ey)+(({pz})-ez)*(tz-ez))/{n}"
    right = f"((({px})-ex)*(ty-ey)-(({py})-ey)*(tx-ex))/{h}"
    # forward x right points down
    down = f"(((({px})-ex)*(tx-ex)+(({py})-ey)*(ty-ey))*(tz-ez)/{h}-(({pz})-ez)*{h})/{n}"
    return f"({right})/greatest({depth},1e-6)*{focal}+{width / 2}", f"({down})/greatest({depth},1e-6)*{focal}+{height / 2}", depth


def framed_sql(points: list[tuple[str, str, str]], focal: str, width: int, height: int, margin: float) -> str:
    out = []
    for p in points:
        x, y, z = project_sql(*p, focal, width, height)
        out.append(f"{z}>0.1e0 AND {x}>{margin * width} AND {x}<{(1 - margin) * width} AND {y}>{margin * height} AND {y}<{(1 - margin) * height}")
    return " AND ".join(out)


_WAY = [math.cos(math.radians(55)) * math.cos(math.radians(45)), math.cos(math.radians(55)) * math.sin(math.radians(45)), math.sin(math.radians(55))]
_LADDER = "(VALUES " + ",".join(f"({k},{f}e0)" for k, f in enumerate(R.OBLIQUE)) + ") l(step, f)"


@query(FOOT + f", cm AS (SELECT fp.*, step, (x0+x1)/2e0 tx, (y0+y1)/2e0 ty, low tz, (sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))/2e0+1e0)*f dd FROM fp, {_LADDER}), ca AS (SELECT *, tx+dd*{_WAY[0]!r} ex, ty+dd*{_WAY[1]!r} ey, dd*{_WAY[2]!r} ez FROM cm), ok AS (SELECT *, "
       + framed_sql([(x, y, z) for x in ("x0", "x1") for y in ("y0", "y1") for z in ("low", "z_top")], repr(512 / math.tan(math.radians(30))), 1280, 1024, 0.03)
       + f" framed FROM ca) SELECT step, framed, {rs('ex')} ex, {rs('ey')} ey, {rs('ez')} ez FROM ok ORDER BY framed DESC, step LIMIT 1")
def godview_oblique(spark, d):
    c = R.oblique_camera(R.footprint(V.points(spark, d), V.boxes(spark, d)))
    return c.select("step", "framed", *(r(x).alias(x) for x in ("ex", "ey", "ez")))


_LENS = ",".join([*(f"({k},{f}e0,1e0,true)" for k, f in enumerate(R.LENSES)), *(f"({k},60e0,{f}e0,false)" for k, f in enumerate(R.BACK, len(R.LENSES)))])
_PX, _PY, _PD = project_sql("cn.x", "cn.y", "ca.cz+s.s*ca.sh/2e0", "(384e0/tan(radians(fovy)/2e0))", 768, 768)


@query(given(
    BOX, CORNERS,
    "hz AS (SELECT *, cos(yaw+pi()/2e0) hx, sin(yaw+pi()/2e0) hy FROM v_boxes)",
    "sp AS (SELECT hz.box_id, max(hz.hx*cn.y-hz.hy*cn.x)-min(hz.hx*cn.y-hz.hy*cn.x) span, max((cn.x-hz.cx)*hz.hx+(cn.y-hz.cy)*hz.hy) bulge FROM hz JOIN cn ON cn.box_id=hz.box_id GROUP BY hz.box_id)",
    f"cm AS (SELECT hz.*, step, fovy, CASE WHEN lens THEN 1e0+bulge ELSE greatest(1e0+bulge, greatest(sh/2e0/{_T}, (span+1.2e0)/2e0/{_T}))*f END dd FROM hz JOIN sp ON sp.box_id=hz.box_id, (VALUES {_LENS}) l(step, fovy, f, lens))",
    "ca AS (SELECT *, cx+hx*dd ex, cy+hy*dd ey, cz+dd*tan(radians(18e0)) ez, cx tx, cy ty, cz tz FROM cm)",
    f"ok AS (SELECT ca.box_id, ca.step, bool_and({_PD}>0.1e0 AND {_PX} BETWEEN 15.36e0 AND 752.64e0 AND {_PY} BETWEEN 15.36e0 AND 752.64e0) framed FROM ca JOIN cn ON cn.box_id=ca.box_id, (VALUES (-1e0),(1e0)) s(s) GROUP BY 1,2)",
    "pk AS (SELECT box_id, step, framed, row_number() OVER (PARTITION BY box_id ORDER BY framed DESC, CASE WHEN framed THEN step ELSE -step END) rn FROM ok)",
) + f"SELECT pk.box_id, pk.step, fovy, framed, {rs('ex')} ex, {rs('ey')} ey, {rs('ez')} ez FROM pk JOIN ca ON ca.box_id=pk.box_id AND ca.step=pk.step WHERE rn=1")
def local_cameras(spark, d):
    c = R.local_cameras(V.boxes(spark, d), standoff=1.0)
    return c.select("box_id", "step", "fovy", "framed", *(r(x).alias(x) for x in ("ex", "ey", "ez")))


@query("SELECT * FROM (VALUES (0, {0}, 0e0, 0e0, 0e0), (1, 0e0, {1}, 0e0, 0e0), (2, 0e0, 0e0, {2}, 1e0), (3, 0e0, 0e0, {3}, 0e0)) t(i, a, b, c, d)".format(*(f"round({x},9)" for x in ("1e0/(tan(radians(30e0))*1.25e0)", "1e0/tan(radians(30e0))", "100e0/(100e0-0.01e0)", "-0.01e0*100e0/(100e0-0.01e0)"))))
def perspective_matrix(spark, d):
    rows = R.perspective(0.01, 100.0, 60.0, 1280, 1024)
    return spark.createDataFrame([(i, *(round(v, 9) for v in row)) for i, row in enumerate(rows)], "i int, a double, b double, c double, d double")


@query("SELECT event_id, " + ", ".join(rs(f"CAST(event_id%{m} AS DOUBLE)/1000e0*{n}") + f" {c}" for m, n, c in ((1000, 1279, "px0"), (900, 1023, "py0"), (800, 1279, "px1"), (700, 1023, "py1"))) + " FROM events")
def box_group_pixels(spark, d):
    e = V.table(spark, d, "events").selectExpr("event_id", "array(CAST(event_id%1000 AS DOUBLE), CAST(event_id%900 AS DOUBLE), CAST(event_id%800 AS DOUBLE), CAST(event_id%700 AS DOUBLE)) box")
    return e.select("event_id", *(r(v).alias(c) for c, v in zip(("px0", "py0", "px1", "py1"), R.pixel_box(F.col("box"), 1280, 1024))))


def plane_sql(z: str) -> list[str]:
    f = repr(CAM.focal)
    (ra, _), (da, _), (fa, _) = CAM.axes()

    def at(px: str, py: str) -> tuple[str, str]:
        w = [f"((({px})-640e0)/{f}*({ra[i]!r})+(({py})-512e0)/{f}*({da[i]!r})+({fa[i]!r}))" for i in range(3)]
        t = f"(({z})-({CAM.eye[2]!r}))/(CASE WHEN abs({w[2]})<1e-9 THEN 1e-9 ELSE {w[2]} END)"
        return f"({CAM.eye[0]!r}+{t}*{w[0]})", f"({CAM.eye[1]!r}+{t}*{w[1]})"

    pts = [at(x, y) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))]
    u = [f"({x}*cos(0.2e0)+{y}*sin(0.2e0))" for x, y in pts]
    v = [f"({y}*cos(0.2e0)-{x}*sin(0.2e0))" for x, y in pts]
    return [f"least({', '.join(u)})", f"least({', '.join(v)})", f"greatest({', '.join(u)})", f"greatest({', '.join(v)})"]


LOW_RECTS = RECTS.replace("value*2e0 x0, CAST(event_id%37 AS DOUBLE)*20e0 y0", "value*2e0 x0, 300e0+CAST(event_id%37 AS DOUBLE)*18e0 y0").replace("CAST(event_id%37 AS DOUBLE)*20e0+22e0 y1", "322e0+CAST(event_id%37 AS DOUBLE)*18e0 y1")


def low_rects(spark, d):
    return V.rects(spark, d).withColumns({"y0": F.expr("300e0+CAST(rect_id%37 AS DOUBLE)*18e0"), "y1": F.expr("322e0+CAST(rect_id%37 AS DOUBLE)*18e0")})


@query(given(LOW_RECTS) + "SELECT view_id, rect_id, " + ", ".join(f"{rs(v)} {c}" for c, v in zip(("u0", "v0", "u1", "v1"), plane_sql("0.3e0"))) + " FROM v_rects")
def view_rect_on_plane(spark, d):
    rect = R.plane_rect(CAM, F.lit(0.3), 0.2)
    return low_rects(spark, d).select("view_id", "rect_id", *(r(v).alias(c) for c, v in zip(("u0", "v0", "u1", "v1"), rect)))


@query(given(LOW_RECTS) + "SELECT view_id, rect_id, " + ", ".join(f"{rs(f'{f}({a}, {b})+{k}')} {c}" for c, f, a, b, k in zip(("u0", "v0", "u1", "v1"), ("greatest", "greatest", "least", "least"), plane_sql("0.3e0"), plane_sql("1e0"), ("0.5e0", "0.25e0", "0.5e0", "0.25e0"))) + " FROM v_rects")
def tilt_rects(spark, d):
    both = R.common_part(R.plane_rect(CAM, F.lit(0.3), 0.2), R.plane_rect(CAM, F.lit(1.0), 0.2))
    return low_rects(spark, d).select("view_id", "rect_id", *(r(v).alias(c) for c, v in zip(("u0", "v0", "u1", "v1"), R.shifted(both, 0.5, 0.25))))


@query("SELECT event_id, event_id%3=1 OR event_id%3=2 tilt FROM events")
def tilt_view_names(spark, d):
    e = V.table(spark, d, "events").selectExpr("event_id", "concat('tile_', CAST(event_id AS STRING), CASE event_id%3 WHEN 0 THEN '.png' WHEN 1 THEN '_L.png' ELSE '_R.png' END) name")
    return e.select("event_id", R.is_tilt_view("name").alias("tilt"))


@query(given(BOX) + "SELECT box_id, cx+1e0 cx, sl, sh*2e0 sh, device_type, confidence FROM v_boxes")
def rebuilt_boxes(spark, d):
    b = V.boxes(spark, d)
    return R.with_geometry(b, (F.col("cx") + 1.0, F.col("cy"), F.col("cz")), (F.col("sl"), F.col("sw"), F.col("sh") * 2.0)).select("box_id", "cx", "sl", "sh", "device_type", "confidence")


_N = lambda c: f"greatest(CAST(floor({c}/0.05e0+1e-9) AS BIGINT),2)"


@query(given(BOX) + f"SELECT box_id, 2*{_N('sl')}*{_N('sw')}+2*{_N('sl')}*{_N('sh')}+2*{_N('sw')}*{_N('sh')} n, {rs('cz-sh/2e0')} low, {rs('cz+sh/2e0')} high, {rs('cx')} mid FROM v_boxes")
def face_points(spark, d):
    p = X.face_points(V.boxes(spark, d))
    return p.groupBy("box_id").agg(F.count(F.lit(1)).alias("n"), r(F.min("z")).alias("low"), r(F.max("z")).alias("high"), r(F.avg("x")).alias("mid"))


@query()
def export_cloud(spark, d):
    rows = X.export_rows(V.points(spark, d), V.boxes(spark, d), V.predicted_boxes(spark, d), edge_step=0.05)
    return rows.groupBy("green", "blue").agg(F.count(F.lit(1)).alias("n")).where("n > 0").groupBy((F.col("green") == 0.4).alias("truth")).agg(F.sum("n").alias("n"))


@query("SELECT page_id, 0 k, sha256(html) digest, false whole FROM pages WHERE html IS NOT NULL AND strlen(html)>0")
def report_pictures(spark, d):
    pages = V.table(spark, d, "pages").where("length(html) > 0").selectExpr("page_id", "concat('<img src=\"data:image/png;base64,', replace(base64(cast(html AS BINARY)), '\\r\\n', ''), '\">') html")
    p = X.report_pictures(pages)
    return p.select("page_id", "k", F.sha2("content", 256).alias("digest"), X.is_whole_png(F.col("content")).alias("whole"))


@query(given(POINTS) + "SELECT count(*) FILTER (h>0.3e0 AND h<=1.4e0) cut_pool, count(*) FILTER (h>0.3e0 AND h<=1e0) fit_pool FROM (SELECT z-0.1e0 h FROM v_points)")
def render_cut_pool(spark, d):
    h = F.col("z") - 0.1
    return V.points(spark, d).agg(F.count(F.when((h > 0.3) & (h <= 1.4), 1)).alias("cut_pool"), F.count(F.when((h > 0.3) & (h <= 1.0), 1)).alias("fit_pool"))


@query(given(POINTS, "ba AS (SELECT quantile_cont(z, 0.02) b FROM v_points)", "tl AS (SELECT CAST(floor(x/1.5e0) AS BIGINT) i, CAST(floor(y/1.5e0) AS BIGINT) j, count(*) FILTER (z<=b+1e0) n, quantile_cont(z, 0.02) FILTER (z<=b+1e0) q, max(b) b FROM v_points, ba GROUP BY 1,2)")
       + f"SELECT pt_id, {rs('CASE WHEN n>=30 THEN q ELSE b END')} floor_z FROM (SELECT pt_id, (x*cos(-0.3e0)-y*sin(-0.3e0))*cos(0.3e0)-(x*sin(-0.3e0)+y*cos(-0.3e0))*sin(0.3e0) wx, (x*cos(-0.3e0)-y*sin(-0.3e0))*sin(0.3e0)+(x*sin(-0.3e0)+y*cos(-0.3e0))*cos(0.3e0) wy FROM v_points) p JOIN tl ON tl.i=CAST(floor(wx/1.5e0) AS BIGINT) AND tl.j=CAST(floor(wy/1.5e0) AS BIGINT)")
def floor_at_row_frame(spark, d):
    p = V.points(spark, d)
    x, y = G.rotate("x", "y", -0.3)
    turned = p.select("pt_id", x.alias("x"), y.alias("y"))
    return E.floor_at_local(turned, E.floor_tiles(p), 0.3).where("floor_z is not null").select("pt_id", r("floor_z").alias("floor_z"))
