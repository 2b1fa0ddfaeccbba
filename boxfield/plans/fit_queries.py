"""Queries that fit and judge boxes, with their plain SQL where there is one."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import views as V
from ..operators import estimators as E
from ..operators import fitting as T
from ..operators import merging, profiles
from ..operators.spatial import inside
from . import synth
from .cloud_queries import r, rs
from .sql_views import BOX, POINTS, given, near

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def ground_rects(spark, d):
    b = V.boxes(spark, d)
    return b.selectExpr("box_id rect_id", "cx-0.6e0 x0", "cy-0.6e0 y0", "cx+0.6e0 x1", "cy+0.6e0 y1")


@query()
def fit_region_boxes(spark, d):
    found = T.fitted_boxes(V.points(spark, d), ground_rects(spark, d))
    return found.withColumns({c: r(c) for c in ("cx", "cy", "cz", "sl", "sw", "sh", "yaw")})


@query(given(POINTS, BOX) + f"SELECT box_id rect_id, count(*) n, {rs('avg(z)')} mean_z FROM v_boxes JOIN v_points ON x BETWEEN cx-0.6e0 AND cx+0.6e0 AND y BETWEEN cy-0.6e0 AND cy+0.6e0 GROUP BY 1")
def points_in_rects(spark, d):
    return T.points_in_rects(V.points(spark, d), ground_rects(spark, d)).groupBy("rect_id").agg(F.count(F.lit(1)).alias("n"), r(F.avg("z")).alias("mean_z"))


@query()
def cross_gap_split(spark, d):
    return profiles.gap_middles(inside(V.points(spark, d), V.boxes(spark, d)), ["box_id"], "v").withColumn("middle", r("middle"))


@query()
def row_band_score(spark, d):
    yaws = [math.radians(x) for x in range(-45, 45, 5)]
    return T.band_scores(E.voxel_means(E.device_band(V.points(spark, d))), yaws).withColumns({"yaw": r("yaw"), "score": r("score")})


@query(given(POINTS, BOX) + f"SELECT yaw_key, {rs('lo_u')} lo_u, {rs('hi_u')} hi_u, {rs('lo_v')} lo_v, {rs('hi_v')} hi_v FROM (SELECT round(yaw,6)+0e0 yaw_key, min(x*cos(yaw)+y*sin(yaw)) lo_u, max(x*cos(yaw)+y*sin(yaw)) hi_u, min(y*cos(yaw)-x*sin(yaw)) lo_v, max(y*cos(yaw)-x*sin(yaw)) hi_v FROM v_points, (SELECT DISTINCT yaw FROM v_boxes) GROUP BY yaw)")
def projection_bounds(spark, d):
    e = T.extents(V.points(spark, d), V.boxes(spark, d).select("yaw").distinct())
    return e.select(r("yaw").alias("yaw_key"), *(r(c).alias(c) for c in ("lo_u", "hi_u", "lo_v", "hi_v")))


@query()
def outer_wall_filter(spark, d):
    return T.outer_walls(V.points(spark, d), V.boxes(spark, d))


@query("SELECT event_id, CASE WHEN event_id%11=0 THEN NULL ELSE " + rs("least(t-0.1e0, greatest(0.7e0*t, 1e0))") + " END cut, CASE WHEN event_id%11=0 THEN NULL ELSE " + rs("least(t-0.1e0, greatest(0.5e0*t, 1e0))") + " END mesh_cut FROM (SELECT event_id, CAST(event_id%30+5 AS DOUBLE)/10e0 t FROM events)")
def render_cut(spark, d):
    e = V.table(spark, d, "events").selectExpr("event_id", "CASE WHEN event_id%11=0 THEN NULL ELSE CAST(event_id%30+5 AS DOUBLE)/10e0 END t")
    finite = lambda c: F.when(c < 1e300, r(c))
    return e.select("event_id", finite(T.render_cut("t")).alias("cut"), finite(T.render_cut("t", mesh=True)).alias("mesh_cut"))


@query("SELECT count(*) FILTER (keep) n, count(*) FILTER (NOT keep) dropped FROM (SELECT ((o>=0.5e0 AND z>0.3e0) OR (o<0.5e0 AND z>1e0)) AND z<1.4e0 keep FROM (SELECT l_discount*20e0+l_tax*5e0 z, 1e0/(1e0+exp(-(l_discount*60e0-2e0))) o FROM lineitem))")
def render_keep_mask(spark, d):
    g = V.gaussians(spark, d).select("z", (1.0 / (1.0 + F.exp(-F.col("raw_opacity")))).alias("o"), F.lit(1.4).alias("cut"))
    keep = T.render_keep("z", "o", "cut")
    return g.agg(F.count(F.when(keep, 1)).alias("n"), F.count(F.when(~keep, 1)).alias("dropped"))


@query(given(BOX) + "SELECT box_id, front, front+CASE WHEN (-cos(radians(front)+yaw)*0.8e0-sin(radians(front)+yaw)*0.6e0)*(CASE WHEN box_id%2=0 THEN 1 ELSE -1 END)<0 THEN -90e0 ELSE 90e0 END side FROM (SELECT *, CASE WHEN sl>=sw THEN 0e0 ELSE 90e0 END+CASE WHEN 0.6e0*(CASE WHEN sl>=sw THEN -sin(yaw) ELSE -cos(yaw) END)+0.8e0*(CASE WHEN sl>=sw THEN cos(yaw) ELSE -sin(yaw) END)<0 THEN 180e0 ELSE 0e0 END front FROM v_boxes)")
def view_azimuths(spark, d):
    b = V.boxes(spark, d).withColumns({"ox": F.lit(0.6), "oy": F.lit(0.8), "rx": F.lit(0.8), "ry": F.lit(0.6), "sign": F.when(F.col("box_id") % 2 == 0, 1).otherwise(-1)})
    b = b.withColumn("front", T.front_azimuth("ox", "oy"))
    return b.select("box_id", "front", T.side_azimuth("front", "sign", "rx", "ry").alias("side"))


@query()
def synthetic_room(spark, d):
    return synth.room(spark).groupBy("part").agg(F.count(F.lit(1)).alias("n"), r(F.min("z"), 3).alias("low"), r(F.max("z"), 3).alias("high"))


@query()
def merge_adjacent_boxes(spark, d):
    return merging.merged_groups(V.points(spark, d), V.boxes(spark, d)).select("box_id", "group")
