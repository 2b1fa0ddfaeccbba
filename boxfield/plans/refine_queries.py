"""Queries of the refinement rules, with their plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..operators import estimators as E
from ..operators import refine as R
from ..operators.spatial import inside
from .cloud_queries import r, rs
from .sql_views import BOX, POINTS, given, inside as sql_inside, near

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LABELS = "lb AS (SELECT user_id*7+event_id%3 view_id, event_id candidate, CAST(event_id%10 AS DOUBLE)/10e0 score, value energy, CASE event_id%5 WHEN 0 THEN 'Server RACK' WHEN 1 THEN 'Door panel' WHEN 2 THEN 'cable tray' WHEN 3 THEN 'Ladder' ELSE 'ladder rung' END label FROM events)"


def labels(spark, d):
    return V.table(spark, d, "events").selectExpr("user_id*7+event_id%3 view_id", "event_id candidate", "CAST(event_id%10 AS DOUBLE)/10e0 score", "value energy", "CASE event_id%5 WHEN 0 THEN 'Server RACK' WHEN 1 THEN 'Door panel' WHEN 2 THEN 'cable tray' WHEN 3 THEN 'Ladder' ELSE 'ladder rung' END label")


LADDER = "(contains(lower(label),'ladder') OR contains(lower(label),'cable tray'))"


@query(given(LABELS) + f"SELECT view_id FROM lb GROUP BY view_id HAVING bool_or({LADDER}) AND NOT bool_or(NOT ({LADDER} OR contains(lower(label),'door')))")
def ladder_only_views(spark, d):
    return R.ladder_only_views(labels(spark, d))


@query(given(LABELS) + "SELECT view_id, bool_and(regexp_matches(lower(label), 'rack|cabinet|server|device|equipment|ups|crac|ac|pdu') AND score>=0.6e0) AS skip FROM lb GROUP BY view_id")
def confirm_needless(spark, d):
    return R.confirm_needless(labels(spark, d))


@query(given(LABELS, "rk AS (SELECT view_id, candidate, energy, row_number() OVER w rn, lead(energy) OVER w nxt FROM lb WINDOW w AS (PARTITION BY view_id ORDER BY energy DESC, candidate))") + "SELECT view_id, candidate AS best, nxt IS NULL OR energy>=1.35e0*nxt AS clear FROM rk WHERE rn=1")
def edge_energy_choice(spark, d):
    return R.clear_winner(labels(spark, d), "view_id", "energy")


@query(given(POINTS, BOX, near("0e0"), sql_inside(), "fs AS (SELECT box_id, count(*) n, quantile_cont(v,0.95)-quantile_cont(v,0.05) sv, quantile_cont(u,0.98)-quantile_cont(u,0.02) su, median(v) plane FROM ins WHERE abs(v-0.2e0)<0.05e0 GROUP BY 1)") + f"SELECT box_id, n, {rs('plane')} plane FROM fs WHERE n>=40 AND sv<=0.12e0 AND su>=0.3e0")
def measure_face_surface(spark, d):
    p = inside(V.points(spark, d), V.boxes(spark, d)).where(F.abs(F.col("v") - 0.2) < 0.05)
    return R.face_surfaces(p).withColumn("plane", r("plane"))


MEASURED = "ms AS (SELECT event_id%120 box_id, CASE WHEN event_id%2=0 THEN 'front' ELSE 'back' END face, CASE WHEN event_id%2=0 THEN 0.3e0+CAST(event_id%17 AS DOUBLE)/10e0 ELSE -0.2e0-CAST(event_id%13 AS DOUBLE)/20e0 END plane, event_id points FROM events)"


@query(given(BOX, MEASURED, "bs AS (SELECT box_id, max(CASE WHEN face='front' THEN {'p': points, 'v': plane} END).v f, max(CASE WHEN face='back' THEN {'p': points, 'v': plane} END).v b FROM ms GROUP BY 1)", "hl AS (SELECT v.*, coalesce(f, sw/2e0) hi, coalesce(b, -sw/2e0) lo FROM v_boxes v LEFT JOIN bs USING (box_id))", "ok AS (SELECT *, hi-lo BETWEEN 0.3e0 AND 2.5e0 o FROM hl)") + f"SELECT box_id, {rs('cx-sin(yaw)*(CASE WHEN o THEN (hi+lo)/2e0 ELSE 0e0 END)')} cx, {rs('cy+cos(yaw)*(CASE WHEN o THEN (hi+lo)/2e0 ELSE 0e0 END)')} cy, {rs('CASE WHEN o THEN hi-lo ELSE sw END')} sw FROM ok")
def face_surface_constraints(spark, d):
    m = V.table(spark, d, "events").selectExpr("event_id%120 box_id", "CASE WHEN event_id%2=0 THEN 'front' ELSE 'back' END face", "CASE WHEN event_id%2=0 THEN 0.3e0+CAST(event_id%17 AS DOUBLE)/10e0 ELSE -0.2e0-CAST(event_id%13 AS DOUBLE)/20e0 END plane", "event_id points")
    return R.faces_applied(V.boxes(spark, d), m).select("box_id", r("cx").alias("cx"), r("cy").alias("cy"), r("sw").alias("sw"))


@query(given(BOX) + "SELECT box_id, CASE WHEN box_id%3=0 THEN sl+1e0 ELSE sl END sl, device_type, confidence, CASE WHEN box_id%3=0 THEN 'agent_fix' ELSE source END AS source FROM v_boxes")
def adopt_refit(spark, d):
    b = V.boxes(spark, d)
    refit = b.where("box_id % 3 = 0").withColumns({"sl": F.col("sl") + 1.0, "confidence": F.lit("none"), "device_type": F.lit("none")})
    return R.adopted(b, refit).select("box_id", "sl", "device_type", "confidence", "source")


VOTES = "vo AS (SELECT event_id%4001 box_id, event_id%3<>0 face, event_id%2=0 device, event_id%7=0 depth FROM events)"


@query(given(VOTES) + "SELECT box_id FROM vo GROUP BY box_id HAVING sum(CASE WHEN face AND device THEN 1 ELSE 0 END)=1 AND NOT bool_or(depth) AND NOT bool_or(NOT face AND device)")
def single_view_support(spark, d):
    return R.single_view(V.table(spark, d, "events").selectExpr("event_id%4001 box_id", "event_id%3<>0 face", "event_id%2=0 device", "event_id%7=0 depth"))


@query("SELECT a.event_id span_id FROM events a WHERE a.event_id%10=0 AND EXISTS (SELECT 1 FROM events b WHERE b.event_id%10=1 AND b.user_id=a.user_id AND least(a.value+2e0, b.value+0.5e0)>greatest(a.value, b.value))")
def absorb_single(spark, d):
    e = V.table(spark, d, "events")
    single = e.where("event_id % 10 = 0").selectExpr("user_id view_id", "event_id span_id", "value lo", "value+2e0 hi")
    fine = e.where("event_id % 10 = 1").selectExpr("user_id view_id", "value lo", "value+0.5e0 hi")
    return R.absorbed(single, fine).select("span_id")


@query()
def complete_row_gaps(spark, d):
    found = R.filled_rows(V.points(spark, d), V.boxes(spark, d), 0.0)
    return found.select("bucket", "row_no", "place", "step", *(r(c).alias(c) for c in ("cx", "cy", "sl", "sw", "sh")))


@query()
def boundary_keep_mask(spark, d):
    return R.off_boundary(E.voxel_means(E.device_band(V.points(spark, d)))).select("i", "j", "n")
