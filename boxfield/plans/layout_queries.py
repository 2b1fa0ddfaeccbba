"""Queries over the box table, with their plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..operators import layout as L
from ..operators import profiles, spans as N
from ..operators.spatial import by_shape, inside, places
from ..sources import layouts as J
from .cloud_queries import r, rs
from .sql_views import BOX, POINTS, PRED, given, inside as sql_inside, near

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def tilted(spark, d):
    return V.boxes(spark, d).withColumns({"n_pts": (F.col("score") * 1000).cast("bigint"), "tilt": F.col("box_id") % 3 == 0})


@query()
def iou_2d(spark, d):
    return L.overlaps(V.boxes(spark, d), V.predicted_boxes(spark, d)).withColumns({"iou": r("iou"), "contained": r("contained")})


@query()
def evaluate(spark, d):
    return L.evaluate(V.boxes(spark, d), V.predicted_boxes(spark, d))


@query()
def two_tier_dedup(spark, d):
    return L.two_tier_kept(tilted(spark, d)).select("box_id", "n_pts", "tilt")


_COR = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
_PCX = [f"(p.cx+({i})*p.sl/2e0*cos(p.yaw)-({j})*p.sw/2e0*sin(p.yaw))" for i, j in _COR]
_PCY = [f"(p.cy+({i})*p.sl/2e0*sin(p.yaw)+({j})*p.sw/2e0*cos(p.yaw))" for i, j in _COR]
_U = [f"(({x}-b.cx)*cos(b.yaw)+({y}-b.cy)*sin(b.yaw))" for x, y in zip(_PCX, _PCY)]
_W = [f"(({y}-b.cy)*cos(b.yaw)-({x}-b.cx)*sin(b.yaw))" for x, y in zip(_PCX, _PCY)]


@query(given(BOX, PRED) + f"SELECT b.box_id, {rs(f'abs(least({', '.join(_U)})+b.sl/2e0)')} e0, {rs(f'abs(greatest({', '.join(_U)})-b.sl/2e0)')} e1, {rs(f'abs(least({', '.join(_W)})+b.sw/2e0)')} e2, {rs(f'abs(greatest({', '.join(_W)})-b.sw/2e0)')} e3 FROM v_boxes b JOIN v_pred p ON p.box_id=b.box_id")
def edge_error(spark, d):
    p = V.predicted_boxes(spark, d).select("box_id", *(F.col(c).alias(f"{c}_b") for c in ("cx", "cy", "sl", "sw", "yaw")))
    e = L.edge_errors(V.boxes(spark, d).join(p, "box_id"))
    return e.select("box_id", *(r(F.col("errors")[i]).alias(f"e{i}") for i in range(4)))


ROWS = "rb AS (SELECT *, abs(cos(yaw)*cos(0e0)+sin(yaw)*sin(0e0))>0.9e0 m FROM v_boxes), rc AS (SELECT *, CASE WHEN m THEN 0 ELSE 1 END bucket, round(CASE WHEN m THEN cx*cos(0e0)+cy*sin(0e0) ELSE cy*cos(0e0)-cx*sin(0e0) END,9) along, round(CASE WHEN m THEN cy*cos(0e0)-cx*sin(0e0) ELSE -(cx*cos(0e0)+cy*sin(0e0)) END,9) cross_ FROM rb), rl AS (SELECT *, CASE WHEN cross_-lag(cross_) OVER (PARTITION BY bucket ORDER BY cross_, box_id)>0.35e0 THEN 1 ELSE 0 END nw FROM rc), ro AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY bucket ORDER BY cross_, box_id ROWS UNBOUNDED PRECEDING) AS BIGINT) row_no FROM rl)"


def rowed(spark, d):
    return L.rows(V.boxes(spark, d), 0.0)


@query(given(BOX, ROWS) + f"SELECT box_id, bucket, row_no, {rs('along')} along, {rs('cross_')} cross_at FROM ro")
def row_clusters(spark, d):
    return rowed(spark, d).select("box_id", "bucket", "row_no", r("along").alias("along"), r("cross").alias("cross_at"))


@query(given(BOX, ROWS, "gp AS (SELECT *, lead(along-sl/2e0) OVER (PARTITION BY bucket, row_no ORDER BY along, box_id)-(along+sl/2e0) gap FROM ro)", "md AS (SELECT bucket, row_no, greatest(0.4e0, least(1.2e0, median(sl))) width FROM ro GROUP BY 1,2)") + f"SELECT bucket, row_no, box_id, {rs('gap')} gap, {rs('width')} width, CAST(least(round_even(gap/width, 0), 2e0) AS BIGINT) probes FROM gp JOIN md USING (bucket, row_no) WHERE gap>=0.5e0*width")
def row_gaps(spark, d):
    return L.row_gaps(rowed(spark, d)).withColumns({"gap": r("gap"), "width": r("width")})


@query()
def snap_row_seams(spark, d):
    return L.snapped_seams(rowed(spark, d)).withColumns({"lo": r("lo"), "hi": r("hi")})


def continues_sql(side: int) -> str:
    al = [f"({x}*cos(b.yaw)+{y}*sin(b.yaw))" for x, y in zip(_PCX, _PCY)]
    cr = [f"({y}*cos(b.yaw)-{x}*sin(b.yaw))" for x, y in zip(_PCX, _PCY)]
    own = "(b.cx*cos(b.yaw)+b.cy*sin(b.yaw))"
    gap = f"least({', '.join(al)})-({own}+b.sl/2e0)" if side > 0 else f"({own}-b.sl/2e0)-greatest({', '.join(al)})"
    hi, lo = f"greatest({', '.join(cr)})", f"least({', '.join(cr)})"
    return f"SELECT DISTINCT b.box_id FROM v_boxes b JOIN v_boxes p ON p.box_id<>b.box_id AND abs((p.yaw-b.yaw)-round_even((p.yaw-b.yaw)/pi(),0)*pi())<=radians(20e0) AND least({hi}, b.sw/2e0)-greatest({lo}, -b.sw/2e0)>0.5e0*least({hi}-{lo}, b.sw) AND {gap} BETWEEN -0.2e0 AND 0.4e0"


@query(given(BOX) + f"SELECT box_id, 1 side FROM ({continues_sql(1)}) UNION ALL SELECT box_id, -1 FROM ({continues_sql(-1)})")
def row_continues(spark, d):
    b = V.boxes(spark, d)
    return L.row_continues(b, 1).withColumn("side", F.lit(1)).union(L.row_continues(b, -1).withColumn("side", F.lit(-1)))


TOPS = "tp AS (SELECT event_id, CASE WHEN event_id%5=0 THEN NULL ELSE value/120e0 END m, CASE WHEN event_id%7=0 THEN NULL ELSE CAST(event_id%50 AS DOUBLE)/10e0 END k, 1.5e0+CAST(event_id%9 AS DOUBLE)/10e0 t FROM events), ok AS (SELECT *, coalesce(k BETWEEN 0.5e0 AND 4.5e0 AND k>=0.45e0*t AND k<=t+1.2e0, false) c, coalesce(m BETWEEN 0.5e0 AND 4.5e0, false) o FROM tp)"


@query(given(TOPS) + f"SELECT event_id, {rs('CASE WHEN o AND NOT (m<0.7e0*t AND c AND k>m+0.25e0) THEN m WHEN o OR c THEN k END')} top, CASE WHEN o AND m<0.7e0*t AND c AND k>m+0.25e0 THEN 'col-guard' WHEN o THEN 'mask' WHEN c THEN 'col' END source FROM ok")
def pick_piece_top(spark, d):
    e = V.table(spark, d, "events").selectExpr("event_id", "CASE WHEN event_id%5=0 THEN NULL ELSE value/120e0 END m", "CASE WHEN event_id%7=0 THEN NULL ELSE CAST(event_id%50 AS DOUBLE)/10e0 END k", "1.5e0+CAST(event_id%9 AS DOUBLE)/10e0 t")
    top, source = L.piece_top("m", "k", "t")
    return e.select("event_id", r(top).alias("top"), source.alias("source"))


def corridor_sql(along: bool) -> str:
    v = "sl>=sw" if not along else "sl<sw"
    return given(
        "v_points AS (SELECT l_quantity*0.2e0 x, l_extendedprice/1e4 y, l_discount*20e0+l_tax*5e0 z, l_discount*60e0-2e0 raw_opacity FROM lineitem)", BOX,
        f"lo AS (SELECT b.*, p.raw_opacity, CASE WHEN b.{v} THEN (p.y-b.cy)*cos(b.yaw)-(p.x-b.cx)*sin(b.yaw) ELSE (p.x-b.cx)*cos(b.yaw)+(p.y-b.cy)*sin(b.yaw) END du, CASE WHEN b.{v} THEN (p.x-b.cx)*cos(b.yaw)+(p.y-b.cy)*sin(b.yaw) ELSE (p.y-b.cy)*cos(b.yaw)-(p.x-b.cx)*sin(b.yaw) END dv, CASE WHEN b.{v} THEN b.sw ELSE b.sl END/2e0 fc, CASE WHEN b.{v} THEN b.sl ELSE b.sw END/2e0+1e0 st FROM v_boxes b JOIN v_points p ON p.z>0.25e0 AND p.z<greatest(least(b.cz+b.sh/2e0-0.2e0,2e0),0.5e0))",
        "rw AS (SELECT box_id, CASE WHEN du>=0 THEN 1 ELSE -1 END side, round(abs(du)-fc,9) b, 1/(1+exp(-raw_opacity)) op FROM lo WHERE abs(dv)<st)",
        "bn AS (SELECT box_id, side, floor((b-0.02e0)/0.05e0) bin, sum(op) m FROM rw WHERE b>0.02e0 AND b<3e0 GROUP BY 1,2,3)",
        "co AS (SELECT box_id, side, min(bin)*0.05e0+0.02e0 c FROM bn WHERE m>=1e0 GROUP BY 1,2)",
        "fa AS (SELECT box_id, side, sum(op) f FROM rw WHERE b>1.2e0 GROUP BY 1,2)",
        "wd AS (SELECT x.box_id, coalesce(c1.c,3e0) c1, coalesce(c2.c,3e0) c2, coalesce(f1.f,0e0) f1, coalesce(f2.f,0e0) f2 FROM v_boxes x LEFT JOIN co c1 ON c1.box_id=x.box_id AND c1.side=1 LEFT JOIN co c2 ON c2.box_id=x.box_id AND c2.side=-1 LEFT JOIN fa f1 ON f1.box_id=x.box_id AND f1.side=1 LEFT JOIN fa f2 ON f2.box_id=x.box_id AND f2.side=-1)",
        "pk AS (SELECT *, CASE WHEN f1>=3*f2 AND f1>=20 THEN 1 WHEN f2>=3*f1 AND f2>=20 THEN -1 WHEN c1>=c2 THEN 1 ELSE -1 END s FROM wd)",
    ) + f"SELECT box_id, s open_side, {rs('CASE WHEN s=1 THEN c1 ELSE c2 END')} corridor, round(f1,4) far1, round(f2,4) far2 FROM pk"


def corridor_rows(found):
    return found.select("box_id", "open_side", r("corridor").alias("corridor"), F.round("far1", 4).alias("far1"), F.round("far2", 4).alias("far2"))


@query(corridor_sql(False))
def open_side(spark, d):
    return corridor_rows(L.corridors(V.gaussians(spark, d), V.boxes(spark, d)))


@query(corridor_sql(True))
def free_row_end(spark, d):
    return corridor_rows(L.corridors(V.gaussians(spark, d), V.boxes(spark, d), along=True))


@query("WITH RECURSIVE " + POINTS + """, pl AS (SELECT * REPLACE (x+CAST(floor(x) AS BIGINT)%10*2e0 AS x) FROM v_points),
ce AS (SELECT CAST(floor(x/0.3e0) AS BIGINT) i, CAST(floor(y/0.3e0) AS BIGINT) j, count(*) n, min(x) x0, min(y) y0, max(x) x1, max(y) y1 FROM pl GROUP BY 1,2),
gr AS (SELECT DISTINCT i+a i, j+b j FROM ce, (VALUES (-1),(0),(1)) s(a), (VALUES (-1),(0),(1)) t(b) WHERE n>=6 AND i+a BETWEEN (SELECT min(i) FROM ce) AND (SELECT max(i) FROM ce) AND j+b BETWEEN (SELECT min(j) FROM ce) AND (SELECT max(j) FROM ce)),
re(i, j, a, b) AS (SELECT i, j, i, j FROM gr UNION SELECT re.i, re.j, g.i, g.j FROM re JOIN gr g ON abs(g.i-re.a)<=1 AND abs(g.j-re.b)<=1),
lb AS (SELECT i, j, min(a*2147483648+b) label FROM re GROUP BY 1,2)
SELECT label AS cluster, CAST(sum(n) AS BIGINT) n, """ + ", ".join(f"{rs(e)} {c}" for c, e in (("x0", "min(x0)-0.15e0"), ("y0", "min(y0)-0.15e0"), ("x1", "max(x1)+0.15e0"), ("y1", "max(y1)+0.15e0"))) + " FROM ce JOIN lb USING (i, j) GROUP BY label HAVING sum(n)>=60")
def cluster_candidates(spark, d):
    spread = V.points(spark, d).withColumn("x", F.expr("x+CAST(floor(x) AS BIGINT)%10*2e0"))  # strips of one metre, two metres apart
    out = L.cell_clusters(spread)
    return out.withColumns({c: r(c) for c in ("x0", "y0", "x1", "y1")})


YAWS = "yc AS (SELECT CAST(event_id%180 AS DOUBLE)+0.5e0 deg, value score FROM events)"


@query(given(YAWS, "fd AS (SELECT ((deg+45e0)%90e0+90e0)%90e0-45e0 deg, score FROM yc)", "bs AS (SELECT round_even(deg/2e0,0) k, max({'score': score, 'deg': deg}) m FROM fd GROUP BY 1)") + "SELECT m.deg AS deg, m.score AS score FROM bs ORDER BY score DESC, deg LIMIT 3")
def top_yaw_candidates(spark, d):
    c = V.table(spark, d, "events").selectExpr("CAST(event_id%180 AS DOUBLE)+0.5e0 deg", "value score")
    return L.top_yaw_candidates(c)


@query("SELECT yaw, n, delta FROM (SELECT event_id yaw, event_id%40 n, CASE WHEN event_id%6=0 THEN NULL ELSE value/1e4-0.02e0 END delta FROM events) ORDER BY coalesce(abs(delta)<=radians(3e0), false) DESC, n DESC, coalesce(abs(delta), 1e9), yaw LIMIT 1")
def pick_yaw_trial(spark, d):
    t = V.table(spark, d, "events").selectExpr("event_id yaw", "event_id%40 n", "CASE WHEN event_id%6=0 THEN NULL ELSE value/1e4-0.02e0 END delta")
    return L.best_trial(t)


def spans(spark, d):
    """Spans of views along a row, each with the pixel box that it was seen in."""
    return V.table(spark, d, "events").selectExpr("user_id view_id", "event_id span_id", "value lo", "value+CAST(event_id%5 AS DOUBLE)*0.4e0+0.1e0 hi", "CAST(event_id%10 AS DOUBLE)/10e0 ms", "event_id%300 n", "event_type label", "value*4e0 px0", "0e0 py0", "value*4e0+8e0+CAST(event_id%3 AS DOUBLE)*4e0 px1", "20e0 py1", "event_id")


@query()
def merge_spans(spark, d):
    return N.merged_spans(spans(spark, d).drop("event_id")).withColumns({"lo": r("lo"), "hi": r("hi")})


XV = "sp AS (SELECT user_id row_id, event_id%2 view_id, event_id span_id, value lo, value+CAST(event_id%5 AS DOUBLE)*2e0+0.5e0 hi, CAST(event_id%10 AS DOUBLE)/10e0 ms, event_id%300 n, event_type label FROM events)"
XV_SQL = given(
    XV,
    "vc AS (SELECT row_id, view_id, count(*) c FROM sp GROUP BY 1,2), rc AS (SELECT row_id, count(*) v, min(c) lo, max(c) hi FROM vc GROUP BY 1)",
    "ab AS (SELECT DISTINCT s.span_id FROM sp s JOIN vc ON vc.row_id=s.row_id AND vc.view_id=s.view_id AND vc.c=1 JOIN rc ON rc.row_id=s.row_id AND rc.v=2 AND rc.hi>1 JOIN sp f ON f.row_id=s.row_id AND f.view_id<>s.view_id AND least(s.hi,f.hi)>greatest(s.lo,f.lo))",
    "lf AS (SELECT * FROM sp WHERE span_id NOT IN (SELECT span_id FROM ab))",
    "lk AS (SELECT a.span_id a, b.span_id b FROM lf a JOIN lf b ON a.row_id=b.row_id AND a.span_id<>b.span_id AND least(a.hi,b.hi)-greatest(a.lo,b.lo)>=0.5e0*least(a.hi-a.lo,b.hi-b.lo))",
    "dg AS (SELECT span_id, (SELECT count(*) FROM lk WHERE lk.a=lf.span_id) k, (SELECT max(b) FROM lk WHERE lk.a=lf.span_id) o FROM lf)",
    "kp AS (SELECT * FROM dg WHERE k<=1), pr AS (SELECT a.span_id, b.span_id other FROM kp a LEFT JOIN kp b ON a.k=1 AND b.k=1 AND a.o=b.span_id AND b.o=a.span_id WHERE b.span_id IS NULL OR a.span_id<b.span_id)",
)


@query(XV_SQL + f"SELECT x.row_id, x.span_id, {rs('least(x.lo, coalesce(y.lo, x.lo))')} lo, {rs('greatest(x.hi, coalesce(y.hi, x.hi))')} hi, greatest(x.ms, coalesce(y.ms, x.ms)) ms, x.n+coalesce(y.n, 0) n, CASE WHEN y.n>x.n THEN y.label ELSE x.label END AS label FROM pr JOIN sp x ON x.span_id=pr.span_id LEFT JOIN sp y ON y.span_id=pr.other")
def merge_cross_view(spark, d):
    e = V.table(spark, d, "events").selectExpr("user_id row_id", "event_id%2 view_id", "event_id span_id", "value lo", "value+CAST(event_id%5 AS DOUBLE)*2e0+0.5e0 hi", "CAST(event_id%10 AS DOUBLE)/10e0 ms", "event_id%300 n", "event_type label")
    return N.cross_view(e).withColumns({"lo": r("lo"), "hi": r("hi")})


@query("SELECT event_id, " + rs("value+CAST(event_id%5 AS DOUBLE)*0.2e0") + " centre, " + rs("0.55e0*CAST(event_id%10 AS DOUBLE)/10e0+0.45e0*least((event_id%300)/200e0,1e0)") + " piece_score FROM events")
def build_split_pieces(spark, d):
    return N.piece_scores(V.table(spark, d, "events").selectExpr("value lo", "value+CAST(event_id%5 AS DOUBLE)*0.4e0 hi", "CAST(event_id%10 AS DOUBLE)/10e0 ms", "event_id%300 n", "event_id")).select("event_id", r("centre").alias("centre"), r("piece_score").alias("piece_score"))


@query()
def anchored_top(spark, d):
    return profiles.body_tops(inside(V.points(spark, d), V.boxes(spark, d)), ["box_id"]).withColumn("top", r("top"))


@query()
def region_axis_span(spark, d):
    spans = lambda shapes: profiles.peak_spans(inside(places(V.points(spark, d)), shapes), ["box_id"], "u", weight="__n")
    return by_shape(V.boxes(spark, d), spans, "inner").select("box_id", r("lo").alias("lo"), r("hi").alias("hi"))


# Records


@query(given(BOX) + "SELECT box_id, concat(device_type, CASE WHEN rn>1 THEN concat('_', CAST(rn AS VARCHAR)) ELSE '' END) AS name FROM (SELECT box_id, device_type, row_number() OVER (PARTITION BY device_type ORDER BY box_id) rn FROM v_boxes)")
def output_names(spark, d):
    return J.output_names(V.boxes(spark, d), F.col("device_type")).select("box_id", "name")


@query(given(BOX) + f"SELECT box_id, {rs('atan2(sin(yaw), cos(yaw))')} yaw, {rs('cx')} cx, CASE WHEN device_type='ac' THEN 'ac' WHEN device_type IN ('rack','ups') THEN device_type ELSE 'unknown' END device_type FROM v_boxes")
def detector_objects(spark, d):
    return J.boxes_from_objects(J.objects_of(V.boxes(spark, d)), "box_id").select("box_id", r("yaw").alias("yaw"), r("cx").alias("cx"), "device_type")


@query(given(BOX) + "SELECT box_id, cx, sl, yaw, confidence FROM v_boxes")
def box_json_round_trip(spark, d):
    return J.boxes_from_json(J.to_json(V.boxes(spark, d))).select("box_id", "cx", "sl", "yaw", "confidence")


@query()
def layout_svg(spark, d):
    return J.svg(V.boxes(spark, d))
