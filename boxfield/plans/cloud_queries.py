"""Queries over points and boxes, with their plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..operators import estimators as E
from ..operators import support as S
from ..operators.spatial import by_shape, inside
from .sql_views import BOX, POINTS, given, inside as sql_inside, near


def r(x, digits: int = 6):
    """Rounded, with one kind of zero."""
    return F.round(x if not isinstance(x, str) else F.col(x), digits) + F.lit(0.0)


def rs(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits})+0e0"


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


VOX = "least(CAST(floor((u+sl/2e0)/0.1e0) AS BIGINT), greatest(CAST(floor(sl/0.1e0) AS BIGINT),1)-1)*1000000+least(CAST(floor((v+sw/2e0)/0.1e0) AS BIGINT), greatest(CAST(floor(sw/0.1e0) AS BIGINT),1)-1)*1000+least(CAST(floor((k+sh/2e0)/0.1e0) AS BIGINT), greatest(CAST(floor(sh/0.1e0) AS BIGINT),1)-1)"
SUPPORT = f"""occ AS (SELECT box_id, count(*) n_pts, count(DISTINCT {VOX}) n_occ FROM ins GROUP BY box_id),
sup AS (SELECT b.*, coalesce(o.n_pts,0) n_pts, CASE WHEN coalesce(o.n_pts,0)<5 THEN 0e0 ELSE o.n_occ/(greatest(floor(sl/0.1e0),1e0)*greatest(floor(sw/0.1e0),1e0)*greatest(floor(sh/0.1e0),1e0)) END support FROM v_boxes b LEFT JOIN occ o USING (box_id))"""


@query(given(POINTS, BOX, near("0e0"), sql_inside(), SUPPORT) + "SELECT box_id, n_pts, support, CASE WHEN support>0.3e0 THEN 'high' WHEN support>0.15e0 THEN 'mid' ELSE 'low' END confidence FROM sup")
def support_fraction(spark, d):
    return S.support_fraction(V.points(spark, d), V.boxes(spark, d)).select("box_id", "n_pts", "support", S.support_confidence().alias("confidence"))


@query(given(POINTS, BOX, near("0e0"), sql_inside(), SUPPORT) + "SELECT box_id, CASE WHEN device_type='unknown' THEN 'low' WHEN support>0.3e0 AND source<>'row_completion' THEN 'high' WHEN support>0.15e0 THEN 'mid' ELSE 'low' END confidence FROM sup")
def agent_confidence(spark, d):
    sup = S.support_fraction(V.points(spark, d), V.boxes(spark, d)).withColumn("type_suspect", F.col("device_type") == "unknown")
    return sup.select("box_id", S.agent_confidence().alias("confidence"))


@query(given(POINTS, BOX, near("0e0"), sql_inside(), SUPPORT) + ", o AS (SELECT support, row_number() OVER (ORDER BY support) rn, count(*) OVER () n FROM sup) SELECT min(support) min_support, max(CASE WHEN rn=floor(n/2e0)+1 THEN support END) median_support, max(support) max_support FROM o")
def diag_support(spark, d):
    return E.support_summary(S.support_fraction(V.points(spark, d), V.boxes(spark, d)))


def face_sql(tolerance: str) -> str:
    faces = [("front", "v", "sw", "-", "u", "sl", "k", "sh"), ("back", "v", "sw", "+", "u", "sl", "k", "sh"), ("left", "u", "sl", "+", "v", "sw", "k", "sh"), ("right", "u", "sl", "-", "v", "sw", "k", "sh"), ("top", "k", "sh", "-", "u", "sl", "v", "sw")]
    one = [f"SELECT b.box_id, '{f}' face, count(n.box_id) n, count(DISTINCT CASE WHEN n.box_id IS NOT NULL THEN least(floor((n.{t1}+n.{s1}/2e0)/0.1e0), greatest(ceil(n.{s1}/0.1e0),1e0)-1e0)*1e5+least(floor((n.{t2}+n.{s2}/2e0)/0.1e0), greatest(ceil(n.{s2}/0.1e0),1e0)-1e0) END)/max(greatest(ceil(b.{s1}/0.1e0),1e0)*greatest(ceil(b.{s2}/0.1e0),1e0)) coverage FROM v_boxes b LEFT JOIN near n ON b.box_id=n.box_id AND abs(n.{a}{sg}n.{s}/2e0)<={tolerance} AND abs(n.{t1})<=n.{s1}/2e0 AND abs(n.{t2})<=n.{s2}/2e0 GROUP BY b.box_id" for f, a, s, sg, t1, s1, t2, s2 in faces]
    return "faces AS (" + " UNION ALL ".join(one) + ")"


@query(given(POINTS, BOX, near("0.03e0"), face_sql("0.03e0")) + "SELECT box_id, face, n, coverage FROM faces")
def face_coverage(spark, d):
    return S.face_coverage(V.points(spark, d), V.boxes(spark, d))


@query(given(POINTS, BOX, near("0.03e0"), face_sql("0.03e0"), "m AS (SELECT box_id, sum(CASE WHEN n>=10 AND coverage>=0.7e0 THEN 1 ELSE 0 END) matched FROM faces GROUP BY box_id)") + "SELECT box_id, CAST(matched AS BIGINT) matched_faces, CASE WHEN sh>2.8e0 THEN 'low' ELSE ['low','mid','high'][greatest(0, least(2, (CASE confidence WHEN 'low' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END)+CASE WHEN matched>=2 THEN 1 ELSE -1 END))+1] END new_confidence FROM v_boxes JOIN m USING (box_id)")
def face_support(spark, d):
    return S.face_support(V.points(spark, d), V.boxes(spark, d), protected=F.col("sh") > 2.8).select("box_id", "matched_faces", "new_confidence")


@query(given(POINTS, BOX, near("0.05e0"), face_sql("0.05e0")) + "SELECT box_id, face, n, n>=20 AND coverage>=0.3e0 supported FROM faces WHERE face IN ('front','back')")
def extended_face_supported(spark, d):
    return S.extended_face_supported(V.points(spark, d), V.boxes(spark, d)).select("box_id", "face", "n", "supported")


OVER = "ov AS (SELECT box_id, count(*) c FROM near WHERE z>cz+sh/2e0+0.2e0 AND z<cz+sh/2e0+0.8e0 AND abs(u)<=sl/2e0+0.3e0 AND abs(v)<=sw/2e0+0.3e0 GROUP BY box_id), over_ AS (SELECT b.*, coalesce(c,0) n_over, coalesce(c,0)>=30 overhead FROM v_boxes b LEFT JOIN ov USING (box_id))"


@query(given(POINTS, BOX, near("0.3e0"), OVER) + "SELECT box_id, n_over, overhead FROM over_")
def overhead_structure(spark, d):
    return S.overhead(V.points(spark, d), V.boxes(spark, d)).select("box_id", "n_over", "overhead")


@query(given(POINTS, BOX, near("0.3e0"), OVER) + "SELECT box_id, sh>2.8e0 AND NOT overhead structural, CASE WHEN sh>2.8e0 AND NOT overhead THEN 'low' ELSE confidence END new_confidence FROM over_")
def structural_filter(spark, d):
    return S.structural_filter(V.points(spark, d), V.boxes(spark, d)).select("box_id", "structural", "new_confidence")


@query(given(POINTS, BOX, near("0.3e0"), OVER, near("0e0", "near0"), sql_inside("0e0", "near0"), SUPPORT, "fl AS (SELECT o.box_id, o.confidence, o.source<>'agent_fix' AND o.sh<=1.2e0 AND least(o.sl,o.sw)>=0.45e0 AND NOT overhead AND support<0.25e0 f FROM over_ o JOIN sup USING (box_id))") + "SELECT box_id, f furniture, CASE WHEN f THEN 'low' ELSE confidence END new_confidence FROM fl")
def furniture_filter(spark, d):
    return S.furniture_filter(V.points(spark, d), V.boxes(spark, d)).select("box_id", "furniture", "new_confidence")


@query(given(POINTS, BOX, near("0e0"), sql_inside(), "pr AS (SELECT box_id, count(*) n_dev, max(k) top, quantile_cont(u,0.95)-quantile_cont(u,0.05) su, quantile_cont(v,0.95)-quantile_cont(v,0.05) sv FROM ins WHERE k>0.3e0 GROUP BY box_id)") + "SELECT box_id, coalesce(n_dev,0) n_dev, coalesce(n_dev>=40 AND top>=0.5e0 AND su>=0.4e0*sl AND sv>=0.4e0*sw, false) filled FROM v_boxes LEFT JOIN pr USING (box_id)")
def probe_filled(spark, d):
    return S.probe_filled(V.points(spark, d), V.boxes(spark, d)).select("box_id", "n_dev", "filled")


@query(given(POINTS, BOX, near("0e0", "n0"), sql_inside("0e0", "n0"), near("1e0"), "other AS (SELECT DISTINCT pt_id, x, y, z, box_id FROM ins)") + "SELECT box_id, count(*) n FROM near n WHERE NOT EXISTS (SELECT 1 FROM other o WHERE o.pt_id=n.pt_id AND o.x=n.x AND o.y=n.y AND o.z=n.z AND o.box_id<>n.box_id) GROUP BY box_id")
def own_points(spark, d):
    return S.own_counts(V.points(spark, d), V.boxes(spark, d))


@query(given(POINTS, BOX, near("0.6e0")) + "SELECT floor(x) gx, count(*) n, round(sum(y),6) sy FROM (SELECT DISTINCT pt_id, x, y, z FROM near WHERE abs(u)<sl/2e0+0.6e0 AND abs(v)<sw/2e0+0.6e0) GROUP BY 1")
def near_boxes_mask(spark, d):
    return S.near_any_box(V.points(spark, d), V.boxes(spark, d)).groupBy(F.floor("x").cast("double").alias("gx")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 6).alias("sy"))


@query(given(POINTS, BOX, near("0.3e0")) + "SELECT box_id, count(*) n FROM near WHERE abs(u)<=sl/2e0+0.3e0 AND abs(k)<=sh/2e0+0.15e0 AND v<=sw/2e0+0.05e0 AND v>=-sw/2e0-0.3e0 GROUP BY box_id")
def box_only_mask(spark, d):
    return S.box_only(V.points(spark, d), V.boxes(spark, d), wall="front").groupBy("box_id").agg(F.count(F.lit(1)).alias("n"))


@query(given(POINTS) + "SELECT count(*) n, round(sum(z),4) sz FROM v_points WHERE x BETWEEN 2e0 AND 5e0 AND y BETWEEN 1e0 AND 4e0 AND z BETWEEN 0.5e0 AND 2e0")
def points_in_region(spark, d):
    p = V.points(spark, d).where(F.col("x").between(2, 5) & F.col("y").between(1, 4) & F.col("z").between(0.5, 2))
    return p.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("z"), 4).alias("sz"))


@query(given(POINTS) + f"SELECT count(*) n, min(x) min_x, max(x) max_x, min(y) min_y, max(y) max_y, min(z) min_z, max(z) max_z, {', '.join(f'{rs(f'quantile_cont(z,{p / 100})')} z_p{p}' for p in (1, 10, 50, 90, 99))}, round(avg(CASE WHEN z>0.5e0 AND z<2.4e0 THEN 1e0 ELSE 0e0 END),6) band_share, count(DISTINCT (floor(x/0.1e0), floor(y/0.1e0))) xy_voxels FROM v_points")
def diag_point_cloud(spark, d):
    out = E.cloud_summary(V.points(spark, d))
    return out.withColumns({c: r(c) for c in ("z_p1", "z_p10", "z_p50", "z_p90", "z_p99")} | {"band_share": F.round("band_share", 6)})


BASE = "base AS (SELECT quantile_cont(z,0.02) b FROM v_points)"
TILES = "tiles AS (SELECT CAST(floor(x/1.5e0) AS BIGINT) i, CAST(floor(y/1.5e0) AS BIGINT) j, count(*) FILTER (z<=b+1e0) n_low, quantile_cont(z,0.02) FILTER (z<=b+1e0) q, max(b) b FROM v_points, base GROUP BY 1,2), floors AS (SELECT i, j, n_low, CASE WHEN n_low>=30 THEN q ELSE b END floor_z FROM tiles)"


@query(given(POINTS, BASE, TILES) + f"SELECT i, j, n_low, {rs('floor_z')} floor_z FROM floors")
def floor_map(spark, d):
    return E.floor_tiles(V.points(spark, d)).withColumn("floor_z", r("floor_z"))


@query(given(POINTS, BASE, TILES, "fine AS (SELECT CAST(floor(x/0.3e0) AS BIGINT) i, CAST(floor(y/0.3e0) AS BIGINT) j, count(*) n, min(z) low, min(x) ax, min(y) ay FROM v_points GROUP BY 1,2)") + f"SELECT f.i, f.j, {rs('CASE WHEN n>=3 AND low<=b+1.5e0 THEN low ELSE coalesce(floor_z, b) END')} floor_z FROM fine f, base LEFT JOIN floors g ON g.i=CAST(floor(ax/1.5e0) AS BIGINT) AND g.j=CAST(floor(ay/1.5e0) AS BIGINT)")
def floor_map_mesh(spark, d):
    return E.mesh_floor_tiles(V.points(spark, d)).withColumn("floor_z", r("floor_z"))


@query(given(POINTS, BASE, TILES, "h AS (SELECT p.*, z-floor_z h FROM v_points p JOIN floors f ON f.i=CAST(floor(x/1.5e0) AS BIGINT) AND f.j=CAST(floor(y/1.5e0) AS BIGINT))") + "SELECT count(*) FILTER (h>0.3e0) above, count(*) FILTER (h>0.3e0 AND h<=1e0) pool, round(avg(h),6) mean_h FROM h")
def fit_pool(spark, d):
    h = E.height_above_floor(V.points(spark, d), E.floor_tiles(V.points(spark, d)))
    n = lambda c: F.count(F.when(c, 1))
    return h.agg(n(F.col("h") > 0.3).alias("above"), n((F.col("h") > 0.3) & (F.col("h") <= 1.0)).alias("pool"), F.round(F.avg("h"), 6).alias("mean_h"))


ROT = "rot AS (SELECT x*cos(-0.3e0)-y*sin(-0.3e0) x, x*sin(-0.3e0)+y*cos(-0.3e0) y FROM v_points)"


@query(given(POINTS, ROT) + f"SELECT {rs('min(x)')} x0, {rs('min(y)')} y0, {rs('max(x)')} x1, {rs('max(y)')} y1 FROM rot")
def layout_frame(spark, d):
    return E.layout_frame(V.points(spark, d), 0.3).select(*(r(c).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query(given(POINTS, ROT) + f"SELECT {rs('quantile_cont(x,0.01)')} x0, {rs('quantile_cont(y,0.01)')} y0, {rs('quantile_cont(x,0.99)')} x1, {rs('quantile_cont(y,0.99)')} y1 FROM rot")
def grounding_frame(spark, d):
    return E.grounding_frame(V.points(spark, d), 0.3).select(*(r(c).alias(c) for c in ("x0", "y0", "x1", "y1")))


TILE_AXIS = "SELECT k, lo+k*(s-2.5e0) a, lo+k*(s-2.5e0)+s b FROM (SELECT lo, n, (hi-lo+(n-1)*2.5e0)/n s, unnest(range(0, CAST(n AS BIGINT))) k FROM (SELECT lo, hi, greatest(ceil((hi-lo-2.5e0)/22.5e0),1e0) n FROM (SELECT {0}0 lo, {0}1 hi FROM big)))"


@query(given(POINTS, "big AS (SELECT min(x)*8e0 x0, min(y)*8e0 y0, max(x)*8e0 x1, max(y)*8e0 y1 FROM v_points)", f"ax AS ({TILE_AXIS.format('x')})", f"ay AS ({TILE_AXIS.format('y')})") + f"SELECT ax.k tx, ay.k ty, {rs('ax.a')} tx0, {rs('ay.a')} ty0, {rs('ax.b')} tx1, {rs('ay.b')} ty1 FROM ax, ay")
def tile_frames(spark, d):
    big = V.points(spark, d).agg((F.min("x") * 8).alias("x0"), (F.min("y") * 8).alias("y0"), (F.max("x") * 8).alias("x1"), (F.max("y") * 8).alias("y1"))
    return E.tile_frames(big).withColumns({c: r(c) for c in ("tx0", "ty0", "tx1", "ty1")})


@query(given(POINTS, BOX, near("0e0"), sql_inside(), "lw AS (SELECT box_id, min(u) low FROM ins GROUP BY 1)", "bn AS (SELECT box_id, low, floor((u-low)/0.05e0) bin, count(*) n FROM ins JOIN lw USING (box_id) GROUP BY 1,2,3)", "pk AS (SELECT *, max(n) OVER (PARTITION BY box_id) peak FROM bn)") + f"SELECT box_id, {rs('min(low+bin*0.05e0)')} lo, {rs('max(low+(bin+1)*0.05e0)')} hi FROM pk WHERE n>=greatest(0.4e0*peak, 3e0) GROUP BY box_id")
def robust_span(spark, d):
    return E.robust_span(inside(V.points(spark, d), V.boxes(spark, d)), "box_id", "u").withColumns({"lo": r("lo"), "hi": r("hi")})


@query(given(POINTS, BOX, near("0e0"), sql_inside(), "bn AS (SELECT box_id, floor((v-(-0.4e0))/0.05e0) bin, count(*) n, min(v) a, max(v) b FROM ins WHERE v BETWEEN -0.4e0 AND 0.4e0 GROUP BY 1,2)") + f"SELECT box_id, {rs('min(a)')} lo, {rs('max(b)')} hi FROM bn WHERE n>=3 GROUP BY box_id")
def side_supported_span(spark, d):
    return E.side_supported_span(inside(V.points(spark, d), V.boxes(spark, d)), "box_id", "v", -0.4, 0.4).withColumns({"lo": r("lo"), "hi": r("hi")})


@query(given(POINTS, BOX, near("0e0"), sql_inside()) + f"SELECT box_id, count(*) n, {rs('min(u)')} lo, {rs('max(u)')} hi, {rs('quantile_cont(u,0.02)')} p2, {rs('quantile_cont(u,0.98)')} p98 FROM ins GROUP BY box_id HAVING count(*)>=30")
def region_axis_span_mesh(spark, d):
    spans = lambda shapes: E.box_quantiles(V.points(spark, d), shapes, {"u": "sl"}, [0.0, 0.02, 0.98, 1.0], asked=lambda n: n >= 30).where("n >= 30")
    rows = by_shape(V.boxes(spark, d), spans, "inner")
    return rows.select("box_id", "n", *(r(F.col("q_u")[i]).alias(c) for c, i in (("lo", 0), ("hi", 3), ("p2", 1), ("p98", 2))))


DEVICE = "dev AS (SELECT * FROM v_points WHERE z>0.4e0 AND z<2.5e0)"
MEANS = "mn AS (SELECT CAST(floor(x/0.25e0) AS BIGINT) i, CAST(floor(y/0.25e0) AS BIGINT) j, count(*) n, avg(x) mx, avg(y) my FROM dev GROUP BY 1,2)"


@query(given(POINTS, DEVICE, MEANS) + f"SELECT i, j, n, {rs('mx+3e-9', 7)} mx, {rs('my+3e-9', 7)} my FROM mn")
def voxel_means(spark, d):
    return E.voxel_means(E.device_band(V.points(spark, d))).withColumns({c: r(F.col(c) + 3e-9, 7) for c in ("mx", "my")})  # off the ties of halves


FOLD = "((({0})+pi()/4)%(pi()/2)+pi()/2)%(pi()/2)-pi()/4"


@query(given(POINTS, DEVICE, MEANS) + f"SELECT {rs(FOLD.format('0.5e0*atan2(2e0*covar_samp(mx,my), var_samp(mx)-var_samp(my))'))} yaw FROM mn")
def global_pca_yaw(spark, d):
    return E.principal_yaw(E.voxel_means(E.device_band(V.points(spark, d)))).select(r("yaw").alias("yaw"))


VOTES = "vt AS (SELECT box_id, count(*) n, " + FOLD.format("0.5e0*atan2(2e0*covar_pop(x,y), var_pop(x)-var_pop(y))-0.1e0") + " delta FROM ins GROUP BY box_id HAVING count(*)>=50 AND max(greatest(sl,sw))>=1e0)"


@query(given(POINTS, BOX, near("0e0"), sql_inside(), VOTES) + f"SELECT box_id, n, {rs('delta')} delta FROM vt")
def seed_axis_votes(spark, d):
    return E.axis_votes(inside(V.points(spark, d), V.boxes(spark, d)), 0.1, 50, 1.0).withColumn("delta", r("delta"))


@query(given(POINTS, BOX, near("0e0"), sql_inside(), VOTES) + f"SELECT {rs('min(delta)')} delta FROM (SELECT delta, sum(n) OVER (ORDER BY delta, n ROWS UNBOUNDED PRECEDING) run, sum(n) OVER () total, count(*) OVER () c FROM vt) WHERE run>=total/2e0 AND c>=2")
def seed_axis_delta(spark, d):
    votes = E.axis_votes(inside(V.points(spark, d), V.boxes(spark, d)), 0.1, 50, 1.0)
    return E.weighted_median(votes, "delta", "n").select(r("delta").alias("delta"))


@query(given(POINTS, DEVICE, MEANS, "pr AS (SELECT sqrt(dx*dx+dy*dy) d, atan2(dy, dx) t FROM (SELECT round(b.mx-a.mx,9) dx, round(b.my-a.my,9) dy FROM mn a JOIN mn b ON (a.i<b.i OR (a.i=b.i AND a.j<b.j)) AND abs(b.mx-a.mx)<=0.55e0 AND abs(b.my-a.my)<=0.55e0))", "rw AS (SELECT CAST(least(floor(((t%(pi()/2))+pi()/2)%(pi()/2)/(pi()/2)*90), 89) AS BIGINT) bin, sum(d) w FROM pr WHERE d<=0.55e0 GROUP BY 1)") + "SELECT (bin+dd+90)%90 bin, round(sum(w*kk/9e0),5) w FROM rw, (VALUES (-2,1e0),(-1,2e0),(0,3e0),(1,2e0),(2,1e0)) s(dd,kk) GROUP BY 1")
def pair_angle_histogram(spark, d):
    return E.pair_angle_histogram(E.voxel_means(E.device_band(V.points(spark, d)))).select(F.col("bin").cast("bigint").alias("bin"), F.round("w", 5).alias("w"))


@query(given(POINTS, "vx AS (SELECT DISTINCT CAST(floor(x/0.3e0) AS BIGINT) i, CAST(floor(y/0.3e0) AS BIGINT) j, CAST(floor(z/0.3e0) AS BIGINT) k FROM v_points)", "nb AS (SELECT a.i, a.j, a.k FROM vx a JOIN vx b ON abs(a.i-b.i)<=1 AND abs(a.j-b.j)<=1 AND abs(a.k-b.k)<=1 GROUP BY 1,2,3 HAVING count(*)-1>=6)", "kp AS (SELECT DISTINCT a.i, a.j, a.k FROM vx a JOIN nb b ON abs(a.i-b.i)<=1 AND abs(a.j-b.j)<=1 AND abs(a.k-b.k)<=1)") + "SELECT i, count(*) n FROM v_points JOIN kp ON i=CAST(floor(x/0.3e0) AS BIGINT) AND j=CAST(floor(y/0.3e0) AS BIGINT) AND k=CAST(floor(z/0.3e0) AS BIGINT) GROUP BY 1")
def thin_structure_mask(spark, d):
    return E.thick_points(V.points(spark, d)).groupBy(F.floor(F.col("x") / 0.3).alias("i")).agg(F.count(F.lit(1)).alias("n"))


@query(given(POINTS, "q AS (SELECT quantile_cont(z,0.25) q25, quantile_cont(z,0.02) q2, min(z) low FROM v_points)", "bn AS (SELECT CAST(floor((z-low)/0.05e0) AS BIGINT) bin, count(*) n FROM v_points, q WHERE z<=q25 GROUP BY 1)", "sm AS (SELECT bin, n*0.5e0+0.25e0*coalesce((SELECT n FROM bn c WHERE c.bin=b.bin-1),0)+0.25e0*coalesce((SELECT n FROM bn c WHERE c.bin=b.bin+1),0) w FROM bn b)", "tp AS (SELECT bin, w, (SELECT median(w) FROM sm) mid FROM sm ORDER BY w DESC, bin LIMIT 1)") + f"SELECT {rs('CASE WHEN w>=greatest(50e0, 2e0*mid) THEN (SELECT median(z) FROM v_points WHERE z>=low+bin*0.05e0-0.05e0 AND z<=low+bin*0.05e0+0.15e0) ELSE q2 END')} floor_z FROM tp, q")
def floor_spike(spark, d):
    return E.floor_spike(V.points(spark, d)).select(r("floor_z").alias("floor_z"))
