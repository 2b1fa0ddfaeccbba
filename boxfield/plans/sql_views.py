"""The derived tables as SQL, for the queries' plain counterparts."""

from __future__ import annotations

from ..views import BOXES

POINTS = "v_points AS (SELECT CAST(l_orderkey*10+l_linenumber AS BIGINT) pt_id, l_quantity*0.2e0 x, l_extendedprice/1e4 y, l_discount*20e0+l_tax*5e0 z FROM lineitem)"
BOX = "v_boxes AS (SELECT " + ", ".join(BOXES) + " FROM supplier)"
PRED = "v_pred AS (SELECT * REPLACE (cx+(score-0.5e0)*0.2e0 AS cx, cy-(score-0.5e0)*0.1e0 AS cy) FROM v_boxes)"
RECTS = "v_rects AS (SELECT CAST(user_id AS BIGINT) view_id, event_id rect_id, value*2e0 x0, CAST(event_id%37 AS DOUBLE)*20e0 y0, value*2e0+40e0+CAST(event_id%7 AS DOUBLE) x1, CAST(event_id%37 AS DOUBLE)*20e0+22e0 y1, event_type label FROM events)"
PIXELS = "v_pixels AS (SELECT vec_id view_id, CAST(i%8 AS INT) px, CAST(floor(i/8e0) AS INT) py, CAST(e AS DOUBLE)+0.55e0 lum, 1.5e0+CAST(e AS DOUBLE) depth, 0.85e0+CAST(e AS DOUBLE)*0.5e0 alpha, CAST(e AS DOUBLE)>0e0 mask FROM (SELECT vec_id, unnest(range(0, 64)) i, unnest(embedding) e FROM embeddings))"


def near(margin: str, name: str = "near") -> str:
    """Points in the rectangle around each box grown by the margin, with local coordinates."""
    hx = f"(abs(cos(b.yaw))*(b.sl/2e0+{margin})+abs(sin(b.yaw))*(b.sw/2e0+{margin}))"
    hy = f"(abs(sin(b.yaw))*(b.sl/2e0+{margin})+abs(cos(b.yaw))*(b.sw/2e0+{margin}))"
    return f"""{name} AS (SELECT b.*, p.*, (p.x-b.cx)*cos(b.yaw)+(p.y-b.cy)*sin(b.yaw) u, (p.y-b.cy)*cos(b.yaw)-(p.x-b.cx)*sin(b.yaw) v, p.z-b.cz k
 FROM v_boxes b JOIN v_points p ON p.x BETWEEN b.cx-{hx} AND b.cx+{hx} AND p.y BETWEEN b.cy-{hy} AND b.cy+{hy})"""


def inside(margin: str = "0e0", source: str = "near", name: str = "ins") -> str:
    return f"{name} AS (SELECT * FROM {source} WHERE abs(u)<=sl/2e0+{margin} AND abs(v)<=sw/2e0+{margin} AND abs(k)<=sh/2e0+{margin})"


def given(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
