"""All queries over clouds, boxes, views and replies, with their plain SQL."""

from __future__ import annotations

from . import camera_queries, cloud_queries, fit_queries, layout_queries, refine_queries, repair_queries, view_queries

MODULES = (cloud_queries, camera_queries, view_queries, layout_queries, fit_queries, refine_queries, repair_queries)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
