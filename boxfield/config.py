"""Thresholds of the layout rules, in metres, points and shares.  Fixed values."""

SUPPORT_VOXEL, SUPPORT_MIN_POINTS = 0.1, 5
SUPPORT_HIGH, SUPPORT_MID = 0.30, 0.15
FACE_TOLERANCE, FACE_CELL, FACE_MIN_POINTS, FACE_MIN_COVERAGE, FACES_REQUIRED = 0.03, 0.10, 10, 0.70, 2
EXTENDED_TOLERANCE, EXTENDED_MIN_POINTS, EXTENDED_MIN_COVERAGE = 0.05, 20, 0.30
TALL_HEIGHT, TRAY_BAND, TRAY_MIN_POINTS, TRAY_MARGIN = 2.80, (0.20, 0.80), 30, 0.30
LOW_HEIGHT, LOW_MIN_SIDE, LOW_MAX_SUPPORT = 1.20, 0.45, 0.25
THIN_VOXEL, THIN_MIN_NEIGHBOURS = 0.3, 6
FLOOR_GRID, FLOOR_BAND, FLOOR_MIN_POINTS = 1.5, 1.0, 30
MESH_FLOOR_GRID, MESH_FLOOR_BAND, MESH_FLOOR_MIN_POINTS = 0.3, 1.5, 3
TILE_SPAN, TILE_OVERLAP, FRAME_MARGIN = 25.0, 2.5, 0.5
MAX_DEVICE_SPAN, MAX_RECT_SHARE = 2.5, 0.8
PROBE_MIN_POINTS, PROBE_MIN_HEIGHT, PROBE_SPAN_SHARE, PROBE_FLOOR = 40, 0.5, 0.4, 0.30
SPAN_CELL, SPAN_STRONG, SPAN_FLOOR, SIDE_MIN_POINTS = 0.05, 0.4, 3, 3
ROW_GAP = 0.35
IOU_GRID, IOU_MAX_CELLS, MATCH_IOU, EDGE_THRESHOLD, MATCH_REACH = 0.02, 4_000_000, 0.3, 0.05, 3.0
CELL, CELL_MIN_POINTS, CLUSTER_MIN_POINTS, CLUSTER_MARGIN = 0.3, 6, 60, 0.15
SH_C0 = 0.28209479177387814
EQUIPMENT_TOKENS = ("rack", "cabinet", "server", "device", "equipment", "ups", "crac", "ac", "pdu")
#: Chain rules and weights of the repeated-rectangle filter.
CHAIN = {"cross_size": 0.20, "cross_overlap": 0.55, "along_size": 0.60, "gap_back": 0.35, "gap_ahead": 0.25, "least": 3}
CHAIN_WEIGHTS = {"count": 0.20, "size": 0.20, "align": 0.15, "adjacency": 0.25, "periodic": 0.10, "oob": 0.25, "grid": 0.15}
CHAIN_DROP_Y, CHAIN_DROP_X = 0.42, 0.75
