"""Front and back faces moved onto the sheets of points that they stand for.

The points of a box's column are counted by half bins of 1.5 cm across and 10 cm
of height; a pure function reads both faces' moves off these counts.  What needs
the points again (overhead structure, support of a far sheet) is checked for the
proposed places only, for all boxes at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rects import checkpointed
from .spatial import near_points
from .trims import FLOOR, column_slice, height_guard

# Bin and half bin, half width of a face, reach of the two outward passes.
STEP, HALF, ON_FACE, NEAR, FAR = 0.03, 0.015, 0.06, 0.15, 0.30
POINTS, EMPTY, HEIGHT_CELL, HEIGHT_SHARE, HEIGHT_POINTS = 50, 0.05, 0.10, 0.60, 10
INWARD, OUTWARD, OUTWARD_FAR = (0.55, 0.25), (0.50, 0.25), (0.65, 0.35)
STRONGER, LEAST_MOVE, DEPTH = 1.25, 0.02, (0.30, 2.50)
SUPPORT_POINTS, SUPPORT_SHARE, SUPPORT_REACH = 20, 0.30, 0.05


@dataclass
class Profile:
    """counts[half bin, height cell] from -depth/2 - FAR on; covered: height share at the front and the back face."""

    counts: np.ndarray
    depth: float
    covered: dict[int, float]

    def bands(self, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(middles, points of each bin and the one before it) of the window that the reach opens."""
        skip, n = round((FAR - reach) / STEP), int((self.depth + 2 * reach) / STEP + 1e-9) + 2
        whole = np.zeros(2 * (skip + n))
        own = self.counts.sum(1)[: len(whole)]
        whole[: len(own)] = own
        bins = whole.reshape(-1, 2).sum(1)[skip:]
        return -self.depth / 2 - reach + STEP * (np.arange(n) + 0.5), bins + np.r_[0, bins[:-1]]

    def height_share(self, at: float) -> float:
        """Share of the height cells that points within ON_FACE of a bin's middle fill."""
        k = round((at + self.depth / 2 + FAR) / HALF)
        near = self.counts[max(0, k - round(ON_FACE / HALF)) : k + round(ON_FACE / HALF)].sum(0)
        return float((near > 0).mean()) if near.sum() >= HEIGHT_POINTS else 0.0


def peaks_in(at: np.ndarray, band: np.ndarray, lo: float, hi: float, limits: tuple[float, float]) -> np.ndarray:
    """Bins in [lo, hi] that are no lower than their neighbours and high enough against the window and against all."""
    inside = (at >= lo) & (at <= hi)
    if not inside.any():
        return np.zeros(0, int)
    top = np.r_[True, (band[1:-1] >= band[:-2]) & (band[1:-1] >= band[2:]), True]
    return np.flatnonzero(inside & top & (band >= max(limits[0] * band[inside].max(), limits[1] * band.max())))


def face_move(p: Profile, side: int, reach: float) -> tuple[str, list[float], list[float]]:
    """(kind, places from near to far, their bands) for a face: 'keep', 'in', 'out' or 'none'.

    A face on a sheet stays.  A sheet outside that is clearly stronger than any
    inside takes it; else only a face without points, or with too little of its
    height filled, moves inwards, or outwards where nothing is inside.
    """
    at, band = p.bands(reach)
    face = side * p.depth / 2
    most = band.max()
    on = band[np.abs(at - face) <= ON_FACE + 1e-9]
    bare = (on.max() if len(on) else 0.0) <= EMPTY * most
    low = not bare and p.covered[side] < HEIGHT_SHARE
    room = max(p.depth - DEPTH[0], 0.0)
    ahead = (at - face) * side
    inner = peaks_in(at, band, *sorted((face - side * room, face)), INWARD)
    outer = peaks_in(at, band, *sorted((face, face + side * reach)), OUTWARD if reach <= NEAR else OUTWARD_FAR)
    if low:
        inner = np.array([i for i in inner if -ahead[i] >= LEAST_MOVE and p.height_share(at[i]) >= HEIGHT_SHARE], int)
    else:
        both = np.r_[inner, outer]
        if len(both) and ((np.abs(ahead[both]) <= STEP) & (band[both] >= INWARD[0] * band[both].max())).any():
            return "keep", [], []
    beyond = outer[ahead[outer] > LEAST_MOVE]
    strong = band[inner].max() if len(inner) else 0.0
    if len(beyond) and not (low and len(inner)) and band[beyond].max() >= STRONGER * strong:
        kind, found = "out", beyond
    elif (bare or low) and len(inner):
        kind, found = "in", inner
    elif len(beyond) and not len(inner):
        kind, found = "out", beyond
    else:
        return "none", [], []
    order = found[np.argsort(np.abs(ahead[found]), kind="stable")]
    return kind, at[order].tolist(), band[order].tolist()


def proposal(p: Profile) -> dict:
    """Kinds and places for front and back, and the far place to try where the near pass leaves a face."""
    moves = {s: face_move(p, s, NEAR) for s in (1, -1)}
    place = {s: m[1][0] if m[1] else s * p.depth / 2 for s, m in moves.items()}
    if moves[1][0] == moves[-1][0] == "in":  # both inwards: the pair that moves least and leaves a device between
        pairs = [(abs(f - p.depth / 2) + abs(b + p.depth / 2), -bf - bb, f, b) for f, bf in zip(*moves[1][1:]) for b, bb in zip(*moves[-1][1:]) if DEPTH[0] <= f - b <= DEPTH[1]]
        if pairs:
            _, _, place[1], place[-1] = min(pairs)
        elif place[1] + p.depth / 2 >= p.depth / 2 - place[-1]:
            place[-1] = -p.depth / 2
        else:
            place[1] = p.depth / 2
    far = {}
    for s in (1, -1):
        kind, places, _ = face_move(p, s, FAR)
        move = (places[0] - s * p.depth / 2) * s if kind == "out" else 0.0
        far[s] = places[0] if NEAR < move <= FAR else None
    return {"kind_f": moves[1][0], "kind_b": moves[-1][0], "at_f": place[1], "at_b": place[-1], "far_f": far[1], "far_b": far[-1]}


def proposals(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """box_id and what ``proposal`` gives, for boxes with enough points in their column."""
    cells = F.greatest(F.ceil((F.col("sh") - FLOOR) / HEIGHT_CELL), F.lit(1).cast("bigint"))
    column = column_slice(points, boxes).select("box_id", "sw", "v", cells.alias("cells"), F.least(F.greatest(F.floor((F.col("k") + F.col("sh") / 2 - FLOOR) / HEIGHT_CELL), F.lit(0).cast("bigint")), cells - 1).alias("h"))
    total = column.groupBy("box_id").agg(F.count(F.lit(1)).alias("n"), *(x for s, n in ((1, "f"), (-1, "b")) for x in (F.count(F.when(F.abs(F.col("v") - s * F.col("sw") / 2) <= ON_FACE, 1)).alias(f"n_{n}"), F.count_distinct(F.when(F.abs(F.col("v") - s * F.col("sw") / 2) <= ON_FACE, F.col("h"))).alias(f"h_{n}")))).where(F.col("n") >= POINTS)
    bin_ = F.floor((F.col("v") + F.col("sw") / 2 + FAR) / HALF + 1e-9)
    counted = column.withColumn("b", bin_).where((F.col("b") >= 0) & (F.col("b") <= (F.col("sw") + 2 * FAR) / HALF + 4)).groupBy("box_id", "sw", "cells", "b", "h").agg(F.count(F.lit(1)).alias("c"))
    rows = counted.groupBy("box_id", "sw", "cells").agg(F.collect_list(F.struct("b", "h", "c")).alias("bins")).join(total, "box_id")
    share = lambda n: F.when(F.col(f"n_{n}") >= HEIGHT_POINTS, F.col(f"h_{n}") / F.col("cells").cast("double")).otherwise(0.0)

    @F.pandas_udf("kind_f string, kind_b string, at_f double, at_b double, far_f double, far_b double")
    def read(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for bins, depth, cells_, front, back in parts:
            out = []
            for b, d, n, f, k in zip(bins, depth, cells_, front, back):
                counts = np.zeros((max(x["b"] for x in b) + 1, n))
                for x in b:
                    counts[x["b"], x["h"]] = x["c"]
                out.append(proposal(Profile(counts, d, {1: f, -1: k})))
            yield pd.DataFrame(out, columns=["kind_f", "kind_b", "at_f", "at_b", "far_f", "far_b"])

    found = rows.withColumn("p", read("bins", "sw", "cells", share("f"), share("b")))
    return found.select("box_id", "p.*")


def sheet_supported(points: DataFrame, places: DataFrame) -> DataFrame:
    """places (box columns, v_at) with supported: whether points spread over the whole face lie near that plane."""
    rows = checkpointed(places.withColumn("__p", F.monotonically_increasing_id()))
    size = lambda s: F.greatest(F.ceil(F.col(s) / HEIGHT_CELL), F.lit(1).cast("bigint"))
    at = lambda a, s: F.least(F.floor((F.col(a) + F.col(s) / 2) / HEIGHT_CELL), size(s) - 1)
    near = near_points(points, rows, 1.0).where((F.abs(F.col("v") - F.col("v_at")) <= SUPPORT_REACH) & (F.abs("u") <= F.col("sl") / 2) & (F.abs("k") <= F.col("sh") / 2))
    g = near.groupBy("__p", at("u", "sl").alias("i"), at("k", "sh").alias("j")).agg(F.count(F.lit(1)).alias("c")).groupBy("__p").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("cells"))
    ok = (F.col("n") >= SUPPORT_POINTS) & (F.col("cells") / (size("sl") * size("sh")).cast("double") >= SUPPORT_SHARE)
    return rows.join(g, "__p", "left").withColumn("supported", F.coalesce(ok, F.lit(False))).select(*places.columns, "supported")


def snapped_faces(points: DataFrame, boxes: DataFrame, locked: str | None = None) -> DataFrame:
    """boxes with front and back on their sheets (cx, cy, sw), and moved.

    ``locked`` names a column array<string> of faces ('front', 'back') that were
    observed and stay.  A move outwards must pass the height guard; a face that the
    near pass leaves may move farther out onto a sheet that is filled all over.
    Depths outside 0.30 to 2.50 metres leave the box as it was.
    """
    found = checkpointed(boxes.join(proposals(points, boxes), "box_id"))
    sides = (("f", 1, "front"), ("b", -1, "back"))
    asked = None
    for n, s, _ in sides:
        for place, test in ((f"at_{n}", F.col(f"kind_{n}") == "out"), (f"far_{n}", F.col(f"far_{n}").isNotNull())):
            one = found.where(test).select(*boxes.columns, F.col(place).alias("v_at"), F.lit(place).alias("place"))
            asked = one if asked is None else asked.unionByName(one)
    asked = asked.withColumns({"u_at": F.lit(0.0), "end": F.lit(False)})
    guarded = height_guard(points, asked).where("ok").drop("ok")
    near = guarded.where("place like 'at%'").select("box_id", "place")
    far = sheet_supported(points, guarded.where("place like 'far%'")).where("supported").select("box_id", "place")
    good = near.unionByName(far).groupBy("box_id").agg(F.collect_set("place").alias("good"))
    rows = found.join(good, "box_id", "left").withColumn("good", F.coalesce("good", F.array().cast("array<string>")))
    new = {}
    for n, s, name in sides:
        face = s * F.col("sw") / 2
        kind, at = F.col(f"kind_{n}"), F.col(f"at_{n}")
        passed = (kind == "in") | ((kind == "out") & F.array_contains("good", f"at_{n}"))
        left = (kind == "none") | (kind == "out")
        pick = F.when(passed, at).when(left & F.array_contains("good", f"far_{n}"), F.col(f"far_{n}")).otherwise(face)
        if locked:
            pick = F.when(F.coalesce(F.array_contains(locked, name), F.lit(False)), face).otherwise(pick)
        new[n] = F.when(F.abs(pick - face) >= LEAST_MOVE, pick).otherwise(face)
    rows = rows.withColumns({"__f": new["f"], "__b": new["b"]})
    depth, mid = F.col("__f") - F.col("__b"), (F.col("__f") + F.col("__b")) / 2
    moved = (F.abs(depth - F.col("sw")) + F.abs(mid) > 1e-9) & depth.between(*DEPTH)
    out = boxes.join(rows.select("box_id", "__f", "__b"), "box_id", "left").withColumn("moved", F.coalesce(moved, F.lit(False)))
    place = {"cx": F.col("cx") - F.sin("yaw") * mid, "cy": F.col("cy") + F.cos("yaw") * mid, "sw": depth}
    return out.select(*((F.when(F.col("moved"), place[c]).otherwise(F.col(c)).alias(c) if c in place else F.col(c)) for c in boxes.columns), "moved")
