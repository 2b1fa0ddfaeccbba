"""Small rules of refinement: votes of views, measured faces, refits taken over, rows filled up."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_equipment, is_ladder, is_subtractive
from .layout import row_gaps, rows
from .support import probe_filled


def ladder_only_views(labels: DataFrame) -> DataFrame:
    """view_id of views that show ladders and no device; labels has view_id and label."""
    g = labels.groupBy("view_id").agg(F.bool_or(is_ladder("label")).alias("ladder"), F.bool_or(~is_subtractive("label")).alias("device"))
    return g.where("ladder and not device").select("view_id")


def confirm_needless(instances: DataFrame, least: float = 0.6) -> DataFrame:
    """view_id, skip: whether all instances are equipment with a score of at least ``least``."""
    return instances.groupBy("view_id").agg(F.bool_and(is_equipment("label") & (F.col("score") >= least)).alias("skip"))


def clear_winner(candidates: DataFrame, key: str, value: str, ratio: float = 1.35) -> DataFrame:
    """key, best, clear: the candidate of the highest value and whether it is ``ratio`` times the second."""
    order = Window.partitionBy(key).orderBy(F.desc(value), "candidate")
    ranked = candidates.withColumns({"rn": F.row_number().over(order), "second": F.lead(value).over(order)})
    return ranked.where("rn = 1").select(key, F.col("candidate").alias("best"), (F.col("second").isNull() | (F.col(value) >= ratio * F.col("second"))).alias("clear"))


def face_surfaces(points: DataFrame, key: str = "box_id") -> DataFrame:
    """key, n, plane: the median plane across of points that are flat across and long along."""
    q = lambda c, a, b: F.percentile(c, F.array(F.lit(a), F.lit(b)))
    g = points.groupBy(key).agg(F.count(F.lit(1)).alias("n"), q("v", 0.05, 0.95).alias("qv"), q("u", 0.02, 0.98).alias("qu"), F.median("v").alias("plane"))
    return g.where((F.col("n") >= 40) & (F.col("qv")[1] - F.col("qv")[0] <= 0.12) & (F.col("qu")[1] - F.col("qu")[0] >= 0.30)).select(key, "n", "plane")


def faces_applied(boxes: DataFrame, measured: DataFrame) -> DataFrame:
    """boxes with centre and depth taken from measured front and back planes (box_id, face, plane, points).

    The measurement with most points of each face counts; a depth beyond 0.30 to
    2.50 metres leaves the box as it was.
    """
    best = measured.groupBy("box_id").agg(*(F.max(F.when(F.col("face") == f, F.struct("points", "plane")))["plane"].alias(f) for f in ("front", "back")))
    b = boxes.join(best, "box_id", "left")
    hi, lo = F.coalesce("front", F.col("sw") / 2), F.coalesce("back", -F.col("sw") / 2)
    depth = hi - lo
    ok = depth.between(0.30, 2.50)
    shift = F.when(ok, (hi + lo) / 2).otherwise(0.0)
    return b.select(*(c for c in boxes.columns if c not in ("cx", "cy", "sw")), (F.col("cx") - F.sin("yaw") * shift).alias("cx"), (F.col("cy") + F.cos("yaw") * shift).alias("cy"), F.when(ok, depth).otherwise(F.col("sw")).alias("sw")).select(*boxes.columns)


def adopted(boxes: DataFrame, refits: DataFrame, kept: tuple[str, ...] = ("device_type", "confidence")) -> DataFrame:
    """boxes with refits in place of those of the same id; identity columns stay, the source becomes agent_fix."""
    old = boxes.select("box_id", *kept)
    new = refits.drop(*kept, "source").join(old, "box_id").withColumn("source", F.lit("agent_fix"))
    return boxes.join(refits.select("box_id"), "box_id", "left_anti").unionByName(new.select(*boxes.columns))


def single_view(votes: DataFrame) -> DataFrame:
    """box_id of boxes that exactly one face view supports, without a depth and without a side device."""
    g = votes.groupBy("box_id").agg(F.sum((F.col("face") & F.col("device")).cast("int")).alias("faces"), F.bool_or("depth").alias("depth"), F.bool_or(~F.col("face") & F.col("device")).alias("side"))
    return g.where("faces = 1 and not depth and not side").select("box_id")


def absorbed(single: DataFrame, fine: DataFrame, key: str = "view_id") -> DataFrame:
    """Coarse spans (key, span_id, lo, hi) that overlap any fine span of their view."""
    f = fine.select(F.col(key).alias("__k"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
    return single.join(f, (F.col(key) == F.col("__k")) & (F.least("hi", "__hi") > F.greatest("lo", "__lo")), "left_semi")


# Rows filled up


def row_probes(boxes: DataFrame, yaw: float, gap: float = 0.35) -> DataFrame:
    """Candidate boxes (bucket, row_no, place, step, cx..yaw) in the gaps of rows and beyond their ends."""
    rowed = rows(boxes, yaw, gap)
    stats = rowed.groupBy("bucket", "row_no").agg(
        F.median("sw").alias("depth"), F.median("sh").alias("height"), F.greatest(F.lit(0.4), F.least(F.lit(1.2), F.median("sl"))).alias("w"), F.median("cross").alias("at"),
        F.min(F.struct("along", "sl")).alias("first"), F.max("along").alias("last"), F.max("sl").alias("longest"),
    )
    inner = row_gaps(rowed).join(rowed.select("box_id", "along", "sl"), "box_id").select("bucket", "row_no", F.concat(F.lit("gap"), F.col("box_id").cast("string")).alias("place"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("probes"))).alias("step"), (F.col("along") + F.col("sl") / 2).alias("edge"), "gap", "probes")
    inner = inner.select("bucket", "row_no", "place", "step", (F.col("edge") + F.col("gap") * F.col("step") / (F.col("probes") + 1)).alias("along"))
    ends = stats.select("bucket", "row_no", "w", (F.col("first.along") - F.col("first.sl") / 2).alias("lo"), (F.col("last") + F.col("longest") / 2).alias("hi"))
    reach = F.col("w") * (F.col("step") - 0.5) + 0.01
    ends = ends.select("*", F.explode(F.array(*(F.struct(F.lit(p).alias("place"), F.lit(s).cast("bigint").alias("step")) for p in ("low end", "high end") for s in (1, 2)))).alias("e")).select("*", "e.*")
    ends = ends.select("bucket", "row_no", "place", "step", F.when(F.col("place") == "low end", F.col("lo") - reach).otherwise(F.col("hi") + reach).alias("along"))
    c, s = math.cos(yaw), math.sin(yaw)
    p = inner.unionByName(ends).join(stats.select("bucket", "row_no", "depth", "height", "w", "at"), ["bucket", "row_no"])
    ax, ay = F.when(F.col("bucket") == 0, c).otherwise(-s), F.when(F.col("bucket") == 0, s).otherwise(c)
    x, y = ax * F.col("along") - ay * F.col("at"), ay * F.col("along") + ax * F.col("at")
    return p.select("bucket", "row_no", "place", "step", x.alias("cx"), y.alias("cy"), (F.col("height") / 2).alias("cz"), (F.col("w") * 0.9).alias("sl"), F.col("depth").alias("sw"), F.col("height").alias("sh"), F.atan2(ay, ax).alias("yaw"))


def filled_rows(points: DataFrame, boxes: DataFrame, yaw: float, gap: float = 0.35) -> DataFrame:
    """Probes that points fill and no box covers; beyond an end the second step needs the first."""
    from .spatial import near_points

    probes = row_probes(boxes, yaw, gap).withColumn("box_id", F.xxhash64("bucket", "row_no", "place", "step"))
    centres = probes.select("box_id", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z")).withColumnRenamed("box_id", "probe")
    covered = near_points(centres, boxes, 0.10).where((F.abs("u") <= F.col("sl") / 2 + 0.10) & (F.abs("v") <= F.col("sw") / 2 + 0.10) & (F.abs("k") <= F.col("sh") / 2 + 0.10))
    free = probes.join(covered.select(F.col("probe").alias("box_id")).distinct(), "box_id", "left_anti")
    good = probe_filled(points, free).where("filled")
    first = good.where("step = 1 and place like '% end'").select("bucket", "row_no", "place")
    inner, ends1, ends2 = good.where("place like 'gap%'"), good.where("place like '% end' and step = 1"), good.where("place like '% end' and step = 2").join(first, ["bucket", "row_no", "place"], "left_semi")
    cols = ["box_id", "bucket", "row_no", "place", "step", "cx", "cy", "cz", "sl", "sw", "sh", "yaw"]
    return inner.select(*cols).unionByName(ends1.select(*cols)).unionByName(ends2.select(*cols))


# Boundary of a room


def hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counterclockwise, by sorting and turning."""
    pts = np.unique(xy, axis=0)
    if len(pts) < 3:
        return pts

    def chain(rows):
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    low, high = chain(pts), chain(pts[::-1])
    return np.array(low[:-1] + high[:-1])


def off_boundary(cells: DataFrame, distance: float = 0.35) -> DataFrame:
    """Cells (i, j, mx, my) farther than ``distance`` from every edge of the hull; all cells if there are under twelve.

    Only the lowest and highest cell of each column can be on the hull; these
    two per column reach the driver.
    """
    ends = cells.groupBy("i").agg(F.min(F.struct("my", "mx")).alias("a"), F.max(F.struct("my", "mx")).alias("b"), F.min(F.struct("mx", "my")).alias("c"), F.max(F.struct("mx", "my")).alias("d"))
    pts = [(r[k]["mx"], r[k]["my"]) for r in ends.collect() for k in "abcd"]
    corners = hull(np.array(pts, float).reshape(-1, 2)) if pts else np.zeros((0, 2))
    if len(corners) < 3 or cells.limit(12).count() < 12:
        return cells
    far: Column = F.lit(True)
    for (x0, y0), (x1, y1) in zip(corners.tolist(), np.roll(corners, -1, axis=0).tolist()):
        dx, dy = x1 - x0, y1 - y0
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("mx") - x0) * dx + (F.col("my") - y0) * dy) / (dx * dx + dy * dy)))
        far = far & (F.hypot(F.col("mx") - x0 - t * dx, F.col("my") - y0 - t * dy) > distance)
    return cells.where(far)
