"""Boxes of one device joined where points bridge the gap between them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import corners, frame_rect, sat_gap
from .rects import checkpointed
from .spatial import box_pairs, scene_keys

BRIDGE, OVERLAP, WIDTH, BAND, POINTS, DENSITY = 0.50, 0.10, 0.05, 0.20, 15, 0.30


def named(suffix: str) -> list:
    return [(F.col(f"k{i}x{suffix}"), F.col(f"k{i}y{suffix}")) for i in range(4)]


def slabs(pairs: DataFrame) -> DataFrame:
    """Pairs (columns x0..y1 and x0_b..y1_b) with the probe rectangles between them, one for each axis that qualifies."""
    out = None
    for a, c in (("x", "y"), ("y", "x")):
        lo, hi = F.greatest(f"{a}0", f"{a}0_b"), F.least(f"{a}1", f"{a}1_b")
        gap = lo - hi  # negative where the two overlap on this axis
        mid = (lo + hi) / 2
        p0 = F.when(gap < -OVERLAP, lo + 0.05).when(gap <= OVERLAP, mid - 0.10).otherwise(hi + 0.05)
        p1 = F.when(gap < -OVERLAP, hi - 0.05).when(gap <= OVERLAP, mid + 0.10).otherwise(lo - 0.05)
        b0, b1 = F.greatest(f"{c}0", f"{c}0_b"), F.least(f"{c}1", f"{c}1_b")
        one = pairs.where((gap <= BRIDGE) & (b1 - b0 >= BAND) & (p1 - p0 >= WIDTH))
        names = ("px0", "px1", "py0", "py1") if a == "x" else ("py0", "py1", "px0", "px1")
        one = one.withColumns(dict(zip(names, (p0, p1, b0, b1)))).withColumn("axis", F.lit(a))
        out = one if out is None else out.unionByName(one)
    return out


def bridged_pairs(points: DataFrame, boxes: DataFrame, frame_yaw: float = 0.0) -> DataFrame:
    """(a, b): boxes of one view and direction whose gap holds points nearly as densely as they do themselves."""
    scene = scene_keys(points, boxes)
    turn = F.pmod(F.rint((F.col("yaw") - frame_yaw) / (math.pi / 2)), F.lit(2.0))
    # Corners as columns of a written table: the tests below would else repeat their expressions a hundredfold.
    at = {f"k{i}{a}": v for i, xy in enumerate(corners()) for a, v in zip("xy", xy)}
    wide = boxes.withColumns({"turn": turn, **dict(zip(("x0", "y0", "x1", "y1"), frame_rect())), **at})
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    own = points_in(points, wide.select(*scene, F.col("box_id").alias("key"), F.col("x0").alias("px0"), F.col("x1").alias("px1"), F.col("y0").alias("py0"), F.col("y1").alias("py1")), scene)
    wide = checkpointed(wide.join(own.withColumnRenamed("key", "box_id"), "box_id", "left").withColumn("density", F.coalesce("n", F.lit(0)) / area).drop("n"))
    p = box_pairs(wide, wide, BRIDGE).where("box_id < box_id_b and turn = turn_b")
    p = p.where(sat_gap(named(""), "yaw", named("_b"), "yaw_b") <= BRIDGE)
    if "view" in boxes.columns:
        p = p.where("view <=> view_b")
    if "rect_id" in boxes.columns:
        p = p.where("rect_id is null or rect_id_b is null or rect_id = rect_id_b")
    probes = checkpointed(slabs(p).withColumn("key", F.xxhash64("box_id", "box_id_b", "axis")).select(*scene, "key", "box_id", "box_id_b", "px0", "px1", "py0", "py1", "density", "density_b"))
    n = points_in(points, probes, scene)
    size = (F.col("px1") - F.col("px0")) * (F.col("py1") - F.col("py0"))
    good = probes.join(n, "key").where((F.col("n") >= POINTS) & (F.col("n") / size >= DENSITY * F.least("density", "density_b")))
    return good.select(F.col("box_id").alias("a"), F.col("box_id_b").alias("b")).distinct()


def points_in(points: DataFrame, rects: DataFrame, scene: list[str], cell: float = 1.0) -> DataFrame:
    """key, n: points in each rectangle px0..py1; counted per cell and rectangle before they are summed."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    wide = rects.select(*scene, "key", "px0", "px1", "py0", "py1").withColumn("__i", cells("px0", "px1")).withColumn("__j", cells("py0", "py1"))
    keyed = points.select(*scene, "x", "y").withColumns({"__i": F.floor(F.col("x") / cell), "__j": F.floor(F.col("y") / cell)})
    hit = keyed.join(wide, [*scene, "__i", "__j"]).where(F.col("x").between(F.col("px0"), F.col("px1")) & F.col("y").between(F.col("py0"), F.col("py1")))
    return hit.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def merged_groups(points: DataFrame, boxes: DataFrame, frame_yaw: float = 0.0) -> DataFrame:
    """boxes with group: the smallest id of all boxes joined over bridged gaps; refit the points of a group's rectangle to get its box."""
    return grouped(boxes, checkpointed(bridged_pairs(points, boxes, frame_yaw)))


def grouped(boxes: DataFrame, links: DataFrame) -> DataFrame:
    """boxes with group: the smallest box_id that links (a, b) reach; rounds with a jump to the label's label until nothing changes."""
    both = links.union(links.select("b", "a")).toDF("n", "m")
    labels = checkpointed(boxes.select(F.col("box_id").alias("n"), F.col("box_id").alias("group")))
    while True:
        low = both.join(labels.withColumnRenamed("n", "m"), "m").groupBy("n").agg(F.min("group").alias("low"))
        step = labels.join(low, "n", "left").select("n", F.least("group", F.coalesce("low", "group")).alias("new"), "group")
        jump = step.select(F.col("n").alias("new"), F.col("new").alias("up"))
        after = checkpointed(step.join(jump, "new", "left").select("n", F.least("new", F.coalesce("up", "new")).alias("new"), "group"))
        labels = after.select("n", F.col("new").alias("group"))
        if after.where("new <> group").isEmpty():
            break
    return boxes.join(labels.withColumnRenamed("n", "box_id"), "box_id")
