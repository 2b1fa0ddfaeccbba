"""Aggregates over clouds: frames, floors, spans, principal axes and directions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.geometry import fold_quarter, principal_axis, rotate
from . import spatial
from .neighbours import Tiles, mean_distance, normal_lean
from .spatial import neighbour_cells, places, scene_keys
from .tallies import Box, Near, within


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def quantiles(values: DataFrame, keys: list[str], v: str, shares: list[float], bins: int = 4096, weight: str | None = None) -> DataFrame:
    """keys, q array<double>: exact quantiles (between neighbours in rank by straight line) of v in each group; nulls left out.

    Values are counted in bins of each group's range first; only the bins that hold
    a wanted rank are looked at value by value, and equal values as one.  ``weight``
    names a column that tells how often a row's value counts.
    """
    rows = values.where(F.col(v).isNotNull()).select(*keys, F.col(v).cast("double").alias("__v"), (F.col(weight) if weight else F.lit(1)).alias("__w"), *([] if keys else [F.lit(0).alias("__all")]))
    keys_ = keys or ["__all"]
    stats = rows.groupBy(*keys_).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.sum("__w").alias("__n"))
    at = F.least(F.coalesce(F.floor(F.try_divide(F.col("__v") - F.col("__lo"), F.col("__hi") - F.col("__lo")) * bins), F.lit(0)), F.lit(bins - 1))
    binned = rows.join(stats, keys_).select(*keys_, "__n", "__v", "__w", at.alias("__bin"))
    held = ranked_bins(binned.groupBy(*keys_, "__bin").agg(F.sum("__w").alias("__c")), keys_, shares)
    near = binned.drop("__n").join(held.select(*keys_, "__bin"), [*keys_, "__bin"]).groupBy(*keys_, "__bin", "__v").agg(F.sum("__w").alias("__c"))
    return at_ranks(near, held, keys_, shares).select(*keys, "q")


def _rank(q: float, f: Callable[[Column], Column]) -> Column:
    return f(F.lit(float(q)) * (F.col("__n") - 1)).cast("bigint")


def ranked_bins(counts: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """keys, __bin, __ranks, __n, __from: the bins (of keys, __bin, __c) that hold a rank wanted for ``shares``, and how many values come before."""
    group = Window.partitionBy(*keys)
    running = group.orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumns({"__to": F.sum("__c").over(running), "__n": F.sum("__c").over(group)})
    wanted = F.array_distinct(F.array(*(_rank(q, f) for q in shares for f in (F.floor, F.ceil))))
    held = counts.withColumn("__ranks", F.filter(wanted, lambda r: (r >= F.col("__to") - F.col("__c")) & (r < F.col("__to")))).where(F.size("__ranks") > 0)
    return held.select(*keys, "__bin", "__ranks", "__n", (F.col("__to") - F.col("__c")).alias("__from"))


def at_ranks(near: DataFrame, held: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """keys, q array<double> from the values (keys, __bin, __v, __c) of the bins ``held``."""
    inner = Window.partitionBy(*keys, "__bin").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.join(held, [*keys, "__bin"]).withColumn("__to", F.col("__from") + F.sum("__c").over(inner))
    found = near.select(*keys, "__n", "__v", F.explode(F.filter("__ranks", lambda r: (r >= F.col("__to") - F.col("__c")) & (r < F.col("__to")))).alias("__rank"))
    by_rank = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__m"), F.max("__n").alias("__n"))

    def value(q: float):
        exact = F.lit(float(q)) * (F.col("__n") - 1)
        low, high = F.col("__m")[_rank(q, F.floor)], F.col("__m")[_rank(q, F.ceil)]
        part = exact - F.floor(exact)
        return F.when(low == high, low).otherwise((1 - part) * low + part * high)

    return by_rank.select(*keys, F.array(*(value(q) for q in shares)).alias("q"))


def box_quantiles(points: DataFrame, boxes: DataFrame, axes: dict[str, str], shares: list[float], inner: Callable = within, asked: Callable[[Column], Column] | None = None, bins: int = 256) -> DataFrame:
    """box_id, n, top and q_<axis> array<double>: how many points ``inner(box, points)`` takes of each box, their largest k, and exact quantiles along ``axes`` (axis -> its size).

    Points are counted in bins of each box first, where they are; a second pass over the
    points gives the values of the bins that hold a wanted rank.  ``asked`` (of n) tells the boxes
    whose quantiles are wanted; the others' are null.
    """
    from .rects import checkpointed

    names = list(axes.items())
    at = lambda b, p, hit, axis, size: np.clip(np.floor((getattr(p, axis)[hit] / getattr(b, size) + 0.5) * bins), 0, bins - 1).astype(np.int64)

    def count(b: Box, p: Near):
        if not len(hit := inner(b, p)):
            return None
        of = [np.bincount(at(b, p, hit, *x), minlength=bins) for x in names]
        found = [np.flatnonzero(n) for n in of]
        part = np.repeat(np.arange(len(names)), [len(f) for f in found])
        return part, np.concatenate(found), np.concatenate([n[f] for n, f in zip(of, found)]), np.full(len(part), p.k[hit].max())

    def values(b: Box, p: Near):
        hit = inner(b, p)
        out = []
        for i, (axis, size) in enumerate(names):
            own = at(b, p, hit, axis, size)
            wanted = np.zeros(bins, bool)
            wanted[[x["__bin"] for x in b.more["__wanted"] if x["part"] == i]] = True
            keep = wanted[own]
            out.append((np.full(np.count_nonzero(keep), i), own[keep], getattr(p, axis)[hit[keep]]))
        return tuple(map(np.concatenate, zip(*out)))

    near = spatial.near_points
    counts = checkpointed(near(points, boxes, tally=count, ddl="part int, __bin int, n bigint, top double").groupBy("box_id", "part", "__bin").agg(F.sum("n").alias("__c"), F.max("top").alias("top")))
    sizes = counts.where("part = 0").groupBy("box_id").agg(F.sum("__c").alias("n"), F.max("top").alias("top"))
    some = sizes.where(asked(F.col("n"))) if asked else sizes
    key = ["box_id", "part"]
    held = checkpointed(ranked_bins(counts.join(some.select("box_id"), "box_id", "left_semi").drop("top"), key, shares))
    wanted = boxes.join(held.groupBy("box_id").agg(F.collect_list(F.struct("part", "__bin")).alias("__wanted")), "box_id")
    found = near(points, wanted, tally=values, ddl="part int, __bin int, __v double", more=("__wanted",)).groupBy(*key, "__bin", "__v").agg(F.count(F.lit(1)).alias("__c"))
    q = at_ranks(found, held, key, shares).groupBy("box_id").agg(*(F.max(F.when(F.col("part") == i, F.col("q"))).alias(f"q_{axis}") for i, (axis, _) in enumerate(names)))
    return sizes.join(q, "box_id", "left")


def cloud_summary(points: DataFrame) -> DataFrame:
    """One row: size, bounds, height percentiles, share in the device band, distinct 0.1 m columns."""
    voxels = points.select(F.floor(F.col("x") / 0.1).alias("i"), F.floor(F.col("y") / 0.1).alias("j")).distinct().agg(F.count(F.lit(1)).alias("xy_voxels"))
    row = points.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))), share((F.col("z") > 0.5) & (F.col("z") < 2.4)).alias("band_share"))
    row = row.crossJoin(quantiles(points, [], "z", [0.01, 0.10, 0.50, 0.90, 0.99]))  # one row each
    row = row.select("n", *(f"{n}_{c}" for c in "xyz" for n in ("min", "max")), *(F.col("q")[i].alias(f"z_p{p}") for i, p in enumerate((1, 10, 50, 90, 99))), "band_share")
    return row.crossJoin(voxels)  # one row each


def support_summary(support: DataFrame) -> DataFrame:
    """Smallest, upper median and largest support."""
    ends = support.agg(F.count(F.lit(1)).alias("n"), F.min("support").alias("min_support"), F.max("support").alias("max_support"))
    # The upper median is the value of rank n div 2; counts per value are ranked by prefix sums over value ranges.
    middle = ranked_values(support, "support", F.floor(F.col("n") / 2))
    return ends.crossJoin(middle).select("min_support", F.col("value").alias("median_support"), "max_support")


def ranked_values(values: DataFrame, v: str, rank: Column, weight: Column | None = None, parts: int = 64) -> DataFrame:
    """One row (value): the smallest value with a running weight (or count) beyond ``rank``, a column over n, the total.

    Values fall into ``parts`` ranges; ranges are summed first, so the running sum
    is taken over a single range.
    """
    w = F.lit(1.0) if weight is None else weight
    rows = values.where(F.col(v).isNotNull()).select(F.col(v).alias("value"), w.cast("double").alias("w")).groupBy("value").agg(F.sum("w").alias("w"))
    ends = rows.agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("w").alias("n"))
    part = F.least(F.coalesce(F.floor(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")) * parts), F.lit(0)), F.lit(parts - 1))
    keyed = rows.crossJoin(F.broadcast(ends)).withColumn("part", part)  # one row of ends
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = keyed.groupBy("part").agg(F.sum("w").alias("s"), F.max("n").alias("n"))  # at most ``parts`` rows
    held = sums.withColumn("to", F.sum("s").over(order)).where(F.col("to") > rank).orderBy("part").limit(1).select("part", (F.col("to") - F.col("s")).alias("before"))
    inside = keyed.join(F.broadcast(held), "part").withColumn("run", F.col("before") + F.sum("w").over(Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return inside.where(F.col("run") > rank).agg(F.min("value").alias("value"))


def floor_tiles(points: DataFrame, grid: float = C.FLOOR_GRID, band: float = C.FLOOR_BAND, least: int = C.FLOOR_MIN_POINTS) -> DataFrame:
    """(scene_id,) i, j, n_low, floor_z: the second percentile of each tile's points near its scene's floor, which fills tiles with few."""
    scene = scene_keys(points)
    base = quantiles(points, scene, "z", [0.02]).select(*scene, F.col("q")[0].alias("base"))
    tile = points.select(*scene, F.floor(F.col("x") / grid).alias("i"), F.floor(F.col("y") / grid).alias("j"), "z")
    tile = tile.join(base, scene) if scene else tile.crossJoin(F.broadcast(base))  # without scenes the base is one row
    low = F.col("z") <= F.col("base") + band
    agg = tile.groupBy(*scene, "i", "j").agg(F.sum(low.cast("bigint")).alias("n_low"), F.percentile(F.when(low, F.col("z")), F.lit(0.02)).alias("q"), F.max("base").alias("base"))
    return agg.select(*scene, "i", "j", "n_low", F.when(F.col("n_low") >= least, F.col("q")).otherwise(F.col("base")).alias("floor_z"))


def mesh_floor_tiles(points: DataFrame) -> DataFrame:
    """(scene_id,) i, j, floor_z: lowest point of each fine tile, where enough points are and it is not far above the base; else the coarse tile's."""
    scene = scene_keys(points)
    base = quantiles(points, scene, "z", [0.02]).select(*scene, F.col("q")[0].alias("base"))
    fine = points.groupBy(*scene, F.floor(F.col("x") / C.MESH_FLOOR_GRID).alias("i"), F.floor(F.col("y") / C.MESH_FLOOR_GRID).alias("j")).agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("low"), F.min("x").alias("ax"), F.min("y").alias("ay"))
    fine = fine.join(base, scene) if scene else fine.crossJoin(F.broadcast(base))  # without scenes the base is one row
    coarse = floor_tiles(points).select(*scene, F.col("i").alias("ci"), F.col("j").alias("cj"), F.col("floor_z").alias("coarse"))
    keyed = fine.withColumns({"ci": F.floor(F.col("ax") / C.FLOOR_GRID), "cj": F.floor(F.col("ay") / C.FLOOR_GRID)})
    ok = (F.col("n") >= C.MESH_FLOOR_MIN_POINTS) & (F.col("low") <= F.col("base") + C.MESH_FLOOR_BAND)
    return keyed.join(coarse, [*scene, "ci", "cj"], "left").select(*scene, "i", "j", F.when(ok, F.col("low")).otherwise(F.coalesce("coarse", "base")).alias("floor_z"))


def height_above_floor(points: DataFrame, tiles: DataFrame, grid: float = C.FLOOR_GRID) -> DataFrame:
    """points with h: height above the floor of their tile."""
    keyed = points.withColumns({"i": F.floor(F.col("x") / grid), "j": F.floor(F.col("y") / grid)})
    scene = scene_keys(points, tiles)
    return keyed.join(tiles.select(*scene, "i", "j", "floor_z"), [*scene, "i", "j"], "left").withColumn("h", F.col("z") - F.col("floor_z")).drop("i", "j")


def floor_at_local(points: DataFrame, tiles: DataFrame, yaw: float, grid: float = C.FLOOR_GRID) -> DataFrame:
    """points of a frame turned by -yaw, with floor_z: the floor of the tile below each in the world's frame."""
    x, y = rotate("x", "y", yaw)
    scene = scene_keys(points, tiles)
    keyed = points.withColumns({"i": F.floor(x / grid), "j": F.floor(y / grid)})
    return keyed.join(tiles.select(*scene, "i", "j", "floor_z"), [*scene, "i", "j"], "left").drop("i", "j")


def layout_frame(points: DataFrame, yaw: float) -> DataFrame:
    """Bounds of the cloud turned by -yaw."""
    x, y = rotate("x", "y", -yaw)
    return points.select(x.alias("x"), y.alias("y")).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def grounding_frame(points: DataFrame, yaw: float) -> DataFrame:
    """First to last percentile of the cloud turned by -yaw."""
    x, y = rotate("x", "y", -yaw)
    turned = points.select(x.alias("x"), y.alias("y"))
    row = quantiles(turned, [], "x", [0.01, 0.99]).toDF("qx").crossJoin(quantiles(turned, [], "y", [0.01, 0.99]).toDF("qy"))  # one row each
    return row.selectExpr("qx[0] x0", "qy[0] y0", "qx[1] x1", "qy[1] y1")


def tile_frames(layout: DataFrame) -> DataFrame:
    """Overlapping tiles of a layout rectangle x0, y0, x1, y1: tx, ty and their bounds."""
    def starts(lo: str, hi: str, name: str) -> Column:
        span = F.col(hi) - F.col(lo)
        n = F.greatest(F.ceil((span - C.TILE_OVERLAP) / (C.TILE_SPAN - C.TILE_OVERLAP)), F.lit(1).cast("bigint"))
        return F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda k: F.struct(k.alias("k"), n.alias("n"), span.alias("span")))).alias(name)

    out = layout.select("*", starts("x0", "x1", "a")).select("*", starts("y0", "y1", "b"))

    def bounds(lo: str, s: str) -> tuple[Column, Column]:
        n, k, span = F.col(f"{s}.n"), F.col(f"{s}.k"), F.col(f"{s}.span")
        size = (span + (n - 1) * C.TILE_OVERLAP) / n
        start = F.col(lo) + k * (size - C.TILE_OVERLAP)
        return start, start + size

    (ax, bx), (ay, by) = bounds("x0", "a"), bounds("y0", "b")
    return out.select(F.col("a.k").alias("tx"), F.col("b.k").alias("ty"), ax.alias("tx0"), ay.alias("ty0"), bx.alias("tx1"), by.alias("ty1"))


def robust_span(values: DataFrame, key: str, v: str, cell: float = C.SPAN_CELL, strong: float = C.SPAN_STRONG, floor: int = C.SPAN_FLOOR) -> DataFrame:
    """key, lo, hi: from the first to the last bin that holds at least max(strong * peak, floor) values.

    Bins start at each group's minimum; counts are taken per bin before groups are looked at.
    """
    low = values.groupBy(key).agg(F.min(v).alias("low"))
    bins = values.join(low, key).groupBy(key, "low", F.floor((F.col(v) - F.col("low")) / cell).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    peaks = bins.groupBy(key).agg(F.max("n").alias("peak"))
    good = bins.join(peaks, key).where(F.col("n") >= F.greatest(strong * F.col("peak"), F.lit(float(floor))))
    return good.groupBy(key).agg((F.min(F.col("low") + F.col("bin") * cell)).alias("lo"), F.max(F.col("low") + (F.col("bin") + 1) * cell).alias("hi"))


def side_supported_span(values: DataFrame, key: str, v: str, lo: float, hi: float, cell: float = C.SPAN_CELL, least: int = C.SIDE_MIN_POINTS) -> DataFrame:
    """key, lo, hi: extreme values inside bins of [lo, hi] that hold at least ``least`` values."""
    bins = values.where(F.col(v).between(lo, hi)).groupBy(key, F.floor((F.col(v) - lo) / cell).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("a"), F.max(v).alias("b"))
    return bins.where(F.col("n") >= least).groupBy(key).agg(F.min("a").alias("lo"), F.max("b").alias("hi"))


def voxel_means(points: DataFrame, voxel: float = 0.25) -> DataFrame:
    """i, j, n and mean x, y of the points (or places with __n) of each column of the grid."""
    if "__n" in points.columns:
        mean = lambda c: F.sum(F.col(c) * F.col("__n")) / F.sum("__n")
        return points.groupBy(F.floor(F.col("x") / voxel).alias("i"), F.floor(F.col("y") / voxel).alias("j")).agg(F.sum("__n").alias("n"), mean("x").alias("mx"), mean("y").alias("my"))
    return points.groupBy(F.floor(F.col("x") / voxel).alias("i"), F.floor(F.col("y") / voxel).alias("j")).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"))


def device_band(points: DataFrame, low: float = 0.4, high: float = 2.5) -> DataFrame:
    return points.where((F.col("z") > low) & (F.col("z") < high))


def principal_yaw(cells: DataFrame, x="mx", y="my") -> DataFrame:
    """One row: direction of the major axis modulo 90 degrees."""
    row = cells.agg(F.var_samp(x).alias("a"), F.var_samp(y).alias("c"), F.covar_samp(x, y).alias("b"))
    return row.select(fold_quarter(principal_axis("a", "c", "b")).alias("yaw"))


def axis_votes(boxes_points: DataFrame, current: float, least: int = 150, min_length: float = 2.0) -> DataFrame:
    """box_id, n, delta: each box's major axis against the current direction, modulo 90 degrees."""
    rows = boxes_points.groupBy("box_id").agg(F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("a"), F.var_pop("y").alias("c"), F.covar_pop("x", "y").alias("b"), F.max(F.greatest("sl", "sw")).alias("long"))
    delta = fold_quarter(principal_axis("a", "c", "b") - current)
    return rows.where((F.col("n") >= least) & (F.col("long") >= min_length)).select("box_id", "n", delta.alias("delta"))


def weighted_median(votes: DataFrame, value: str, weight: str) -> DataFrame:
    """One row: the smallest value at which the running weight reaches half of the total; needs two votes."""
    n = votes.agg(F.count(F.lit(1)).alias("votes"))
    # Reaching half, not passing it: the running weight lies beyond half less a hair of the total.
    found = ranked_values(votes, value, F.col("n") * (0.5 - 1e-12), F.col(weight))
    return found.crossJoin(n).select(F.when(F.col("votes") >= 2, F.col("value")).alias(value))  # one row each


def neighbour_pairs(cells: DataFrame, reach: float) -> DataFrame:
    """dx, dy, d of all pairs of cell means within ``reach``, each pair once."""
    cell = reach
    keyed = cells.select("mx", "my", F.floor(F.col("mx") / cell).alias("gi"), F.floor(F.col("my") / cell).alias("gj"), F.struct("i", "j").alias("id"))
    around = neighbour_cells(keyed.select(F.col("mx").alias("bx"), F.col("my").alias("by"), "gi", "gj", F.col("id").alias("bid")), ["gi", "gj"])
    pairs = keyed.join(around, ["gi", "gj"]).where("id < bid").withColumns({"dx": F.round(F.col("bx") - F.col("mx"), 9), "dy": F.round(F.col("by") - F.col("my"), 9)})
    return pairs.withColumn("d", F.hypot("dx", "dy")).where(F.col("d") <= reach)


def pair_angle_histogram(cells: DataFrame, reach: float = 0.55, bins: int = 90) -> DataFrame:
    """bin, w: distance-weighted directions of pairs of cell means within ``reach``, smoothed over five bins of a circle.

    Offsets are rounded to nanometres, so that pairs along an axis fall into one bin however their means were summed.
    """
    pairs = neighbour_pairs(cells, reach)
    angle = F.pmod(F.atan2("dy", "dx"), F.lit(math.pi / 2))
    raw = pairs.groupBy(F.least(F.floor(angle / (math.pi / 2) * bins), F.lit(bins - 1)).alias("bin")).agg(F.sum("d").alias("w"))
    spread = raw.select(F.explode(F.array(*(F.struct(F.pmod(F.col("bin") + d, F.lit(bins)).alias("bin"), (F.col("w") * k / 9.0).alias("w")) for d, k in ((-2, 1), (-1, 2), (0, 3), (1, 2), (2, 1))))).alias("s"))
    return spread.groupBy("s.bin").agg(F.sum("s.w").alias("w"))


def thick_points(points: DataFrame, voxel: float = C.THIN_VOXEL, least: int = C.THIN_MIN_NEIGHBOURS) -> DataFrame:
    """Points whose voxel is, or touches, one with at least ``least`` of 26 occupied neighbours."""
    key = {k: F.floor(F.col(c) / voxel) for k, c in zip("ijk", "xyz")}
    keyed = points.withColumns(key)
    occupied = keyed.select("i", "j", "k").distinct()
    around = neighbour_cells(occupied, ["i", "j", "k"]).groupBy("i", "j", "k").agg((F.count(F.lit(1))).alias("n"))
    thick = around.join(occupied, ["i", "j", "k"], "left_semi").where(F.col("n") - 1 >= least).select("i", "j", "k")
    keep = neighbour_cells(thick, ["i", "j", "k"]).select("i", "j", "k").distinct()
    return keyed.join(keep, ["i", "j", "k"], "left_semi").select(*points.columns)


def floor_spike(points: DataFrame, cell: float = 0.05) -> DataFrame:
    """One row (for each scene): median height around the strongest smoothed bin of the lowest quarter, if it stands out, else the second percentile."""
    scene = scene_keys(points)
    key = scene or ["__all"]
    rows = points.select(*scene, "z", *([] if scene else [F.lit(0).alias("__all")]))
    q = quantiles(rows, key, "z", [0.02, 0.25]).join(rows.groupBy(*key).agg(F.min("z").alias("low")), key).select(*key, F.col("q")[0].alias("q2"), F.col("q")[1].alias("q25"), "low")
    low = rows.join(q, key).where("z <= q25")
    bins = low.groupBy(*key, F.floor((F.col("z") - F.col("low")) / cell).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spread = bins.select(*key, F.explode(F.array(*(F.struct((F.col("bin") + d).alias("bin"), (F.col("n") * k / 4.0).alias("w")) for d, k in ((-1, 1), (0, 2), (1, 1))))).alias("s")).groupBy(*key, "s.bin").agg(F.sum("s.w").alias("w"))
    top = spread.join(bins.select(*key, "bin"), [*key, "bin"], "left_semi").groupBy(*key).agg(F.max(F.struct("w", (-F.col("bin")).alias("b"))).alias("m"), F.median("w").alias("mid"))
    pick = q.join(top, key).select(*key, "q2", "low", F.col("m.w").alias("w"), (-F.col("m.b")).alias("bin"), "mid")
    at = F.col("low") + F.col("bin") * cell
    near = rows.join(pick, key).where((F.col("z") >= at - 0.05) & (F.col("z") <= at + 0.15))
    middle = quantiles(near, key, "z", [0.5]).select(*key, F.col("q")[0].alias("spike"))
    out = pick.join(middle, key, "left")
    return out.select(*scene, F.when(F.col("w") >= F.greatest(F.lit(50.0), 2 * F.col("mid")), F.col("spike")).otherwise(F.col("q2")).alias("floor_z"))


# Neighbours


def nearest(pieces: DataFrame, tiles: Tiles, measure: Callable, cell: float | None = None) -> DataFrame:
    """(scene_id,) x, y, z, __n, v, r: what ``measure`` finds of the k nearest points of each place, in the tile that holds it.

    Exact: cells of a tile widen until the k nearest are certain; where they may lie
    beyond what the tile holds, r tells how far to look (``Tiles.neighbours``).
    """
    return tiles.measured(pieces, measure, cell)


def nearest_distances(points: DataFrame, k: int = 20, cell: float | None = None) -> DataFrame:
    """(scene_id,) x, y, z of each place with __n, its points, and mean_d: their mean distance to the k nearest points, the point itself counted as one at 0 (null without others, and where a coordinate is missing).

    ``cell`` is the width of cells that is tried first.
    """
    from .rects import written

    tiles = Tiles(points, k)
    place = [*tiles.scene, "x", "y", "z", "__n"]
    found = written(nearest(tiles.pieces(), tiles, mean_distance, cell))
    rest = places(points.where(f"not ({tiles.known})")).select(*place, F.lit(None).cast("double").alias("mean_d"))
    open_ = found.where("r is not null")
    if not open_.isEmpty():
        sums = tiles.neighbours(open_).groupBy(*tiles.scene, "x", "y", "z").agg(F.sum(F.col("d") * F.col("__t")).alias("__d"), F.sum("__t").alias("__t"))
        mean = F.when(F.col("__t").isNotNull(), F.col("__d") / (F.col("__t") + F.col("__n"))).when(F.col("__n") > 1, F.lit(0.0))
        rest = rest.unionByName(open_.select(*place).join(sums, place[:-1], "left").select(*place, mean.alias("mean_d")))
    return found.where("r is null").select(*place, F.col("v").alias("mean_d")).unionByName(written(rest))


def upright(points: DataFrame, k: int = 20, most: float = 0.5, cell: float | None = None) -> DataFrame:
    """Places (with __n) on upright surfaces: the normal of the k nearest points (itself included) leans less than ``most`` towards z."""
    from .rects import written

    tiles = Tiles(points, k)
    place = [*tiles.scene, "x", "y", "z"]
    # Where all points are one place, the normal is the first axis by rule.
    found = written(nearest(tiles.pieces(), tiles, normal_lean, cell).where((F.col("v") < most) | F.col("r").isNotNull()))
    sure, open_ = found.where("r is null").select(*place, "__n"), found.where("r is not null")
    if open_.isEmpty():
        return sure
    off = tiles.neighbours(open_).select(*place, "__n", "__t", *((F.col(f"{a}2") - F.col(a)).alias(f"d{a}") for a in "xyz"))
    # Moments of the offsets from the place, where its own points have none.
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    sums = off.groupBy(*place).agg((F.sum("__t") + F.max("__n")).alias("w"), *(F.sum(F.col("__t") * F.col(f"d{a}")).alias(f"m{a}") for a in "xyz"), *(F.sum(F.col("__t") * F.col(f"d{a}") * F.col(f"d{b}")).alias(a + b) for a, b in pairs))
    cov = sums.select(*place, *((F.col(a + b) / F.col("w") - F.col(f"m{a}") / F.col("w") * F.col(f"m{b}") / F.col("w")).alias(a + b) for a, b in pairs))

    @F.pandas_udf("double")
    def lean(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.Series:
        m = np.stack([np.stack(r, -1) for r in ((xx, xy, xz), (xy, yy, yz), (xz, yz, zz))], -2)
        return pd.Series(np.abs(np.linalg.eigh(m)[1][:, 2, 0]))

    leans = open_.select(*place, "__n").join(cov.select(*place, lean("xx", "xy", "xz", "yy", "yz", "zz").alias("lean")), place, "left")
    return sure.unionByName(written(leans.where(F.coalesce("lean", F.lit(0.0)) < most).select(*place, "__n")))


def hash_sample(points: DataFrame, most: int, columns=("x", "y", "z")) -> DataFrame:
    """About ``most`` points, the same in every run: those whose hash falls into the share that is needed."""
    n = points.count()
    if n <= most:
        return points
    return points.where(F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def denoised(points: DataFrame, k: int = 20, ratio: float = 2.0, cell: float | None = None, least: int = 1000, least_kept: int = 100) -> DataFrame:
    """Points whose mean neighbour distance is below the scene's mean plus ``ratio`` standard deviations.

    Scenes of fewer than ``least`` points, and those that would keep fewer than
    ``least_kept``, stay as they are.
    """
    place = [*scene_keys(points), "x", "y", "z"]
    return points.join(denoised_places(points, k, ratio, cell, least, least_kept).select(*place), place, "left_semi").select(*points.columns)


def denoised_places(points: DataFrame, k: int = 20, ratio: float = 2.0, cell: float | None = None, least: int = 1000, least_kept: int = 100) -> DataFrame:
    """(scene_id,) x, y, z of the places that ``denoised`` keeps, with __n, their points; where only sums over points are wanted, they need not be joined back."""
    scene = scene_keys(points)
    key = scene or ["__all"]
    near = nearest_distances(points, k, cell)
    near = near if scene else near.withColumn("__all", F.lit(0))
    # Without scenes the sums are one row; a join on a constant would send all places to one task.
    beside = lambda a, b: a.join(b, key) if scene else a.crossJoin(F.broadcast(b.drop("__all")))
    found = near.where("mean_d is not null")
    means = found.groupBy(*key).agg((F.sum(F.col("mean_d") * F.col("__n")) / F.sum("__n")).alias("__m"), F.sum("__n").alias("__d"))
    off = beside(found, means).groupBy(*key).agg(F.sqrt(F.sum((F.col("mean_d") - F.col("__m")) ** 2 * F.col("__n")) / F.when(F.max("__d") > 1, F.max("__d") - 1)).alias("__s"))
    sizes = near.groupBy(*key).agg(F.sum("__n").alias("__all_n"))
    marked = beside(near, sizes.join(means, key, "left").join(off, key, "left")).withColumn("__keep", F.col("mean_d") < F.col("__m") + ratio * F.col("__s"))
    kept = marked.groupBy(*key).agg(F.sum(F.when(F.col("__keep"), F.col("__n"))).alias("__kept"))
    raw = (F.col("__all_n") < least) | (F.coalesce("__kept", F.lit(0)) < least_kept)
    place = [*scene, "x", "y", "z"]
    known = " and ".join(f"{c} is not null" for c in place)
    return beside(marked, kept).where(raw | F.col("__keep")).where(known).select(*place, "__n")
