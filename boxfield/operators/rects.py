"""Rectangles of image views: overlap rules, chains of repeated rectangles, images as pixel tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.geometry import rect_covered, rect_inside, rect_overlap

SIDES = ("x0", "y0", "x1", "y1")


def rect(suffix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(s + suffix) for s in SIDES)


def huge(width: float, height: float, share: float = C.MAX_RECT_SHARE) -> Column:
    a = rect()
    return (a[2] - a[0]) * (a[3] - a[1]) > share * width * height


def pairs(rects: DataFrame, cell: float = 64.0) -> DataFrame:
    """Touching rectangles of a view, both orders, the other's columns with ``_b``; joined on shared grid cells."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    a = rects.withColumn("__i", cells("x0", "x1")).withColumn("__j", cells("y0", "y1"))
    b = a.select("view_id", "__i", "__j", *(F.col(c).alias(c + "_b") for c in ("rect_id", *SIDES)))
    first = (F.floor(F.greatest("x0", "x0_b") / cell) == F.col("__i")) & (F.floor(F.greatest("y0", "y0_b") / cell) == F.col("__j"))
    return a.join(b, ["view_id", "__i", "__j"]).where((F.col("rect_id") != F.col("rect_id_b")) & first).drop("__i", "__j")


def covered(rects: DataFrame) -> DataFrame:
    """Pairs where the first rectangle counts as covered by the second."""
    return pairs(rects).where(rect_covered(rect(), rect("_b")))


def nested(rects: DataFrame) -> DataFrame:
    """Pairs where the second rectangle lies in the first."""
    return pairs(rects).where(rect_inside(rect(), rect("_b")))


def covered_share(rects: DataFrame, steps: int = 20) -> DataFrame:
    """view_id, rect_id, share: part of a grid over each rectangle that lies in any other of its view."""
    at = lambda lo, hi, k: F.col(lo) + (F.col(hi) - F.col(lo)) * F.lit(k + 0.5) / steps
    bits = lambda lo, hi: sum((F.when(at(lo, hi, k).between(F.col(f"{lo}_b"), F.col(f"{hi}_b")), F.lit(1 << k)).otherwise(F.lit(0)) for k in range(steps)), F.lit(0).cast("bigint"))
    # Another rectangle covers whole columns by whole rows of the grid, so a row is a number of bits; numbers of all others are joined by or.
    others = pairs(rects).select("view_id", "rect_id", bits("x0", "x1").alias("across"), bits("y0", "y1").alias("down"))
    n = others.groupBy("view_id", "rect_id").agg(*(F.bit_or(F.when(F.col("down").bitwiseAND(F.lit(1 << k)) != 0, F.col("across")).otherwise(F.lit(0).cast("bigint"))).alias(f"r{k}") for k in range(steps)))
    n = n.select("view_id", "rect_id", sum((F.bit_count(f"r{k}") for k in range(1, steps)), F.bit_count("r0")).alias("n"))
    return rects.join(n, ["view_id", "rect_id"], "left").select("view_id", "rect_id", (F.coalesce("n", F.lit(0)) / float(steps * steps)).alias("share"))


def chain_links(rects: DataFrame, axis: str) -> DataFrame:
    """view_id, a, b: neighbours in a row (axis x) or column (axis y) of alike rectangles."""
    lo, hi = ("x0", "x1") if axis == "x" else ("y0", "y1")
    clo, chi = ("y0", "y1") if axis == "x" else ("x0", "x1")
    a = rects.select("view_id", F.col("rect_id").alias("a"), *(F.col(c).alias(f"{n}_a") for n, c in (("lo", lo), ("hi", hi), ("clo", clo), ("chi", chi))))
    b = rects.select("view_id", F.col("rect_id").alias("b"), *(F.col(c).alias(f"{n}_b") for n, c in (("lo", lo), ("hi", hi), ("clo", clo), ("chi", chi))))
    size = lambda t: F.col(f"hi_{t}") - F.col(f"lo_{t}")
    cross = lambda t: F.col(f"chi_{t}") - F.col(f"clo_{t}")
    j = a.join(b, "view_id").where("a < b")
    least_cross = F.least(cross("a"), cross("b"))
    overlap = F.least("chi_a", "chi_b") - F.greatest("clo_a", "clo_b")
    gap = F.greatest("lo_a", "lo_b") - F.least("hi_a", "hi_b")
    small = F.least(size("a"), size("b"))
    return j.where(
        (F.abs(cross("a") - cross("b")) <= C.CHAIN["cross_size"] * least_cross)
        & (overlap >= C.CHAIN["cross_overlap"] * least_cross)
        & (F.abs(size("a") - size("b")) <= C.CHAIN["along_size"] * F.greatest(size("a"), size("b")))
        & (gap >= -C.CHAIN["gap_back"] * small) & (gap <= C.CHAIN["gap_ahead"] * small)
    ).select("view_id", "a", "b")


def chain_members(rects: DataFrame, axis: str) -> DataFrame:
    """view_id, rect_id, chain: components of at least three linked rectangles, named by their smallest id.

    Labels are minima over neighbours with a jump to the label's label in every
    round; each round is checkpointed and the rounds end when nothing changes.
    """
    links = chain_links(rects, axis)
    both = links.select("view_id", F.col("a").alias("n"), F.col("b").alias("m")).union(links.select("view_id", F.col("b"), F.col("a"))).persist()
    labels = both.select("view_id", F.col("n").alias("rect_id")).distinct().withColumn("chain", F.col("rect_id"))
    while True:
        near = both.join(labels.select("view_id", F.col("rect_id").alias("m"), F.col("chain").alias("c")), ["view_id", "m"]).groupBy("view_id", F.col("n").alias("rect_id")).agg(F.min("c").alias("c"))
        moved = labels.join(near, ["view_id", "rect_id"]).select("view_id", "rect_id", F.least("chain", "c").alias("chain"), F.col("chain").alias("old"))
        jump = moved.select("view_id", F.col("rect_id").alias("chain"), F.col("chain").alias("up"))
        after = checkpointed(moved.join(jump, ["view_id", "chain"], "left").select("view_id", "rect_id", F.least("chain", F.coalesce("up", "chain")).alias("chain"), "old"))
        labels = after.drop("old")
        if after.where("chain <> old").isEmpty():
            break
    both.unpersist()
    size = F.count(F.lit(1)).over(Window.partitionBy("view_id", "chain"))
    return labels.withColumn("members", size).where(F.col("members") >= C.CHAIN["least"])


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that the cluster names; only on one machine (tests) a folder is made up."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` written as columns in the same folder: a fraction of a checkpoint's size, for tables as large as a cloud."""
    path = f"{checkpoint_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            base = tempfile.mkdtemp(prefix="boxfield-")
        sc.setCheckpointDir(base)
    return sc.getCheckpointDir()


def chain_scores(rects: DataFrame, members: DataFrame, axis: str, other: DataFrame, width: float, height: float) -> DataFrame:
    """view_id, chain, score and its parts for every chain of an axis; ``other`` holds the chains of the other axis."""
    lo, hi, clo, chi = ("x0", "x1", "y0", "y1") if axis == "x" else ("y0", "y1", "x0", "x1")
    pinned = ((F.col("x0") <= 0.5) | (F.col("y0") <= 0.5) | (F.col("x1") >= width - 0.5) | (F.col("y1") >= height - 0.5)).cast("int")
    on_other = other.select("view_id", "rect_id").distinct().withColumn("o", F.lit(1))
    rows = members.join(rects, ["view_id", "rect_id"]).join(on_other, ["view_id", "rect_id"], "left")
    order = Window.partitionBy("view_id", "chain").orderBy(F.col(lo) + F.col(hi), "rect_id")
    rows = rows.withColumns({"size": F.col(hi) - F.col(lo), "cross": F.col(chi) - F.col(clo), "gap": F.lead(lo).over(order) - F.col(hi)})
    mid = rows.groupBy("view_id", "chain").agg(F.median("size").alias("ms"), F.median("cross").alias("mc"))
    rows = rows.join(mid, ["view_id", "chain"])
    g = rows.groupBy("view_id", "chain").agg(
        F.count(F.lit(1)).alias("n"), F.max("ms").alias("ms"), F.max("mc").alias("mc"), F.max(F.abs(F.col("cross") - F.col("mc"))).alias("dev"),
        (F.max(clo) - F.min(clo)).alias("slo"), (F.max(chi) - F.min(chi)).alias("shi"), F.avg((F.col("gap") <= 0.12 * F.col("ms")).cast("double")).alias("adjacency"),
        F.max(F.abs("gap")).alias("maxabs"), (F.max(F.abs("gap")) - F.min(F.abs("gap"))).alias("spread"), F.median(F.abs("gap")).alias("midgap"), F.sum(pinned).alias("pinned"), F.avg(F.coalesce("o", F.lit(0)).cast("double")).alias("grid"),
    )
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    parts = {
        "count": F.least(F.col("n") / 5.0, F.lit(1.0)),
        "size": clip(1 - F.col("dev") / F.col("mc") / 0.30),
        "align": clip(1 - F.greatest("slo", "shi") / F.col("mc") / 0.40),
        "adjacency": F.col("adjacency"),
        "periodic": F.when(F.col("maxabs") < 1e-6, 1.0).otherwise(clip(1 - F.col("spread") / F.greatest(0.30 * F.col("midgap"), F.lit(1e-6)))),
        "oob": F.least(F.col("pinned") / 2.0, F.lit(1.0)),
        "grid": F.col("grid"),
    }
    rounded = {k: F.round(v, 3) for k, v in parts.items()}
    total = sum((rounded[k] * w for k, w in list(C.CHAIN_WEIGHTS.items())[1:]), rounded["count"] * C.CHAIN_WEIGHTS["count"]) / sum(C.CHAIN_WEIGHTS.values())
    return g.select("view_id", "chain", F.col("n").alias("members"), *(v.alias(f"s_{k}") for k, v in rounded.items()), total.alias("score"))


def without_repeats(rects: DataFrame, width: float = 1280.0, height: float = 1024.0) -> DataFrame:
    """Rectangles outside chains that score like invented repetition: columns from 0.42, rows from 0.75."""
    found = {a: chain_members(rects, a) for a in ("x", "y")}
    bad = None
    for a, o, limit in (("y", "x", C.CHAIN_DROP_Y), ("x", "y", C.CHAIN_DROP_X)):
        scores = chain_scores(rects, found[a], a, found[o], width, height).where(F.col("score") >= limit)
        rows = found[a].join(scores, ["view_id", "chain"], "left_semi").select("view_id", "rect_id")
        bad = rows if bad is None else bad.union(rows)
    return rects.join(bad.distinct(), ["view_id", "rect_id"], "left_anti")


# Images as pixel tables


def edge_energy(pixels: DataFrame) -> DataFrame:
    """view_id, coverage, energy: bright share, and mean squared differences along rows plus along columns."""
    across = F.col("lum") - F.lag("lum").over(Window.partitionBy("view_id", "py").orderBy("px"))
    down = F.col("lum") - F.lag("lum").over(Window.partitionBy("view_id", "px").orderBy("py"))
    rows = pixels.withColumns({"dx": across, "dy": down})
    return rows.groupBy("view_id").agg(F.avg((F.col("lum") > 0.10).cast("double")).alias("coverage"), (F.avg(F.col("dx") * F.col("dx")) + F.avg(F.col("dy") * F.col("dy"))).alias("energy"))


def view_quality(pixels: DataFrame) -> DataFrame:
    return edge_energy(pixels).withColumn("good", (F.col("coverage") >= 0.02) & (F.col("energy") >= 1e-5))


def mask_fit(pixels: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """view_id, inside, outside, coverage, leakage, fit of each mask against a pixel box."""
    x0, y0, x1, y1 = box
    within = (F.col("px") >= x0) & (F.col("px") < x1) & (F.col("py") >= y0) & (F.col("py") < y1)
    area = F.sum(within.cast("bigint"))
    inner, outer = F.sum((within & F.col("mask")).cast("bigint")), F.sum((~within & F.col("mask")).cast("bigint"))
    g = pixels.groupBy("view_id").agg(inner.alias("inside"), outer.alias("outside"), area.alias("area"))
    part = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    i, o, n = F.col("inside"), F.col("outside"), F.col("area")
    return g.select("view_id", "inside", "outside", part(i, n).alias("coverage"), part(o, i + o).alias("leakage"), part(i, n + o).alias("fit"))


def blended(pixels: DataFrame, tint: int = 255, alpha: int = 115) -> DataFrame:
    """Masked pixels blended with a tint in whole numbers."""
    base = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("lum"))) * 255)
    mix = F.floor(base * (255 - alpha) / 255) + F.floor(F.lit(tint * alpha) / 255)
    return pixels.select("view_id", "px", "py", F.when(F.col("mask"), mix).otherwise(base).cast("bigint").alias("value"))


def depth_buffer(points: DataFrame, keys=("px", "py")) -> DataFrame:
    """Nearest depth of each pixel."""
    return points.groupBy(*keys).agg(F.min("depth").alias("zbuf"))


def masks_union(pixels: DataFrame) -> DataFrame:
    """px, py, mask: whether any mask has the pixel."""
    return pixels.groupBy("px", "py").agg(F.bool_or("mask").alias("mask"))


def overlap_share(a: tuple, b: tuple) -> Column:
    inter, area_a, area_b = rect_overlap(a, b)
    return F.coalesce(F.try_divide(inter, area_a + area_b - inter), F.lit(0.0))
