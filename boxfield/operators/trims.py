"""Guards and cuts of boxes by their points: overhead structure, sparse tops, boxes that hold a smaller one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import corners
from .layout import overlaps
from .rects import checkpointed
from .spatial import by_shape, near_points, places

FLOOR, SLACK, BIN, BAND = 0.30, 0.05, 0.05, 0.06
GUARD_POINTS, OVERHEAD, OVERHEAD_SHARE, ABOVE = 12, 8, 0.50, 0.15
TOP_POINTS, TOP_LEAST, TOP_SHARE, CELLS, CELL_POINTS, BODY_CELLS, COVERAGE, WORTH = 80, 5, 0.15, 4, 3, 4, 0.65, 0.15
INSIDE, SMALLER, OWN, CUT_POINTS = 0.50, 0.50, 0.80, 20
DEPTH, LENGTH = (0.30, 2.50), 0.30


def height_guard(points: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates (box columns, u_at, v_at, end) with ok: whether the points of the sheet at that place belong to the device.

    A sheet needs body points and must not be made of what stands above the box:
    a coherent group above the top, or more above than half of the body, rejects it.
    ``end`` tells sheets at an end of a row from those at a face.
    """
    rows = candidates.withColumn("__c", F.monotonically_increasing_id())
    rows = checkpointed(rows)
    reach_u = F.when(F.col("end"), F.lit(BAND)).otherwise(F.greatest(F.lit(0.30), F.least(F.lit(0.80), 0.25 * F.col("sl"))))
    reach_v = F.when(F.col("end"), F.col("sw") / 2 + SLACK).otherwise(F.lit(BAND))
    near = near_points(points, rows, 1.0).where((F.abs(F.col("u") - F.col("u_at")) <= reach_u) & (F.abs(F.col("v") - F.col("v_at")) <= reach_v) & (F.col("k") > -F.col("sh") / 2 + FLOOR))
    over = F.col("k") - F.col("sh") / 2
    count = lambda c: F.count(F.when(c, 1))
    g = near.groupBy("__c").agg(F.count(F.lit(1)).alias("n"), count(over <= 0.05).alias("body"), count(over > 0.10).alias("high"), F.percentile(F.when(over > 0.10, over), F.lit(0.95)).alias("p95"))
    coherent = (F.col("high") >= OVERHEAD) & (F.col("p95") > ABOVE)
    good = (F.col("n") >= GUARD_POINTS) & (F.col("body") >= GUARD_POINTS) & ~F.coalesce(coherent, F.lit(False)) & (F.col("high") <= F.greatest(F.lit(float(OVERHEAD)), F.floor(OVERHEAD_SHARE * F.col("body"))))
    return rows.join(g, "__c", "left").withColumn("ok", F.coalesce(good, F.lit(False))).select(*candidates.columns, "ok")


def trimmed_tops(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """boxes whose sparse tails above the body are cut off: cz and sh change, ``trimmed`` tells where.

    Points are counted by 5 cm slice and footprint cell (4 x 4).  A slice supports
    the top if it is dense and it and its neighbours fill most of the cells that
    the lower body fills; the highest such slice is the new top, if it is worth it.
    """
    return by_shape(boxes, lambda shapes: _tops(places(points), shapes)).withColumns({"cz": F.col("__cz"), "sh": F.col("__h")}).select(*boxes.columns, "trimmed")


def _tops(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """box_id, trimmed, __cz, __h: the new centre and height of each box; ``points`` are places."""
    low = FLOOR - F.col("sh") / 2
    column = near_points(points, boxes, SLACK).where((F.abs("u") <= F.col("sl") / 2 + SLACK) & (F.abs("v") <= F.col("sw") / 2 + SLACK) & (F.col("k") > low))
    part = lambda a, s: F.least(F.lit(CELLS - 1), F.greatest(F.lit(0), F.floor((F.col(a) + F.col(s) / 2) / F.col(s) * CELLS)))
    tall = F.col("sh") - FLOOR
    height = F.col("k") - low
    keyed = column.select("box_id", "sh", "__n", F.floor(height / BIN).alias("bin"), (part("u", "sl") * CELLS + part("v", "sw")).alias("cell"), height.between(0.20 * tall, 0.55 * tall).alias("ref"))
    counts = keyed.groupBy("box_id", "sh", "bin", "cell").agg(F.sum("__n").alias("n"), F.sum(F.when(F.col("ref"), F.col("__n")).otherwise(0)).alias("refs"))
    counts = checkpointed(counts)
    body = counts.groupBy("box_id", "cell").agg(F.sum("refs").alias("r")).where(F.col("r") >= CELL_POINTS).select("box_id", "cell")
    enough = counts.groupBy("box_id").agg(F.sum("n").alias("total")).where(F.col("total") >= TOP_POINTS).select("box_id")
    cells = body.groupBy("box_id").agg(F.count(F.lit(1)).alias("cells")).where(F.col("cells") >= BODY_CELLS)
    last = F.ceil((F.col("sh") - FLOOR + BIN) / BIN - 1e-9) - 2  # the last whole slice of the profile
    slices = counts.where((F.col("bin") >= 0) & (F.col("bin") <= last)).groupBy("box_id", "bin").agg(F.sum("n").alias("n"))
    peaks = slices.groupBy("box_id").agg(F.max("n").alias("peak"))
    dense = slices.join(peaks, "box_id").where(F.col("n") >= F.greatest(F.lit(float(TOP_LEAST)), TOP_SHARE * F.col("peak"))).select("box_id", "bin")
    around = counts.select("box_id", "cell", "n", F.explode(F.array(*(F.col("bin") + d for d in (-1, 0, 1)))).alias("bin")).groupBy("box_id", "bin", "cell").agg(F.sum("n").alias("n")).where(F.col("n") >= CELL_POINTS)
    filled = around.join(body, ["box_id", "cell"], "left_semi").groupBy("box_id", "bin").agg(F.count(F.lit(1)).alias("filled"))
    tops = dense.join(filled, ["box_id", "bin"]).join(cells, "box_id").where(F.col("filled") >= COVERAGE * F.col("cells")).groupBy("box_id").agg(F.max("bin").alias("bin")).join(enough, "box_id")
    new = FLOOR + (F.col("bin") + 1) * BIN
    cut = F.coalesce((F.col("sh") - new >= WORTH) & (new >= 0.30) & (tall >= 2 * BIN), F.lit(False))
    out = boxes.join(tops, "box_id", "left").withColumn("trimmed", cut).withColumn("__h", F.when(F.col("trimmed"), new).otherwise(F.col("sh")))
    return out.select("box_id", "trimmed", (F.col("cz") - (F.col("sh") - F.col("__h")) / 2).alias("__cz"), "__h")


def nested_cuts(points: DataFrame, boxes: DataFrame, group: str | None = None) -> DataFrame:
    """box_id, small, side, lo, hi and the new lo_u..hi_v: where a box ends at a clearly smaller one that it half holds.

    The cut is the part between the box's face and the near side of the small one;
    it stands if enough points lie there and most are the small box's own.  Pairs of
    one split (``group``) are left alone.  One row for each pair that stands.
    """
    held = overlaps(boxes, boxes).where(f"box_id <> other and contained >= {INSIDE}").select(F.col("box_id").alias("small"), F.col("other").alias("box_id"))
    cols = ["cx", "cy", "cz", "sl", "sw", "sh", "yaw", *([group] if group else [])]
    b = boxes.select("box_id", *cols)
    s = boxes.select(F.col("box_id").alias("small"), *(F.col(c).alias(f"{c}_s") for c in cols))
    p = held.join(b, "box_id").join(s, "small").where(F.col("sl_s") * F.col("sw_s") <= SMALLER * F.col("sl") * F.col("sw"))
    if group:
        p = p.where(F.col(group).isNull() | (F.col(group) != F.col(f"{group}_s")) | F.col(f"{group}_s").isNull())
    c, sn = F.cos("yaw"), F.sin("yaw")
    local = [((x - F.col("cx")) * c + (y - F.col("cy")) * sn, (y - F.col("cy")) * c - (x - F.col("cx")) * sn) for x, y in corners("cx_s", "cy_s", "sl_s", "sw_s", "yaw_s")]
    us, vs = [u for u, _ in local], [v for _, v in local]
    du = (F.col("cx_s") - F.col("cx")) * c + (F.col("cy_s") - F.col("cy")) * sn
    dv = (F.col("cy_s") - F.col("cy")) * c - (F.col("cx_s") - F.col("cx")) * sn
    p = p.withColumns({"du": du, "dv": dv, "u0": F.least(*us), "u1": F.greatest(*us), "v0": F.least(*vs), "v1": F.greatest(*vs)})
    across = F.abs("dv") >= F.abs("du")
    plus = F.when(across, F.col("dv") > 0).otherwise(F.col("du") > 0)
    half = F.when(across, F.col("sw")).otherwise(F.col("sl")) / 2
    edge = F.when(across & plus, F.col("v0")).when(across, F.col("v1")).when(plus, F.col("u0")).otherwise(F.col("u1"))
    face = F.when(plus, half).otherwise(-half)
    p = checkpointed(p.withColumns({"across": across, "plus": plus, "edge": edge, "face": face}))
    near = near_points(points, p, 1.0)
    on = F.when(F.col("across"), F.col("v")).otherwise(F.col("u"))
    other, wide = F.when(F.col("across"), F.col("u")).otherwise(F.col("v")), F.when(F.col("across"), F.col("sl")).otherwise(F.col("sw")) / 2 + SLACK
    cut = near.where((F.col("k") > FLOOR - F.col("sh") / 2) & (F.col("k") <= F.col("sh") / 2) & on.between(F.least("edge", "face"), F.greatest("edge", "face")) & (F.abs(other) <= wide))
    x, y = F.col("x") - F.col("cx_s"), F.col("y") - F.col("cy_s")
    own = (F.abs(x * F.cos("yaw_s") + y * F.sin("yaw_s")) <= F.col("sl_s") / 2) & (F.abs(y * F.cos("yaw_s") - x * F.sin("yaw_s")) <= F.col("sw_s") / 2) & (F.abs(F.col("z") - F.col("cz_s")) <= F.col("sh_s") / 2)
    stands = cut.groupBy("box_id", "small").agg(F.count(F.lit(1)).alias("n"), F.avg(own.cast("double")).alias("share")).where((F.col("n") >= CUT_POINTS) & (F.col("share") >= OWN))
    lo, hi = F.when(F.col("plus"), -half).otherwise(F.col("edge")), F.when(F.col("plus"), F.col("edge")).otherwise(half)
    side = F.when(F.col("across"), F.when(F.col("plus"), "front").otherwise("back")).otherwise(F.when(F.col("plus"), "right").otherwise("left"))
    out = p.join(stands, ["box_id", "small"]).select("box_id", "small", side.alias("side"), lo.alias("lo"), hi.alias("hi"), "across")
    size = F.col("hi") - F.col("lo")
    return out.where(F.when(F.col("across"), size.between(*DEPTH)).otherwise(size >= LENGTH))


def cut_to(boxes: DataFrame, cuts: DataFrame) -> DataFrame:
    """boxes with the new ends lo, hi of cuts (box_id, across, lo, hi) along or across them."""
    b = boxes.join(cuts.select("box_id", "across", "lo", "hi"), "box_id", "left")
    mid, size = (F.col("lo") + F.col("hi")) / 2, F.col("hi") - F.col("lo")
    du, dv = F.when(~F.col("across"), mid).otherwise(0.0), F.when(F.col("across"), mid).otherwise(0.0)
    hit = F.col("across").isNotNull()
    new = {
        "cx": F.when(hit, F.col("cx") + du * F.cos("yaw") - dv * F.sin("yaw")).otherwise(F.col("cx")), "cy": F.when(hit, F.col("cy") + du * F.sin("yaw") + dv * F.cos("yaw")).otherwise(F.col("cy")),
        "sl": F.when(hit & ~F.col("across"), size).otherwise(F.col("sl")), "sw": F.when(hit & F.col("across"), size).otherwise(F.col("sw")),
    }
    return b.select(*(new[c].alias(c) if c in new else F.col(c) for c in boxes.columns))


def nested_trimmed(points: DataFrame, boxes: DataFrame, group: str | None = None) -> DataFrame:
    """boxes, each cut once at most, as if they were taken by id: a box sees the cuts of those before it.

    In each round the boxes whose possible partners with smaller ids are done are
    cut, all at once; rounds go on until none is open.
    """
    now = checkpointed(boxes)
    pairs = checkpointed(overlaps(boxes, boxes, 0.0).where("box_id <> other and iou > 0").select("box_id", "other"))
    open_ = checkpointed(nested_cuts(points, now, group).select("box_id").distinct())
    while not open_.isEmpty():
        waits = pairs.where("other < box_id").join(open_.select(F.col("box_id").alias("other")), "other", "left_semi").select("box_id")
        ready = checkpointed(open_.join(waits, "box_id", "left_anti"))
        first = Window.partitionBy("box_id").orderBy("small")
        cuts = nested_cuts(points, now, group).join(ready, "box_id", "left_semi").withColumn("__rn", F.row_number().over(first)).where("__rn = 1")
        now = checkpointed(cut_to(now, cuts))
        open_ = checkpointed(open_.join(ready, "box_id", "left_anti"))
    return now


def column_slice(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points that a box's cross profile is made of: within its length and a little, above the floor, not above its top."""
    return near_points(points, boxes, 1.0).where((F.abs("u") <= F.col("sl") / 2 + SLACK) & (F.col("k") > FLOOR - F.col("sh") / 2) & (F.col("k") <= F.col("sh") / 2))


def z_capped(tops: Column, seed_top: Column, n: Column) -> Column:
    """Height up to which a side view shows points: a little above the body, where it ends well below the seed's top; else no limit."""
    return F.when((n >= 60) & (tops + 0.15 < seed_top - 0.30), tops + 0.15).otherwise(F.lit(float("inf")))
