"""A generated room: rows of racks, an air unit, floor and walls, as points and true boxes.

Every number is a hash of the seed, the part and the sample's number, so rows
can be made in any partition and come out the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(*keys: Column, seed: int, draw: int) -> Column:
    """A number in [0, 1) from a hash of the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(draw), *keys), F.lit(1 << 40)) / float(1 << 40)


def true_boxes(spark: SparkSession, rows: int = 3, racks: int = 8, pitch: float = 2.4, yaw: float = 0.0) -> DataFrame:
    """box_id, row_id, device_type, cx..sh, yaw of the racks and one air unit, turned by yaw about the origin."""
    r = spark.range(rows * racks).select(F.col("id").alias("box_id"), F.floor(F.col("id") / racks).alias("row_id"), (F.col("id") % racks).alias("k"))
    r = r.select("box_id", "row_id", F.lit("rack").alias("device_type"), (0.605 * F.col("k") + 0.3).alias("x"), (pitch * F.col("row_id") + 0.55).alias("y"), F.lit(0.6).alias("sl"), F.lit(1.1).alias("sw"), F.lit(2.0).alias("sh"))
    ac = spark.range(1).select(F.lit(rows * racks).cast("bigint").alias("box_id"), F.lit(-1).cast("bigint").alias("row_id"), F.lit("ac").alias("device_type"), F.lit(0.605 * racks + 1.5).alias("x"), F.lit(0.5).alias("y"), F.lit(1.0).alias("sl"), F.lit(0.8).alias("sw"), F.lit(1.8).alias("sh"))
    c, s = math.cos(yaw), math.sin(yaw)
    x, y = F.col("x"), F.col("y")
    return r.unionByName(ac).select("box_id", "row_id", "device_type", (x * c - y * s).alias("cx"), (x * s + y * c).alias("cy"), (F.col("sh") / 2).alias("cz"), "sl", "sw", "sh", F.lit(yaw).alias("yaw"))


def surface(boxes: DataFrame, density: float = 900.0, noise: float = 0.008, seed: int = 42) -> DataFrame:
    """box_id, x, y, z: samples of the four sides and the top of each box, with noise."""
    side = F.explode(F.array(*(F.struct(F.lit(n).alias("face"), a.alias("a"), b.alias("b")) for n, a, b in (("+u", F.col("sw"), F.col("sh")), ("-u", F.col("sw"), F.col("sh")), ("+v", F.col("sl"), F.col("sh")), ("-v", F.col("sl"), F.col("sh")), ("+k", F.col("sl"), F.col("sw"))))))
    f = boxes.select("*", side.alias("f")).withColumn("n", F.greatest(F.floor(F.col("f.a") * F.col("f.b") * density * (0.5 + uniform(F.col("box_id"), seed=seed, draw=0))), F.lit(4).cast("bigint")))
    f = f.withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    draw = lambda k: uniform(F.col("box_id"), F.col("f.face"), F.col("i"), seed=seed, draw=k)
    a, b = (draw(1) - 0.5) * F.col("f.a"), (draw(2) - 0.5) * F.col("f.b")
    sign = F.when(F.col("f.face").startswith("+"), 0.5).otherwise(-0.5)
    on = lambda x: F.col("f.face").endswith(x)
    u = F.when(on("u"), sign * F.col("sl")).otherwise(a)
    v = F.when(on("u"), a).when(on("v"), sign * F.col("sw")).otherwise(b)
    k = F.when(on("k"), F.col("sh") / 2).otherwise(b)
    jitter = lambda d: (draw(d) + draw(d + 1) + draw(d + 2) - 1.5) * 2 * noise
    c, s = F.cos("yaw"), F.sin("yaw")
    return f.select("box_id", (u * c - v * s + F.col("cx") + jitter(3)).alias("x"), (u * s + v * c + F.col("cy") + jitter(6)).alias("y"), (k + F.col("cz") + jitter(9)).alias("z"))


def plane(spark: SparkSession, n: int, part: str, x: tuple, y: tuple, z: tuple, yaw: float, seed: int) -> DataFrame:
    """part, x, y, z: uniform samples of a flat box, turned by yaw."""
    at = lambda lim, d: lim[0] + (lim[1] - lim[0]) * uniform(F.col("id"), F.lit(part), seed=seed, draw=d)
    p = spark.range(n).select(at(x, 1).alias("u"), at(y, 2).alias("v"), at(z, 3).alias("z"))
    c, s = math.cos(yaw), math.sin(yaw)
    return p.select(F.lit(part).alias("part"), (F.col("u") * c - F.col("v") * s).alias("x"), (F.col("u") * s + F.col("v") * c).alias("y"), "z")


def room(spark: SparkSession, yaw: float = 0.0, seed: int = 42, rows: int = 3, racks: int = 8) -> DataFrame:
    """part, x, y, z of the whole room."""
    w, h = 0.605 * racks + 3.0, 2.4 * rows + 0.5
    racks_ = surface(true_boxes(spark, rows, racks, yaw=yaw), seed=seed).select(F.lit("device").alias("part"), "x", "y", "z")
    floor = plane(spark, int(w * h * 225), "floor", (-1.0, w), (-1.0, h), (-0.01, 0.01), yaw, seed)
    walls = plane(spark, int(w * 2.8 * 72), "wall", (-1.0, w), (-1.02, -1.0), (0.0, 2.8), yaw, seed).unionByName(plane(spark, int(h * 2.8 * 72), "wall2", (-1.02, -1.0), (-1.0, h), (0.0, 2.8), yaw, seed))
    return racks_.unionByName(floor).unionByName(walls)


def detections(truth: DataFrame, seed: int = 42) -> DataFrame:
    """True boxes as a detector might give them: some are missed, some too large, with the kind of fault in ``corruption``."""
    u = uniform(F.col("box_id"), seed=seed, draw=50)
    bad = truth.withColumn("corruption", F.when(u < 0.15, "missed").when(u < 0.35, "oversize").when(u < 0.5, "shifted").otherwise("none"))
    grow = F.when(F.col("corruption") == "oversize", 1.4).otherwise(1.0)
    return bad.where("corruption <> 'missed'").withColumns({"sl": F.col("sl") * grow, "sw": F.col("sw") * grow, "cx": F.col("cx") + F.when(F.col("corruption") == "shifted", 0.15).otherwise(0.0)})
