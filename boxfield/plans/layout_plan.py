"""The whole way from a cloud and proposed rectangles to a judged layout.

Stages: drop noise, level the floor, fit boxes in rectangles, drop repeats,
confidence from support and faces, structural, furniture and wall rules, and a
score against true boxes.  Rectangles come from a callable that looks at the
levelled cloud (a vision model behind an interface, or a table); without one,
dense clusters of the ground plan are taken.  Every stage is written to the
folder of spark.checkpoint.dir, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import directions as D
from ..operators import estimators as E
from ..operators import fitting as T
from ..operators import layout as L
from ..operators import support as S
from ..operators.rects import checkpointed
from ..sources import layouts as J


@dataclass
class Options:
    denoise: bool = False
    neighbours: int = 20
    mesh: bool = False
    keep_low: bool = True


@dataclass
class Result:
    boxes: DataFrame
    removed: DataFrame
    metrics: DataFrame | None
    seconds: dict[str, float] = field(default_factory=dict)


def cluster_rects(points: DataFrame) -> DataFrame:
    """Rectangles of dense clusters between 0.30 and 1.00 metres."""
    found = L.cell_clusters(points.where("z > 0.30 and z <= 1.00"))
    return found.select(F.col("cluster").alias("rect_id"), "x0", "y0", "x1", "y1")


def as_boxes(fitted: DataFrame) -> DataFrame:
    """Fitted rows as boxes with an id that only depends on their rectangle and part."""
    return fitted.select(
        F.xxhash64("rect_id", "part").alias("box_id"), "rect_id", "part", "cx", "cy", "cz", "sl", "sw", "sh", "yaw", "n_pts",
        F.lit(False).alias("tilt"), F.lit("rack").alias("device_type"), F.lit("coarse_seg").alias("source"), F.lit("mid").alias("confidence"), F.lit(0.5).alias("score"),
    )


def run(points: DataFrame, judge: Callable[[DataFrame], DataFrame] | None = None, truth: DataFrame | None = None, options: Options | None = None) -> Result:
    """points (pt_id, x, y, z) to boxes with confidence; ``judge`` maps the levelled cloud to rectangles."""
    o = options or Options()
    seconds: dict[str, float] = {}

    def stage(name: str, df: DataFrame) -> DataFrame:
        began = time.perf_counter()
        out = checkpointed(df)
        seconds[name] = round(time.perf_counter() - began, 3)
        return out

    cloud = E.denoised(points, o.neighbours) if o.denoise else points
    cloud = stage("level", D.levelled(cloud, D.levelling(cloud)))
    rects = stage("rects", (judge or cluster_rects)(cloud).select("rect_id", "x0", "y0", "x1", "y1"))
    boxes = stage("fit", as_boxes(T.fitted_boxes(cloud, rects, mesh=o.mesh)))
    boxes = stage("dedup", L.two_tier_kept(boxes))
    sup = S.support_fraction(cloud, boxes).select("box_id", "support")
    boxes = stage("support", boxes.join(sup, "box_id").withColumn("confidence", S.support_confidence()))
    rules = S.structural_filter(cloud, boxes).select("box_id", "structural").join(S.furniture_filter(cloud, boxes).select("box_id", "furniture"), "box_id")
    boxes = stage("rules", boxes.join(rules, "box_id"))
    faced = S.face_support(cloud, boxes, protected=F.col("structural") | F.col("furniture")).select("box_id", "matched_faces", "new_confidence")
    boxes = stage("faces", boxes.join(faced, "box_id").withColumn("confidence", F.col("new_confidence")).drop("new_confidence"))
    walls = stage("walls", T.outer_walls(cloud, boxes))
    gone = boxes.join(walls, "box_id", "left").where("reason is not null or furniture").select("box_id", F.coalesce("reason", F.lit("furniture")).alias("reason"))
    kept = boxes.join(gone, "box_id", "left_anti")
    kept = kept if o.keep_low else kept.where("confidence <> 'low'")
    metrics = L.evaluate(truth, kept) if truth is not None else None
    return Result(kept, gone, metrics, seconds)


def write(result: Result, path: str) -> None:
    """boxes (JSON lines), named boxes, a drawing and the stages' seconds below a folder."""
    spark = result.boxes.sparkSession
    result.boxes.write.mode("overwrite").json(f"{path}/boxes")
    J.output_names(result.boxes, F.col("device_type")).select("name", F.array("cx", "cy", "cz").alias("center"), F.array("sl", "sw", "sh").alias("extent"), "yaw", "confidence").write.mode("overwrite").json(f"{path}/output")
    J.svg(result.boxes).coalesce(1).write.mode("overwrite").text(f"{path}/layout")
    spark.createDataFrame([(json.dumps(result.seconds),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/perf")
    if result.metrics is not None:
        result.metrics.write.mode("overwrite").json(f"{path}/metrics")
