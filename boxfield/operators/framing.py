"""Cameras that frame a layout or a box: what must be in view, and the first camera of a ladder that shows it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import corners, frame_rect
from .rects import checkpointed
from .spatial import scene_keys

# Fixed ladders: distances of the oblique camera, lenses and distances of the local one.
OBLIQUE = (1.0, 1.2, 1.5, 1.8, 2.2, 2.8, 3.5, 4.5, 6.0, 8.0, 11.0)
LENSES = (60.0, 66.0, 72.0, 78.0, 84.0, 90.0, 96.0, 102.0, 110.0)
BACK = (1.0, 1.1, 1.25, 1.4, 1.6, 1.9, 2.2, 2.6, 3.0, 3.5)
NEAR, FOVY, SLACK = 0.1, 60.0, 1.05

Vector = tuple[Column, Column, Column]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def unit(a: Vector) -> Vector:
    n = F.sqrt(dot(a, a))
    return a[0] / n, a[1] / n, a[2] / n


def pixel(point: Vector, eye: Vector, target: Vector, fovy, width: int, height: int) -> tuple[Column, Column, Column]:
    """(pixel x, pixel y, depth) of a point for a camera with the world's up."""
    forward = unit(tuple(t - e for t, e in zip(target, eye)))
    right = unit(cross(forward, (F.lit(0.0), F.lit(0.0), F.lit(1.0))))
    down = cross(forward, right)
    off = tuple(p - e for p, e in zip(point, eye))
    depth, focal = dot(off, forward), height / 2 / F.tan(F.radians(fovy) / 2)
    safe = F.greatest(depth, F.lit(1e-6))
    return dot(off, right) / safe * focal + width / 2, dot(off, down) / safe * focal + height / 2, depth


def footprint(points: DataFrame, boxes: DataFrame | None = None, pad: float = 0.03) -> DataFrame:
    """(scene_id,) x0, y0, x1, y1, z_top, low, high: what a view must show, the boxes' footprints or else the cloud, with a margin.

    z_top is the highest box top (null without boxes), low and high the cloud's range of heights.
    """
    scene = scene_keys(points)
    cloud = points.groupBy(*scene).agg(*(f(c).alias(n) for f, c, n in ((F.min, "x", "px0"), (F.min, "y", "py0"), (F.max, "x", "px1"), (F.max, "y", "py1"), (F.min, "z", "low"), (F.max, "z", "high"))))
    if boxes is None:
        out = cloud.select(*scene, *(F.col(f"p{c}").alias(c) for c in ("x0", "y0", "x1", "y1")), F.lit(None).cast("double").alias("z_top"), "low", "high")
    else:
        r = frame_rect()
        of = boxes.groupBy(*scene).agg(F.min(r[0]).alias("x0"), F.min(r[1]).alias("y0"), F.max(r[2]).alias("x1"), F.max(r[3]).alias("y1"), F.max(F.col("cz") + F.col("sh") / 2).alias("z_top"))
        both = cloud.join(of, scene, "left") if scene else cloud.crossJoin(of)  # one row each
        out = both.select(*scene, *(F.coalesce(c, f"p{c}").alias(c) for c in ("x0", "y0", "x1", "y1")), "z_top", "low", "high")
    wide = pad * F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / 2
    return out.select(*scene, (F.col("x0") - wide).alias("x0"), (F.col("y0") - wide).alias("y0"), (F.col("x1") + wide).alias("x1"), (F.col("y1") + wide).alias("y1"), "z_top", "low", "high")


def nadir_camera(foot: DataFrame, width: int = 1280, height: int = 1024, least_z: float = 0.0) -> DataFrame:
    """foot with ex, ey, ez: the eye that looks straight down on the footprint at the height of the highest top."""
    tall = math.tan(math.radians(FOVY / 2))
    need = F.greatest((F.col("x1") - F.col("x0")) / 2 / (tall * width / height), (F.col("y1") - F.col("y0")) / 2 / tall)
    ring = F.greatest(F.coalesce("z_top", "high"), F.col("high"))
    return foot.withColumns({"ex": (F.col("x0") + F.col("x1")) / 2, "ey": (F.col("y0") + F.col("y1")) / 2, "ez": F.greatest(F.lit(float(least_z)), (need + ring) * SLACK)})


def first_framed(cameras: DataFrame, key: list[str], points: list[Vector], width: int, height: int, margin: float, otherwise: str) -> DataFrame:
    """For each key the camera (step, ex..tz, fovy) of the smallest step that shows all points within the margin; else the ``otherwise`` ('first' or 'last') one."""
    eye, target = tuple(F.col(c) for c in ("ex", "ey", "ez")), tuple(F.col(c) for c in ("tx", "ty", "tz"))
    cameras = checkpointed(cameras)  # a few rows; their long expressions would else be repeated below
    rows = cameras.withColumn("__p", F.explode(F.array(*(F.struct(x.alias("x"), y.alias("y"), z.alias("z")) for x, y, z in points))))
    x, y, depth = pixel((F.col("__p.x"), F.col("__p.y"), F.col("__p.z")), eye, target, F.col("fovy"), width, height)
    seen = rows.withColumns({"__x": x, "__y": y, "__d": depth})
    ok = (F.col("__d") > NEAR) & F.col("__x").between(margin * width, (1 - margin) * width) & F.col("__y").between(margin * height, (1 - margin) * height)
    others = [c for c in cameras.columns if c not in (*key, "step")]
    whole = seen.groupBy(*key, "step").agg(F.bool_and(ok).alias("framed"), *(F.first(c).alias(c) for c in others))
    order = Window.partitionBy(*key).orderBy(F.col("framed").desc(), F.when(F.col("framed") | F.lit(otherwise == "first"), F.col("step")).otherwise(-F.col("step")))
    return whole.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def oblique_camera(foot: DataFrame, width: int = 1280, height: int = 1024, elevation: float = 55.0, azimuth: float = 45.0) -> DataFrame:
    """foot with the first camera of the ladder that shows the footprint from the floor to the tops."""
    scene = scene_keys(foot)
    el, az = math.radians(elevation), math.radians(azimuth)
    way = (math.cos(el) * math.cos(az), math.cos(el) * math.sin(az), math.sin(el))
    half = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / 2
    steps = F.explode(F.array(*(F.struct(F.lit(k).alias("step"), ((half + 1.0) * f).alias("d")) for k, f in enumerate(OBLIQUE))))
    c = foot.withColumn("__s", steps).withColumns({"step": F.col("__s.step"), "__d": F.col("__s.d"), "tx": (F.col("x0") + F.col("x1")) / 2, "ty": (F.col("y0") + F.col("y1")) / 2, "tz": F.col("low"), "fovy": F.lit(FOVY)})
    c = c.withColumns({"ex": F.col("tx") + F.col("__d") * way[0], "ey": F.col("ty") + F.col("__d") * way[1], "ez": F.col("__d") * way[2]}).drop("__s", "__d")
    top = F.coalesce("z_top", "high")
    points = [(F.col(x), F.col(y), z) for x in ("x0", "x1") for y in ("y0", "y1") for z in (F.col("low"), top)]
    return first_framed(c.withColumn("__all", F.lit(0)), scene or ["__all"], points, width, height, 0.03, "first").drop("__all")


def local_cameras(boxes: DataFrame, standoff: float | None = None, extent: float = 1.2, width: int = 768, height: int = 768, elevation: float = 18.0, azimuth: float = 0.0) -> DataFrame:
    """box_id and the camera (step, ex..tz, fovy, framed) that looks at each box from its front turned by ``azimuth``.

    With a standoff the eye stays that far from the box's face and the lens widens;
    where no lens is enough, and without a standoff, the eye goes back.
    """
    tall = math.tan(math.radians(FOVY / 2))
    a = F.col("yaw") + math.pi / 2 + math.radians(azimuth)
    hx, hy = F.cos(a), F.sin(a)
    xy = corners()
    across = [-x * hy + y * hx for x, y in xy]
    span = F.greatest(*across) - F.least(*across)
    bulge = F.greatest(*((x - F.col("cx")) * hx + (y - F.col("cy")) * hy for x, y in xy))
    base = F.greatest(F.col("sh") / 2 / tall, (span + extent) / 2 / (tall * width / height))
    steps = []
    if standoff is not None:
        steps += [(F.lit(float(standoff)) + bulge, lens) for lens in LENSES]
        base = F.greatest(F.lit(float(standoff)) + bulge, base)
    steps += [(base * f, FOVY) for f in BACK]
    c = boxes.withColumn("__s", F.explode(F.array(*(F.struct(F.lit(k).alias("step"), d.alias("d"), F.lit(lens).alias("fovy")) for k, (d, lens) in enumerate(steps)))))
    c = c.withColumns({"step": F.col("__s.step"), "fovy": F.col("__s.fovy"), "ex": F.col("cx") + hx * F.col("__s.d"), "ey": F.col("cy") + hy * F.col("__s.d"), "ez": F.col("cz") + F.col("__s.d") * math.tan(math.radians(elevation)), "tx": F.col("cx"), "ty": F.col("cy"), "tz": F.col("cz")})
    points = [(x, y, F.col("cz") + s * F.col("sh") / 2) for x, y in xy for s in (-1, 1)]
    found = first_framed(c.drop("__s"), ["box_id"], points, width, height, 0.02, "last")
    return found.select("box_id", "step", "fovy", "framed", "ex", "ey", "ez", "tx", "ty", "tz")


def perspective(near: float, far: float, fovy: float, width: int, height: int) -> list[list[float]]:
    """Projection matrix, rows of four; the third column holds depth, the last row its offset."""
    tall = math.tan(fovy / 2 if fovy < math.pi else math.radians(fovy) / 2)
    depth = far / (far - near)
    return [[height / (tall * width), 0.0, 0.0, 0.0], [0.0, 1 / tall, 0.0, 0.0], [0.0, 0.0, depth, 1.0], [0.0, 0.0, -near * depth, 0.0]]


# Rectangles of a view


def pixel_box(box: Column, width: int, height: int) -> list[Column]:
    """A box array in 0..1000 as pixels of the last column and row."""
    return [box[i] / 1000.0 * ((width if i % 2 == 0 else height) - 1) for i in range(4)]


def plane_rect(camera, plane_z, yaw: float, rect=("x0", "y0", "x1", "y1")) -> tuple[Column, Column, Column, Column]:
    """The pixel rectangle's corners on a horizontal plane, turned by -yaw, as the rectangle around them."""
    x0, y0, x1, y1 = (F.col(c) for c in rect)
    at = [camera.to_plane(x, y, plane_z) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
    c, s = math.cos(yaw), math.sin(yaw)
    u, v = [x * c + y * s for x, y in at], [y * c - x * s for x, y in at]
    return F.least(*u), F.least(*v), F.greatest(*u), F.greatest(*v)


def shifted(rect, dx, dy) -> tuple[Column, ...]:
    return rect[0] + dx, rect[1] + dy, rect[2] + dx, rect[3] + dy


def common_part(a, b) -> tuple[Column, ...]:
    """Intersection of two rectangles; empty ones have a negative extent."""
    return F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])


def is_tilt_view(name) -> Column:
    return F.col(name).rlike(r"_[LR]\.png$")


def with_geometry(boxes: DataFrame, centre: tuple | None = None, size: tuple | None = None) -> DataFrame:
    """boxes with a new centre or size; every other column stays."""
    new = dict(zip(("cx", "cy", "cz"), centre or ())) | dict(zip(("sl", "sw", "sh"), size or ()))
    return boxes.withColumns(new) if new else boxes
