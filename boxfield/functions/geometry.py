"""Scalar geometry as column expressions: frames, angles, boxes, cameras."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


# Frames


def to_local(x, y, z, cx, cy, cz, yaw) -> tuple[Column, Column, Column]:
    """World to box frame: along, across, up."""
    dx, dy = col(x) - col(cx), col(y) - col(cy)
    c, s = F.cos(col(yaw)), F.sin(col(yaw))
    return dx * c + dy * s, dy * c - dx * s, col(z) - col(cz)


def to_world(u, v, k, cx, cy, cz, yaw) -> tuple[Column, Column, Column]:
    c, s = F.cos(col(yaw)), F.sin(col(yaw))
    return col(u) * c - col(v) * s + col(cx), col(u) * s + col(v) * c + col(cy), col(k) + col(cz)


def rotate(x, y, yaw) -> tuple[Column, Column]:
    c, s = F.cos(col(yaw)), F.sin(col(yaw))
    return col(x) * c - col(y) * s, col(x) * s + col(y) * c


def align(x, y, z, rotation: list[list[float]], shift: list[float]) -> list[Column]:
    """Rigid transform: rotation times the point, plus shift."""
    p = [col(x), col(y), col(z)]
    return [sum((F.lit(float(r)) * q for r, q in zip(row[1:], p[1:])), F.lit(float(row[0])) * p[0]) + F.lit(float(t)) for row, t in zip(rotation, shift)]


def unalign(x, y, z, rotation: list[list[float]], shift: list[float]) -> list[Column]:
    """Inverse of ``align``."""
    d = [col(q) - F.lit(float(t)) for q, t in zip((x, y, z), shift)]
    return [sum((F.lit(float(rotation[j][i])) * d[j] for j in (1, 2)), F.lit(float(rotation[0][i])) * d[0]) for i in range(3)]


# Angles


def remainder(a, m) -> Column:
    """IEEE remainder: ties to even."""
    return col(a) - F.rint(col(a) / col(m)) * col(m)


def fold_quarter(a) -> Column:
    """Direction modulo 90 degrees in [-45, 45) degrees, in radians."""
    return F.pmod(col(a) + math.pi / 4, F.lit(math.pi / 2)) - math.pi / 4


def angle_distance(a, b) -> Column:
    """Distance of two directions modulo 90 degrees."""
    d = F.pmod(F.abs(col(a) - col(b)), F.lit(math.pi / 2))
    return F.least(d, F.lit(math.pi / 2) - d)


def principal_axis(var_x, var_y, covar) -> Column:
    """Angle of the major axis, modulo 180 degrees."""
    return F.lit(0.5) * F.atan2(F.lit(2.0) * col(covar), col(var_x) - col(var_y))


# Boxes


def half_extents(length, width, yaw, expand=0.0) -> tuple[Column, Column]:
    """Half sizes of the axis-parallel rectangle around a footprint that is grown by ``expand``."""
    c, s, a, b = F.abs(F.cos(col(yaw))), F.abs(F.sin(col(yaw))), col(length) / 2 + col(expand), col(width) / 2 + col(expand)
    return c * a + s * b, s * a + c * b


SIGNS = ((-1, -1), (1, -1), (1, 1), (-1, 1))


def corners(cx="cx", cy="cy", length="sl", width="sw", yaw="yaw") -> list[tuple[Column, Column]]:
    """Footprint corners (-,-), (+,-), (+,+), (-,+)."""
    c, s = F.cos(col(yaw)), F.sin(col(yaw))
    out = []
    for i, j in SIGNS:
        u, v = col(length) / 2 * i, col(width) / 2 * j
        out.append((u * c - v * s + col(cx), u * s + v * c + col(cy)))
    return out


def frame_rect(**names) -> tuple[Column, Column, Column, Column]:
    """(x0, y0, x1, y1) around the footprint's corners."""
    xy = corners(**names)
    return F.least(*(p[0] for p in xy)), F.least(*(p[1] for p in xy)), F.greatest(*(p[0] for p in xy)), F.greatest(*(p[1] for p in xy))


def aabb_gap(a, b) -> Column:
    """Distance of two axis-parallel rectangles (x0, y0, x1, y1)."""
    gx = F.greatest(a[0] - b[2], b[0] - a[2], F.lit(0.0))
    gy = F.greatest(a[1] - b[3], b[1] - a[3], F.lit(0.0))
    return F.hypot(gx, gy)


def sat_gap(a: list[tuple[Column, Column]], yaw_a, b: list[tuple[Column, Column]], yaw_b) -> Column:
    """Largest separation of two footprints over the four edge directions; negative when they overlap."""
    gaps = []
    for yaw, turn in ((yaw_a, 0.0), (yaw_a, math.pi / 2), (yaw_b, 0.0), (yaw_b, math.pi / 2)):
        c, s = F.cos(col(yaw) + turn), F.sin(col(yaw) + turn)
        da, db = [x * c + y * s for x, y in a], [x * c + y * s for x, y in b]
        gaps.append(F.greatest(F.least(*da) - F.greatest(*db), F.least(*db) - F.greatest(*da)))
    return F.greatest(*gaps)


# Rectangles of pixels


def rect_overlap(a, b) -> tuple[Column, Column, Column]:
    """(intersection, area of a, area of b)."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    return w * h, (a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1])


def rect_covered(a, b, iou=0.1, contained=0.6, containing=0.75) -> Column:
    inter, area_a, area_b = rect_overlap(a, b)
    union = area_a + area_b - inter
    share = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    return (inter > 0) & ((share(inter, area_a) >= contained) | (share(inter, area_b) >= containing) | (share(inter, union) >= iou))


def rect_inside(outer, inner, least=0.75) -> Column:
    inter, _, area = rect_overlap(outer, inner)
    return F.coalesce(F.try_divide(inter, area), F.lit(0.0)) >= least


# Cameras


@dataclass(frozen=True)
class Camera:
    """Pinhole camera that looks from eye to target."""

    eye: tuple[float, float, float]
    target: tuple[float, float, float]
    up: tuple[float, float, float] = (0.0, 0.0, 1.0)
    fovy_deg: float = 60.0
    width: int = 1280
    height: int = 1024

    def axes(self) -> list[tuple[list[float], float]]:
        """Rows (right, down, forward) of the view matrix with their offsets."""
        f = _unit([t - e for t, e in zip(self.target, self.eye)])
        r = _unit(_cross(f, list(self.up)))
        d = _cross(f, r)
        return [(a, -sum(x * e for x, e in zip(a, self.eye))) for a in (r, d, f)]

    @property
    def focal(self) -> float:
        return (self.height / 2) / math.tan(math.radians(self.fovy_deg) / 2)

    def project(self, x, y, z) -> tuple[Column, Column, Column]:
        """World to (pixel x, pixel y, depth); the depth divided by is at least 1e-6."""
        p = [col(x), col(y), col(z)]
        cam = [a[0] * p[0] + a[1] * p[1] + a[2] * p[2] + t for a, t in self.axes()]
        depth = F.greatest(cam[2], F.lit(1e-6))
        return cam[0] / depth * self.focal + self.width / 2, cam[1] / depth * self.focal + self.height / 2, cam[2]

    def ray(self, px, py) -> list[Column]:
        """World direction through a pixel, with a forward part of 1."""
        a, b = (col(px) - self.width / 2) / self.focal, (col(py) - self.height / 2) / self.focal
        (r, _), (d, _), (f, _) = self.axes()
        return [a * r[i] + b * d[i] + f[i] for i in range(3)]

    def to_plane(self, px, py, plane_z) -> tuple[Column, Column]:
        """Pixel to the world point on a horizontal plane; slopes under 1e-9 count as 1e-9."""
        w = self.ray(px, py)
        down = F.when(F.abs(w[2]) < 1e-9, F.lit(1e-9)).otherwise(w[2])
        t = (col(plane_z) - self.eye[2]) / down
        return self.eye[0] + t * w[0], self.eye[1] + t * w[1]

    def at_depth(self, px, py, depth) -> list[Column]:
        return [self.eye[i] + col(depth) * w for i, w in enumerate(self.ray(px, py))]


def _unit(a: list[float]) -> list[float]:
    n = math.sqrt(sum(x * x for x in a))
    return [x / n for x in a]


def _cross(a: list[float], b: list[float]) -> list[float]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
