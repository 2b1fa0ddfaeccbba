"""Coloured points for viewers: cloud, edges and faces of boxes, and pictures kept in a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import corners, to_world
from .ply import ply_parts

COLUMNS = ["x", "y", "z", "red", "green", "blue"]
#: Fixed colours (red, green, blue) in 0..1.
EDGE, FACE, TRUTH = (1.0, 0.2, 0.2), (0.2, 0.8, 0.2), (0.2, 0.4, 1.0)


def _steps(size, step: float):
    """Offsets from -size/2 to size/2, evenly, at least two."""
    n = F.greatest(F.floor(size / step + 1e-9), F.lit(2).cast("bigint"))
    return F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda k: -size / 2 + size * k / (n - 1))


def edge_points(boxes: DataFrame, step: float = 0.01) -> DataFrame:
    """box_id, x, y, z along the twelve edges of each box."""
    xy = corners()
    low, high = F.col("cz") - F.col("sh") / 2, F.col("cz") + F.col("sh") / 2
    ends = [(xy[i], z, xy[(i + 1) % 4], z) for i in range(4) for z in (low, high)] + [(p, low, p, high) for p in xy]
    edges = F.array(*(F.struct(a[0].alias("ax"), a[1].alias("ay"), za.alias("az"), b[0].alias("bx"), b[1].alias("by"), zb.alias("bz")) for a, za, b, zb in ends))
    e = boxes.select("box_id", F.explode(edges).alias("e")).select("box_id", "e.*")
    far = F.sqrt(sum(((F.col(f"b{c}") - F.col(f"a{c}")) ** 2 for c in "yz"), (F.col("bx") - F.col("ax")) ** 2))
    n = F.greatest(F.floor(far / step + 1e-9), F.lit(2).cast("bigint"))
    e = e.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    return e.select("box_id", *((F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * F.col("k") / (F.col("n") - 1)).alias(c) for c in "xyz"))


def face_points(boxes: DataFrame, step: float = 0.05) -> DataFrame:
    """box_id, face, x, y, z on a grid over the six faces of each box."""
    faces = (("top", 2, 1), ("bottom", 2, -1), ("front", 1, 1), ("back", 1, -1), ("right", 0, 1), ("left", 0, -1))
    size = [F.col("sl"), F.col("sw"), F.col("sh")]
    out = None
    for name, axis, sign in faces:
        a, b = [i for i in range(3) if i != axis]
        g = boxes.select("*", F.explode(_steps(size[a], step)).alias("__a")).select("*", F.explode(_steps(size[b], step)).alias("__b"))
        local = [None] * 3
        local[axis], local[a], local[b] = sign * size[axis] / 2, F.col("__a"), F.col("__b")
        x, y, z = to_world(*local, "cx", "cy", "cz", "yaw")
        one = g.select("box_id", F.lit(name).alias("face"), x.alias("x"), y.alias("y"), z.alias("z"))
        out = one if out is None else out.unionByName(one)
    return out


def tinted(points: DataFrame, colour: tuple[float, float, float]) -> DataFrame:
    return points.select("x", "y", "z", *(F.lit(v).alias(c) for c, v in zip(COLUMNS[3:], colour)))


def height_tint(points: DataFrame, low: float, high: float) -> DataFrame:
    """Points coloured from blue (low) to red (high)."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("z") - low) / max(high - low, 1e-9)))
    return points.select("x", "y", "z", t.alias("red"), (1 - F.abs(2 * t - 1)).alias("green"), (1 - t).alias("blue"))


def export_rows(points: DataFrame | None, boxes: DataFrame, truth: DataFrame | None = None, *, most: int = 1_000_000, edge_step: float = 0.01) -> DataFrame:
    """Rows (COLUMNS) of a viewer file: at most about ``most`` points of the cloud (a hash chooses), edges and faces of boxes, edges of true boxes.

    Without points only the edges are written.
    """
    out = tinted(edge_points(boxes, edge_step), EDGE)
    if points is not None:
        n, low, high = points.agg(F.count(F.lit(1)), F.min("z"), F.max("z")).first()
        share = min(1.0, most / max(1, n))
        some = points if share == 1.0 else points.where(F.pmod(F.xxhash64("x", "y", "z"), F.lit(1 << 20)) < int(share * (1 << 20)))
        out = height_tint(some, low or 0.0, high or 1.0).unionByName(out).unionByName(tinted(face_points(boxes), FACE))
    return out if truth is None else out.unionByName(tinted(edge_points(truth, edge_step), TRUTH))


def write_ply(rows: DataFrame, path: str) -> None:
    """A Parquet table of whole .ply files (content), one for each partition; nothing is written for no rows."""
    ply_parts(rows, COLUMNS).write.mode("error").parquet(path)


def report_pictures(reports: DataFrame, html: str = "html") -> DataFrame:
    """All columns of the reports but the page, k and content: pictures that a page holds as base64."""
    found = F.regexp_extract_all(F.col(html), F.lit("data:image/png;base64,([A-Za-z0-9+/=]+)"), F.lit(1))
    rows = reports.select(*(c for c in reports.columns if c != html), F.posexplode(found).alias("k", "__b"))
    return rows.withColumn("content", F.unbase64("__b")).drop("__b")


def is_whole_png(content):
    """Whether bytes begin with the signature and end with the end chunk of a PNG."""
    text = F.hex(content)
    return text.startswith("89504E470D0A1A0A") & text.endswith("49454E44AE426082")
