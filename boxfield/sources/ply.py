"""Polygon files: header, binary and text vertex tables, splat attributes; as a Spark data source and a writer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C

SCALARS = {"float": "f4", "float32": "f4", "double": "f8", "float64": "f8", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1"}
FORMATS = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}
#: Values of splat attributes that a file does not have.
DEFAULTS = {"scale_0": float(np.log(0.01)), "scale_1": float(np.log(0.01)), "scale_2": float(np.log(0.01)), "rot_0": 1.0, "opacity": 1.0}
SPLAT = ["x", "y", "z", *(f"f_dc_{i}" for i in range(3)), "opacity", *(f"scale_{i}" for i in range(3)), *(f"rot_{i}" for i in range(4))]


def header(data: bytes) -> tuple[str, list[tuple[str, int, list[tuple[str, str]]]], int]:
    """(format, elements with their properties, where the body starts).  ValueError for lists and broken headers."""
    end = data.find(b"end_header")
    if not data.startswith(b"ply") or end < 0:
        raise ValueError("no whole header")
    body = data.find(b"\n", end) + 1
    kind, elements = None, []
    for line in data[:end].decode("ascii", "replace").splitlines()[1:]:
        word = line.split()
        if not word or word[0] in ("comment", "obj_info"):
            continue
        if word[0] == "format":
            kind = word[1]
        elif word[0] == "element":
            elements.append((word[1], int(word[2]), []))
        elif word[0] == "property":
            if word[1] == "list":
                raise ValueError("list properties are not supported")
            elements[-1][2].append((word[2], word[1]))
    if kind not in FORMATS:
        raise ValueError("format is missing or unknown")
    return kind, elements, body


def is_splat(data: bytes) -> bool:
    """Whether the first 4096 bytes name splat attributes before the header ends."""
    head = data[:4096].split(b"end_header")[0]
    return b"f_dc_0" in head and b"opacity" in head


def vertices(data: bytes) -> dict[str, np.ndarray]:
    """Columns of the vertex element."""
    kind, elements, at = header(data)
    for name, count, props in elements:
        dtype = np.dtype([(p, FORMATS[kind] + SCALARS[t]) for p, t in props])
        if kind == "ascii":
            lines = data[at:].split(b"\n", count)
            if name == "vertex":
                rows = np.array([x.split() for x in lines[:count]], float).reshape(count, len(props))
                return {p: rows[:, i].astype(SCALARS[t]) for i, (p, t) in enumerate(props)}
            at += sum(len(x) + 1 for x in lines[:count])
            continue
        if name == "vertex":
            if len(data) < at + count * dtype.itemsize:
                raise ValueError("vertex table is cut off")
            rows = np.frombuffer(data, dtype, count, at)
            return {p: rows[p] for p, _ in props}
        at += count * dtype.itemsize
    return {}


def pcd_points(data: bytes) -> np.ndarray:
    """x, y, z of a point cloud file in text or plain binary form.  ValueError for compressed bodies."""
    head: dict[str, list[str]] = {}
    at = 0
    while "DATA" not in head:
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("no whole header")
        word = data[at:end].decode("ascii", "replace").split()
        at = end + 1
        if word and not word[0].startswith("#"):
            head[word[0]] = word[1:]
    fields, n = head["FIELDS"], int(head["POINTS"][0])
    kinds = [{"F": "f", "I": "i", "U": "u"}[t] + s for t, s in zip(head["TYPE"], head["SIZE"])]
    if head["DATA"][0] == "ascii":
        rows = np.array([x.split() for x in data[at:].split(b"\n")[:n]], float).reshape(n, -1)
        return np.stack([rows[:, fields.index(a)] for a in "xyz"], axis=1)
    if head["DATA"][0] != "binary":
        raise ValueError("compressed bodies are not supported")
    repeat = [int(c) for c in head.get("COUNT", ["1"] * len(fields))]
    rows = np.frombuffer(data, np.dtype([(f, k, (c,)) if c > 1 else (f, k) for f, k, c in zip(fields, kinds, repeat)]), n, at)
    return np.stack([np.asarray(rows[a], float) for a in "xyz"], axis=1)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """file, pt_id, x, y, z of all .ply, .pcd and .npy files below a path; each file is parsed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("path rlike '[.](ply|pcd|npy)$'").select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content")):
                xyz = points_of(name, data.as_py())
                for at in range(0, len(xyz), 1 << 18):
                    part = xyz[at : at + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), *(pa.array(np.ascontiguousarray(part[:, i])) for i in range(3))], names=["file", "pt_id", "x", "y", "z"])

    return files.mapInArrow(run, "file string, pt_id bigint, x double, y double, z double")


def points_of(name: str, data: bytes) -> np.ndarray:
    if name.endswith(".npy"):
        import io

        return np.asarray(np.load(io.BytesIO(data)), float)[:, :3]
    if name.endswith(".pcd"):
        return pcd_points(data)
    v = vertices(data)
    return np.stack([np.asarray(v[a], float) for a in "xyz"], axis=1) if v else np.zeros((0, 3))


def read_splats(spark: SparkSession, path: str) -> DataFrame:
    """file, gid and the SPLAT columns (double) of splat files; attributes that a file lacks get their defaults."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.ply").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content")):
                if not is_splat(raw := data.as_py()):
                    continue
                v = vertices(raw)
                n = len(v["x"])
                cols = [np.asarray(v.get(c, np.full(n, DEFAULTS.get(c, 0.0))), float) for c in SPLAT]
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(n)), *map(pa.array, cols)], names=["file", "gid", *SPLAT])

    return files.mapInArrow(run, "file string, gid bigint, " + ", ".join(f"{c} double" for c in SPLAT))


def scene_splats(spark: SparkSession, path: str | None, rotation: list[list[float]] | None = None, shift: list[float] | None = None) -> DataFrame | None:
    """The splats that belong to a scene, in its levelled frame; None where the scene names no splat file."""
    from ..functions.geometry import align

    if not path:
        return None
    splats = read_splats(spark, path)
    if rotation is None:
        return splats
    return splats.withColumns(dict(zip("xyz", align("x", "y", "z", rotation, shift or [0.0, 0.0, 0.0]))))


def prepared(splats: DataFrame, cut: float = float("inf"), cut_low: float = float("-inf")) -> DataFrame:
    """Splats between two heights, with their three scales, opacity, unit quaternion and colour decoded."""
    norm = F.sqrt(sum((F.col(f"rot_{i}") * F.col(f"rot_{i}") for i in (1, 2, 3)), F.col("rot_0") * F.col("rot_0")))
    clip = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    new = {f"scale_{i}": F.exp(f"scale_{i}") for i in range(3)} | {f"rot_{i}": F.col(f"rot_{i}") / norm for i in range(4)}
    new |= {"opacity": 1.0 / (1.0 + F.exp(-F.col("opacity")))} | {c: clip(0.5 + C.SH_C0 * F.col(f"f_dc_{i}")) for i, c in enumerate(("red", "green", "blue"))}
    return splats.where((F.col("z") <= cut) & (F.col("z") >= cut_low)).withColumns(new)


def decoded(splats: DataFrame) -> DataFrame:
    """Splats with scale, opacity, unit quaternion part and red share from their raw columns."""
    norm = F.sqrt(F.col("qw") * F.col("qw") + F.col("qx") * F.col("qx") + F.col("qy") * F.col("qy") + F.col("qz") * F.col("qz"))
    red = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + C.SH_C0 * F.col("f_dc")))
    return splats.withColumns({"scale": F.exp("log_scale"), "opacity": 1.0 / (1.0 + F.exp(-F.col("raw_opacity"))), "qw_n": F.col("qw") / norm, "red": red})


def ply_bytes(columns: dict[str, np.ndarray]) -> bytes:
    """A little-endian vertex table of float32 properties."""
    n = len(next(iter(columns.values()))) if columns else 0
    head = "ply\nformat binary_little_endian 1.0\n" + f"element vertex {n}\n" + "".join(f"property float {c}\n" for c in columns) + "end_header\n"
    table = np.zeros(n, [(c, "<f4") for c in columns])
    for c, v in columns.items():
        table[c] = v
    return head.encode() + table.tobytes()


def ply_parts(points: DataFrame, columns: list[str]) -> DataFrame:
    """part, content: a whole .ply file for each partition, made where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [{c: b.column(c).to_numpy(zero_copy_only=False) for c in columns} for b in batches if b.num_rows]
        if rows:
            data = ply_bytes({c: np.concatenate([x[c] for x in rows]) for c in columns})
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["content"])

    return points.select(*columns).mapInArrow(run, "content binary")


class PlySource:
    """Lazily made data source ``ply``: spark.read.format("ply").load(path)."""

    @staticmethod
    def register(spark: SparkSession) -> None:
        from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

        class Reader(DataSourceReader):
            def __init__(self, path: str) -> None:
                self.path = path

            def partitions(self):
                import glob
                import os

                names = sorted(glob.glob(os.path.join(self.path, "**", "*.ply"), recursive=True)) if os.path.isdir(self.path) else [self.path]
                return [InputPartition(n) for n in names]

            def read(self, partition):
                with open(partition.value, "rb") as f:
                    xyz = points_of(partition.value, f.read())
                for i, (x, y, z) in enumerate(xyz.tolist()):
                    yield partition.value, i, x, y, z

        class Source(DataSource):
            @classmethod
            def name(cls):
                return "ply"

            def schema(self):
                return T.StructType([T.StructField("file", T.StringType()), T.StructField("pt_id", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in "xyz")])

            def reader(self, schema):
                return Reader(self.options["path"])

        spark.dataSource.register(Source)
