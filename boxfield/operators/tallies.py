"""What is counted of the points near each box, in numpy where the points are.

Pairs of points and boxes are never rows: each task orders its points by strips of x
and by y, takes for each box the runs of points in its rectangle, and gives a few
rows for the box, so neither the pairs nor the points are shuffled.  Boxes are sent
to the tasks, ``BOXES_AT_ONCE`` at most; of more boxes, the points are read once for
each block of so many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Width of a strip in metres, points worked on at once, boxes sent at once.
STRIP, ROWS_AT_ONCE, BOXES_AT_ONCE = 0.25, 1 << 20, 20_000
OF_BOX = ("cx", "cy", "cz", "sl", "sw", "sh", "__x0", "__x1", "__y0", "__y1", "__cos", "__sin")


class Box:
    """The numbers of one box: centre, size, rectangle, cosine and sine; ``more`` has the columns asked for beside."""

    def __init__(self, values: list, more: dict) -> None:
        self.cx, self.cy, self.cz, self.sl, self.sw, self.sh, self.x0, self.x1, self.y0, self.y1, self.c, self.s = values
        self.more = more


class Near(NamedTuple):
    """Points about a box: whether they lie in its rectangle, their local and their own coordinates."""

    near: np.ndarray
    u: np.ndarray
    v: np.ndarray
    k: np.ndarray
    x: np.ndarray
    y: np.ndarray
    z: np.ndarray
    more: dict[str, np.ndarray] = {}


class Strips:
    """Points in strips of x, each strip ordered by y; ``more`` has other numbers of the points."""

    def __init__(self, x: np.ndarray, y: np.ndarray, z: np.ndarray, more: dict[str, np.ndarray] | None = None) -> None:
        strip = np.floor(x / STRIP)
        self.order = np.lexsort((y, strip))
        self.x, self.y, self.z = x[self.order], y[self.order], z[self.order]
        self.more = {c: v[self.order] for c, v in (more or {}).items()}
        self.names, self.starts = np.unique(strip[self.order], return_index=True)
        self.ends = np.r_[self.starts[1:], len(x)]

    def runs(self, b: Box) -> list[slice]:
        """Where points between the box's borders in y lie, in all strips that its rectangle touches."""
        out = []
        for j in range(*self.names.searchsorted([np.floor(b.x0 / STRIP), np.floor(b.x1 / STRIP) + 1])):
            first, y = self.starts[j], self.y[self.starts[j] : self.ends[j]]
            lo, hi = y.searchsorted(b.y0), y.searchsorted(b.y1, "right")
            if lo < hi:
                out.append(slice(first + lo, first + hi))
        return out

    def local(self, b: Box, at: list[slice] | np.ndarray) -> Near:
        x, y, z, *rest = (np.concatenate([a[s] for s in at]) if isinstance(at, list) else a[at] for a in (self.x, self.y, self.z, *self.more.values()))
        near = (x >= b.x0) & (x <= b.x1)
        dx, dy = x - b.cx, y - b.cy
        return Near(near, dx * b.c + dy * b.s, dy * b.c - dx * b.s, z - b.cz, x, y, z, dict(zip(self.more, rest)))


def chunks(batches: Iterator[pa.RecordBatch], rows: int | None = None) -> Iterator[pa.Table]:
    """Batches put together to about ``rows`` (ROWS_AT_ONCE) rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= (rows or ROWS_AT_ONCE):
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def by_scene(part: pa.Table, scene: list[str]) -> Iterator[tuple[object, np.ndarray | slice]]:
    """(scene or None, rows of it); rows without a scene, where there are scenes, belong to none."""
    if not scene:
        yield None, slice(None)
        return
    codes = part.column(scene[0]).combine_chunks().dictionary_encode()
    index = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    order = np.argsort(index, kind="stable")
    found, starts = np.unique(index[order], return_index=True)
    for code, rows in zip(found, np.split(order, starts[1:])):
        if code >= 0:
            yield codes.dictionary[int(code)].as_py(), rows


def coordinates(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y, z; a missing one is no number, which lies in no box."""
    return tuple(part.column(c).to_numpy().astype(float, copy=False) for c in ("x", "y", "z"))


def boxes_of(wide: DataFrame, scene: list[str], more: tuple[str, ...]) -> list[tuple[list, dict]]:
    """Blocks of at most BOXES_AT_ONCE boxes: (their ids, scene -> [(row in ids, Box)])."""
    rows = wide.select("box_id", *scene, *(F.col(c).cast("double") for c in OF_BOX), *more).where(" and ".join(f"{c} is not null" for c in (*scene, *OF_BOX)))
    rows = rows.toPandas()
    # In one order in every run; boxes near each other are in one block.
    rows = rows.sort_values(["__x0", "__y0", "box_id"], ignore_index=True)
    out = []
    for start in range(0, len(rows), BOXES_AT_ONCE):
        part = rows.iloc[start : start + BOXES_AT_ONCE]
        of: dict = {}
        named = part[list(more)].to_dict("records") if more else [{}] * len(part)
        for i, (values, extra, at) in enumerate(zip(part[list(OF_BOX)].to_numpy(float).tolist(), named, part[scene[0]].tolist() if scene else [None] * len(part))):
            of.setdefault(at, []).append((i, Box(values, extra)))
        out.append((part["box_id"].tolist(), of))
    return out


def tallies(points: DataFrame, wide: DataFrame, scene: list[str], tally: Callable, ddl: str, more: tuple[str, ...] = (), of_point: tuple[str, ...] = ()) -> DataFrame:
    """box_id and the columns ``ddl``, of each box and each part of the points.

    ``tally(box, points)`` gives arrays of one length, one for each column, or None.
    ``wide`` has the boxes with their rectangles, ``more`` names columns of it that the
    tally reads, ``of_point`` columns of the points, numbers that it reads beside x, y, z.
    """
    fields = T._parse_datatype_string(ddl).fields
    id_type = to_arrow_type(wide.schema["box_id"].dataType)
    names, types = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]
    schema = T.StructType([wide.schema["box_id"], *fields])

    def of_block(ids: list, boxes: dict) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            all_ids = pa.array(ids, id_type)
            for part in chunks(batches):
                x, y, z = coordinates(part)
                other = {c: part.column(c).to_numpy().astype(float, copy=False) for c in of_point}
                at, made = [], []
                for name, rows in by_scene(part, scene):
                    mine = boxes.get(name)
                    if not mine:
                        continue
                    strips = Strips(x[rows], y[rows], z[rows], {c: v[rows] for c, v in other.items()})
                    for i, b in mine:
                        if (runs := strips.runs(b)) and (found := tally(b, strips.local(b, runs))) is not None and len(found[0]):
                            at.append(np.full(len(found[0]), i))
                            made.append(found)
                if made:
                    columns = [pa.array(np.concatenate([m[j] for m in made]), t) for j, t in enumerate(types)]
                    yield pa.RecordBatch.from_arrays([all_ids.take(pa.array(np.concatenate(at))), *columns], names=["box_id", *names])

        return run

    source = points.select(*scene, *(F.col(c).cast("double").alias(c) for c in ("x", "y", "z", *of_point))).where(" and ".join(f"{c} is not null and not isnan({c})" for c in ("x", "y", "z", *of_point)))
    blocks = boxes_of(wide, scene, more) or [([], {})]
    return reduce(DataFrame.unionByName, (source.mapInArrow(of_block(*b), schema) for b in blocks))


def marked(points: DataFrame, wide: DataFrame, scene: list[str], test: Callable) -> DataFrame:
    """The points for which ``test(box, points)`` holds with any box; a point that has met one is not tried again."""
    blocks = boxes_of(wide, scene, ())

    def run(boxes: dict) -> Callable:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in chunks(batches):
                x, y, z = coordinates(part)
                met = np.zeros(len(x), bool)
                for name, rows in by_scene(part, scene):
                    mine = boxes.get(name, [])
                    mine = [mine[i] for i in np.random.default_rng(0).permutation(len(mine))]  # the first ones lie all over
                    rows = np.arange(len(x))[rows]
                    for start in range(0, len(mine), 64):
                        # Those that are left are put in order anew, so later boxes look at few.
                        rows = rows[~met[rows]]
                        if not len(rows):
                            break
                        strips = Strips(x[rows], y[rows], z[rows])
                        own = np.zeros(len(rows), bool)
                        for _, b in mine[start : start + 64]:
                            for s in strips.runs(b):
                                left = s.start + np.flatnonzero(~own[s])
                                if len(left):
                                    own[left] = test(b, strips.local(b, left))
                        met[rows[strips.order[own]]] = True
                for b in part.append_column("__met", pa.array(met)).to_batches():
                    yield b

        return work

    out = points.select("*", F.lit(False).alias("__met"))
    schema = T.StructType([*points.schema.fields, T.StructField("__met", T.BooleanType())])
    rest, kept = points, None
    for _, boxes in blocks:
        out = rest.mapInArrow(run(boxes), schema)
        one = out.where("__met").drop("__met")
        kept = one if kept is None else kept.unionByName(one)
        rest = out.where("not __met").drop("__met")
    return points.where("false") if kept is None else kept


def within(b: Box, p: Near, margin: float = 0.0) -> np.ndarray:
    """Which of a box's points lie in it grown by ``margin``, borders included."""
    return np.flatnonzero(p.near & (np.abs(p.u) <= b.sl / 2 + margin) & (np.abs(p.v) <= b.sw / 2 + margin) & (np.abs(p.k) <= b.sh / 2 + margin))


def occupied(cell: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, bits): the cells that occur among ``total``, 64 to a word; no row for each cell."""
    if total <= 64 * len(cell):
        seen = np.zeros(-(-total // 64) * 64, bool)
        seen[cell] = True
        bits = np.packbits(seen, bitorder="little").view("<i8")
        word = np.flatnonzero(bits)
        return word, bits[word]
    cell = np.unique(cell)
    word, start = np.unique(cell >> 6, return_index=True)
    return word, np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (cell & 63).astype(np.uint64)), start).view("<i8") if len(cell) else np.zeros(0, "<i8")


#: Columns of what ``cells_held`` gives.
HELD = "part int, word bigint, bits bigint, n bigint"


def cells_held(part: int, cell: np.ndarray, total: int) -> tuple[np.ndarray, ...] | None:
    """Rows of HELD for the points' cells; the first tells how many points there are."""
    if not len(cell):
        return None
    word, bits = occupied(cell, total)
    n = np.zeros(len(word), np.int64)
    n[0] = len(cell)
    return np.full(len(word), part, np.int32), word, bits, n


def held(rows: DataFrame, n: str, cells: str) -> DataFrame:
    """(box_id, part,) the points and the cells that they hold, from rows of HELD."""
    words = rows.groupBy("box_id", "part", "word").agg(F.bit_or("bits").alias("__bits"), F.sum("n").alias("__n"))
    return words.groupBy("box_id", "part").agg(F.sum("__n").alias(n), F.sum(F.bit_count("__bits")).cast("bigint").alias(cells))
