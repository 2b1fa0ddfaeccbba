"""The nearest places of each place, found in numpy tile by tile.

Space is cut into tiles of about ``TILE`` places, by medians of a sample (which sets
the borders only).  Each place goes to its tile, and to those whose border it is near;
places travel packed, a row for a tile and a part of the points, equal ones once with a
weight.  A task searches a tile on a grid whose cells widen until all have enough
neighbours.  A place whose neighbours may lie beyond what its tile holds is searched
again in all tiles that the ball of its found neighbours touches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .spatial import scene_keys
from .tallies import by_scene, chunks, coordinates

#: Places in a tile, places looked at to set borders, points packed at once, pieces sent at once, pairs in memory at once.
TILE, LOOKED_AT, PACKED_AT_ONCE, SENT_AT_ONCE, PAIRS_AT_ONCE = 100_000, 100_000, 1 << 18, 64, 400_000
AXES = ("x", "y", "z")
PACKED = "tile int, piece bigint, asked boolean, x binary, y binary, z binary, w binary, own binary, r binary"


class Leaf:
    """A tile: its number, its borders and how far beyond these it holds places."""

    def __init__(self, tile: int, low: np.ndarray, high: np.ndarray, halo: float) -> None:
        self.tile, self.low, self.high, self.halo = tile, low, high, halo
        self.reach = halo


class Fork:
    """Left of ``at`` along an axis and from it on."""

    def __init__(self, axis: int, at: float, left, right) -> None:
        self.axis, self.at, self.left, self.right = axis, at, left, right
        self.reach = max(left.reach, right.reach)


def unique_places(xyz: np.ndarray, w: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places in order, their summed weights, and what else is known of one of each."""
    order = np.lexsort((xyz[1], xyz[2], xyz[0]))
    xyz = xyz[:, order]
    new = np.r_[True, (xyz[:, 1:] != xyz[:, :-1]).any(0)] if len(order) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return (xyz[:, at], np.add.reduceat(w[order], at) if len(at) else w, *(m[order][at] for m in more))


def halo_of(xyz: np.ndarray, share: float, k: int) -> float:
    """About how far the k nearest of a tile's places are, by how far those of its looked-at places are, and some more."""
    some = xyz[:, :: max(1, xyz.shape[1] // 64)]
    j = min(4, xyz.shape[1] - 1)
    if j < 1:
        return 0.0
    d = sum((a[:, None] - b[None, :]) ** 2 for a, b in zip(some, xyz))
    return 1.6 * float(np.quantile(np.sqrt(np.partition(d, j, axis=1)[:, j]), 0.9)) * min(1.0, k * share / j) ** (1 / 3)


def tree_of(xyz: np.ndarray, w: np.ndarray, share: float, k: int):
    """The tiles of a scene by its looked-at places, which are ``share`` of all."""
    count = [0]

    def cut(rows: np.ndarray, low: np.ndarray, high: np.ndarray):
        own = xyz[:, rows]
        span = own.max(1) - own.min(1) if len(rows) else np.zeros(3)
        if (len(rows) <= TILE * share and w[rows].sum() <= 4 * TILE * share) or not span.max() > 0:
            count[0] += 1
            return Leaf(count[0] - 1, low, high, halo_of(own, share, k))
        axis = int(span.argmax())
        v = own[axis]
        at = np.partition(v, len(v) // 2)[len(v) // 2]
        at = at if (v < at).any() else v[v > at].min()
        at = float((v[v < at].max() + at) / 2)
        at = at if (v < at).any() else float(v[v > v.min()].min())
        left, right = high.copy(), low.copy()
        left[axis] = right[axis] = at
        return Fork(axis, at, cut(rows[v < at], low, left), cut(rows[v >= at], right, high))

    return cut(np.arange(xyz.shape[1]), np.full(3, -np.inf), np.full(3, np.inf))


def leaves(node) -> Iterator[Leaf]:
    if isinstance(node, Leaf):
        yield node
    else:
        yield from leaves(node.left)
        yield from leaves(node.right)


def held_by(node, xyz: np.ndarray, rows: np.ndarray, own: np.ndarray, halo: bool) -> Iterator[tuple[Leaf, np.ndarray, np.ndarray]]:
    """(tile, rows, whether they are its own) of all tiles that hold any of the places; with ``halo`` those near their borders too."""
    if isinstance(node, Leaf):
        if halo and len(rows):
            near = own | ((xyz[:, rows] >= (node.low - node.halo)[:, None]) & (xyz[:, rows] <= (node.high + node.halo)[:, None])).all(0)
            rows, own = rows[near], own[near]
        if len(rows):
            yield node, rows, own
        return
    v = xyz[node.axis, rows]
    e = node.reach if halo else 0.0
    a, b = (v < node.at + e, v >= node.at - e) if halo else (v < node.at, v >= node.at)
    yield from held_by(node.left, xyz, rows[a], own[a] & (v[a] < node.at), halo)
    yield from held_by(node.right, xyz, rows[b], own[b] & (v[b] >= node.at), halo)


def touched_by(node, xyz: np.ndarray, r: np.ndarray, rows: np.ndarray) -> Iterator[tuple[Leaf, np.ndarray]]:
    """(tile, rows) of the tiles that the balls around the places touch."""
    if not len(rows):
        return
    if isinstance(node, Leaf):
        yield node, rows
        return
    v = xyz[node.axis, rows]
    yield from touched_by(node.left, xyz, r, rows[v - r[rows] <= node.at])
    yield from touched_by(node.right, xyz, r, rows[v + r[rows] >= node.at])


def beside(c: np.ndarray) -> np.ndarray:
    """Numbers of cells along an axis with gaps shortened, so that neighbours stay neighbours and keys stay small."""
    found, at = np.unique(c, return_inverse=True)
    return np.r_[1, 1 + np.cumsum(np.minimum(np.diff(found), 2))].astype(np.int64)[at]


def widths(xyz: np.ndarray, q: np.ndarray, most: int) -> list[float]:
    """Widths of cells to try, by how far the neighbours of a few places are."""
    some = q[:: max(1, len(q) // 24)][:32]
    far = [float(np.sqrt(np.partition(sum((a - a[i]) ** 2 for a in xyz), min(most, xyz.shape[1] - 1))[min(most, xyz.shape[1] - 1)])) for i in some]
    out: list[float] = []
    for d in sorted(f for f in far if f > 0):
        if not out or d > out[-1][0] * 1.5:
            out.append([d, d])
        out[-1][1] = d
    return [1.02 * d for _, d in out] or [1.0]


def search(xyz: np.ndarray, w: np.ndarray, q: np.ndarray, k: int, cell: float | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(rows of q, d, rows of neighbours, their weights that count, whether these are enough, the farthest's distance), a few at a time.

    The k nearest points of a place are its own others first, then those of the nearest places.
    """
    n = xyz.shape[1]
    q = q[w[q] < k]
    if not len(q):
        return
    most = int(min(k - w[q].min(), n))
    typical = max(1, int(np.ceil((k - 1) / max(1.0, float(np.median(w))))))
    tried = [cell] if cell else widths(xyz, q, min(most, typical))
    reach = float((xyz.max(1) - xyz.min(1)).max())
    step = 0
    while len(q):
        c = tried[step] if step < len(tried) else tried[-1] * 1.5 ** (step - len(tried) + 1)
        step += 1
        last = c > reach
        c = max(c, reach / 1e12, 1e-300)
        axes = [beside(np.floor((a - a.min()) / c)) for a in xyz]
        # The axis with most cells comes last: neighbours along it are one run.
        axes.sort(key=lambda a: int(a.max()))
        sizes = [int(a.max()) + 2 for a in axes]
        key = (axes[0] * sizes[1] + axes[1]) * sizes[2] + axes[2]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        cells, of = np.unique(key[q], return_inverse=True)
        base = cells[:, None] + np.array([(i * sizes[1] + j) * sizes[2] for i in (-1, 0, 1) for j in (-1, 0, 1)])
        lo, hi = np.searchsorted(ordered, base - 1), np.searchsorted(ordered, base + 1, "right")
        size = (hi - lo).sum(1)
        by_size = np.argsort(size, kind="stable")
        rank = np.empty(len(cells), np.int64)
        rank[by_size] = np.arange(len(cells))
        turn = np.argsort(rank[of], kind="stable")
        q, of = q[turn], of[turn]
        lo, hi, size, of = lo[by_size], hi[by_size], size[by_size], rank[of]
        open_ = np.ones(len(q), bool)
        at = 0
        while at < len(q):
            # As many places as keep the pairs few; a crowded cell's places may take several turns.
            end = at + max(1, PAIRS_AT_ONCE // max(1, size[of[at]]))
            while end > at + 1 and (min(end, len(q)) - at) * size[of[min(end, len(q)) - 1]] > PAIRS_AT_ONCE:
                end = at + (end - at) // 2
            end = min(max(end, at + 1), len(q))
            mine, cell0, cell1 = q[at:end], of[at], of[end - 1] + 1
            l, length = lo[cell0:cell1].ravel(), (hi - lo)[cell0:cell1].ravel()
            wide = int(size[cell1 - 1])
            flat = np.repeat(l - np.cumsum(length) + length, length) + np.arange(length.sum())
            sizes_ = size[cell0:cell1]
            cand = np.full((cell1 - cell0, wide), -1)
            cand[np.arange(wide)[None, :] < sizes_[:, None]] = order[flat]
            cand = cand[of[at:end] - cell0]
            d = sum((a[cand] - a[mine][:, None]) ** 2 for a in xyz)
            d[(cand < 0) | (cand == mine[:, None])] = np.inf
            if most < wide:
                best = np.argpartition(d, most - 1, axis=1)[:, :most]
                d, cand = np.take_along_axis(d, best, 1), np.take_along_axis(cand, best, 1)
            best = np.argsort(d, axis=1, kind="stable")
            d, cand = np.sqrt(np.take_along_axis(d, best, 1)), np.take_along_axis(cand, best, 1)
            weight = np.where(np.isfinite(d), w[cand], 0)
            need = (k - w[mine])[:, None]
            counts = np.clip(np.minimum(weight, need - np.cumsum(weight, 1) + weight), 0, None)
            enough = counts.sum(1) >= need[:, 0]
            far = np.where(counts > 0, d, 0.0).max(1, initial=0.0)
            done = (enough & (far <= c)) | last
            open_[at:end] = ~done
            if done.any():
                yield mine[done], np.where(counts[done] > 0, d[done], 0.0), cand[done], counts[done], enough[done], far[done]
            at = end
        q = q[open_]


def mean_distance(xyz, w, q, d, near, counts) -> np.ndarray:
    """Mean distance to the nearest points, the point itself counted as one at 0; no number without others."""
    total = counts.sum(1)
    return np.where(total > 0, (d * counts).sum(1) / np.maximum(total + w[q], 1), np.where(w[q] > 1, 0.0, np.nan))


def normal_lean(xyz, w, q, d, near, counts) -> np.ndarray:
    """How much the normal of the nearest points (itself included) leans towards z; 0 where all are one place."""
    off = [a[near] - a[q][:, None] for a in xyz]
    total = (counts.sum(1) + w[q]).astype(float)
    mean = [(o * counts).sum(1) / total for o in off]
    m = np.empty((len(q), 3, 3))
    for i in range(3):
        for j in range(i, 3):
            m[:, i, j] = m[:, j, i] = (off[i] * off[j] * counts).sum(1) / total - mean[i] * mean[j]
    return np.where(counts.sum(1) > 0, np.abs(np.linalg.eigh(m)[1][:, 2, 0]), 0.0)


class Tiles:
    """The points of a table (with scenes, with or without __n) in tiles, and the searches in them."""

    def __init__(self, points: DataFrame, k: int) -> None:
        self.k, self.scene = k, scene_keys(points)
        weight = F.col("__n") if "__n" in points.columns else F.lit(1)
        self.known = " and ".join([*(f"{s} is not null" for s in self.scene), *(f"{c} is not null and not isnan({c}) and abs({c}) < double('inf')" for c in AXES)])
        self.points = points.select(*self.scene, *(F.col(c).cast("double").alias(c) for c in AXES), weight.cast("bigint").alias("__n")).where(self.known)
        n = self.points.count()
        self.share = min(1.0, LOOKED_AT / max(1, n))
        some = self.points if self.share == 1.0 else self.points.where(F.pmod(F.xxhash64(*AXES), F.lit(1 << 30)) < int(self.share * (1 << 30)))
        rows = some.groupBy(*self.scene, *AXES).agg(F.count(F.lit(1)).alias("__n")).toPandas()
        # In one order, so that tiles do not depend on how the points were dealt.
        rows = rows.sort_values([*self.scene, *AXES], ignore_index=True)
        parts = rows.groupby(self.scene[0]) if self.scene else [(None, rows)]
        self.trees = {name: tree_of(p[list(AXES)].to_numpy(float).T, p["__n"].to_numpy(), self.share, k) for name, p in parts}
        self.types = [points.schema[s] for s in self.scene]
        self.packed = self.schema(PACKED)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "points"}  # tasks have their own part of these

    def schema(self, ddl: str) -> T.StructType:
        return T.StructType([*self.types, *T._parse_datatype_string(ddl).fields])

    def _rows(self, made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], to_arrow_type(f.dataType)) for i, f in enumerate(self.packed.fields)], names=self.packed.names)

    def tree(self, name):
        return self.trees.get(name) or Leaf(0, np.full(3, -np.inf), np.full(3, np.inf), 0.0)

    def pieces(self, only: set | None = None) -> DataFrame:
        """Packed places of each part of the points by tile, those near its borders too; of the tiles ``only``, their own places alone."""
        scene, me = self.scene, self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = TaskContext.get().partitionId() << 32
            for part in chunks(batches, PACKED_AT_ONCE):
                xyz, w, made = np.stack(coordinates(part)), part.column("__n").to_numpy(), []
                for name, rows in by_scene(part, scene):
                    spots, weight = unique_places(xyz[:, rows], w[rows])
                    for leaf, at, own in held_by(me.tree(name), spots, np.arange(spots.shape[1]), np.ones(spots.shape[1], bool), only is None):
                        if only is None or (name, leaf.tile) in only:
                            n += 1
                            made.append((*([name] if scene else []), leaf.tile, n, False, *(spots[i][at].tobytes() for i in range(3)), weight[at].astype("<i8").tobytes(), own.tobytes(), b""))
                for i in range(0, len(made), SENT_AT_ONCE):
                    yield me._rows(made[i : i + SENT_AT_ONCE])

        return self.points.mapInArrow(run, self.packed)

    def asked(self, rows: DataFrame) -> DataFrame:
        """Packed places (with w, r) by the tiles that the balls of radius r around them touch."""
        scene, me = self.scene, self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = TaskContext.get().partitionId() << 32
            for part in chunks(batches):
                xyz, w, r, made = np.stack(coordinates(part)), part.column("__n").to_numpy(), part.column("r").to_numpy(), []
                for name, at in by_scene(part, scene):
                    own, far = xyz[:, at], r[at]
                    for leaf, hit in touched_by(me.tree(name), own, far, np.arange(own.shape[1])):
                        n += 1
                        made.append((*([name] if scene else []), leaf.tile, n, True, *(own[i][hit].tobytes() for i in range(3)), w[at][hit].astype("<i8").tobytes(), b"", far[hit].tobytes()))
                for i in range(0, len(made), SENT_AT_ONCE):
                    yield me._rows(made[i : i + SENT_AT_ONCE])

        return rows.select(*scene, *AXES, "__n", "r").mapInArrow(run, self.packed)

    def unpack(self, table: pa.Table, asked: bool) -> tuple[np.ndarray, ...]:
        mine = table.filter(pc.equal(table["asked"], asked))
        read = lambda c, t: np.frombuffer(b"".join(mine[c].to_pylist()), t)
        xyz, w = np.stack([read(c, "<f8") for c in AXES]), read("w", "<i8")
        return (xyz, w, read("r", "<f8")) if asked else unique_places(xyz, w, read("own", "?"))

    def measured(self, pieces: DataFrame, measure: Callable, cell: float | None) -> DataFrame:
        """(scene_id,) x, y, z, __n, v and r of all places: what ``measure`` finds, and where it is not certain how far to look (else null)."""
        me, k = self, self.k
        schema = self.schema("x double, y double, z double, __n bigint, v double, r double")

        def run(key, table):
            name, tile = (key[0].as_py() if me.scene else None), key[-1].as_py()
            leaf = next(t for t in leaves(me.tree(name)) if t.tile == tile)
            xyz, w, own = me.unpack(table, False)
            v, r = np.full(len(w), 0.0), np.full(len(w), np.nan)
            low, high = leaf.low - leaf.halo, leaf.high + leaf.halo
            for q, d, near, counts, enough, far in search(xyz, w, np.flatnonzero(own), k, cell):
                v[q] = measure(xyz, w, q, d, near, counts)
                border = np.minimum(xyz[:, q] - low[:, None], high[:, None] - xyz[:, q]).min(0)
                inner = (enough & (far < border)) | np.isinf(border)
                r[q] = np.where(inner, np.nan, np.where(enough, far, np.inf))
            spots = xyz[:, own]
            columns = [*([pa.array([name] * int(own.sum()), to_arrow_type(me.types[0].dataType))] if me.scene else []), *map(pa.array, spots), pa.array(w[own]), pa.array(v[own], from_pandas=True), pa.array(r[own], from_pandas=True)]
            return pa.Table.from_arrays(columns, names=schema.names)

        return pieces.groupBy(*self.scene, "tile").applyInArrow(run, schema)

    def neighbours(self, open_: DataFrame) -> DataFrame:
        """(scene_id,) x, y, z, __n, d, x2, y2, z2 and __t, how many of its points count, of the places around the places ``open_`` (with r)."""
        me, k = self, self.k
        asked = self.asked(open_)
        only = {(r[0] if self.scene else None, r["tile"]) for r in asked.select(*self.scene, "tile").distinct().collect()}
        schema = self.schema("x double, y double, z double, __n bigint, d double, x2 double, y2 double, z2 double, __m bigint")

        def run(key, table):
            name = key[0].as_py() if me.scene else None
            (xyz, w, _), (qs, qw, qr) = me.unpack(table, False), me.unpack(table, True)
            out = []
            for q, n, r in zip(qs.T, qw, qr):
                a, b = np.searchsorted(xyz[0], [q[0] - r * (1 + 1e-9), q[0] + r * (1 + 1e-9)])  # places come in order of x
                d = np.sqrt(sum((c[a:b] - p) ** 2 for c, p in zip(xyz, q)))
                d[(xyz[:, a:b] == q[:, None]).all(0)] = np.inf
                best = np.argpartition(d, k)[:k] if len(d) > k else np.arange(len(d))
                best = best[np.isfinite(d[best]) & (d[best] <= r * (1 + 1e-9))]
                out.append(np.vstack([np.repeat(q[:, None], len(best), 1), np.full(len(best), n), d[best], xyz[:, a:b][:, best], w[a:b][best]]))
            m = np.hstack(out) if out else np.zeros((9, 0))
            columns = [*([pa.array([name] * m.shape[1], to_arrow_type(me.types[0].dataType))] if me.scene else []), *map(pa.array, m[:3]), pa.array(m[3].astype(np.int64)), *map(pa.array, m[4:8]), pa.array(m[8].astype(np.int64))]
            return pa.Table.from_arrays(columns, names=schema.names)

        near = self.pieces(only).unionByName(asked).groupBy(*self.scene, "tile").applyInArrow(run, schema)
        before = F.coalesce(F.sum("__m").over(Window.partitionBy(*self.scene, *AXES).orderBy("d", "x2", "y2", "z2").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return near.withColumn("__t", F.greatest(F.lit(0), F.least("__m", k - F.col("__n") - before))).where("__t > 0").drop("__m")
