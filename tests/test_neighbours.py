"""Nearest places by tiles: against all pairs, with many small tiles, and that no row is made for a place and a cell around it."""

from __future__ import annotations

import math

import numpy as np
import pytest

from boxfield.operators import estimators as E
from boxfield.operators import neighbours as N
from boxfield.plans import registry


def cloud(scenes: bool):
    """A dense part, a sparse part, far points, a lattice with copies; with scenes of all sizes."""
    rng = np.random.default_rng(5)
    xyz = np.r_[rng.uniform(0, 1, (500, 3)), rng.uniform(-20, 20, (150, 3)), [[900.0, 0, 0], [0, -700.0, 3]], np.round(rng.uniform(3, 4, (400, 3)), 1)]
    return [(*map(float, p), int(i % 3 if i < 1040 else 7)) for i, p in enumerate(xyz)] + [(None, 1.0, 1.0, 0), (math.nan, 1.0, 1.0, 1)], "x double, y double, z double, scene_id int"


def mean_of(own: np.ndarray, k: int) -> dict:
    out = {}
    for p in np.unique(own, axis=0):
        d = np.sort(np.sqrt(((own - p) ** 2).sum(1)))[:k]
        out[tuple(p)] = d.sum() / len(d) if len(d) > 1 else None
    return out


@pytest.mark.parametrize("scenes", (False, True))
def test_nearest_by_tiles_are_those_of_all_pairs(spark, monkeypatch, scenes):
    """Tiles of a few places, so that most balls leave their tile, and few looked at."""
    monkeypatch.setattr(N, "TILE", 60)
    monkeypatch.setattr(N, "LOOKED_AT", 300)
    rows, ddl = cloud(scenes)
    points = spark.createDataFrame(rows, ddl).repartition(5)
    points = points if scenes else points.drop("scene_id")
    got = {(r.scene_id if scenes else 0, r.x, r.y, r.z): r.mean_d for r in E.nearest_distances(points, 8).collect() if r.x is not None and not math.isnan(r.x)}
    known = [r for r in rows if r[0] is not None and not math.isnan(r[0])]
    want = {}
    for s in {r[3] for r in known} if scenes else (0,):
        want |= {(s, *p): d for p, d in mean_of(np.array([r[:3] for r in known if not scenes or r[3] == s]), 8).items()}
    assert got.keys() == want.keys()
    assert all(got[p] == pytest.approx(want[p], rel=1e-9, abs=1e-12) for p in want)


def test_normals_do_not_depend_on_tiles(spark, monkeypatch):
    rng = np.random.default_rng(6)
    flat = np.c_[rng.uniform(0, 2, 400), rng.uniform(0, 2, 400), rng.normal(0, 0.001, 400)]
    wall = np.c_[rng.normal(1.0, 0.001, 400), rng.uniform(0, 2, 400), rng.uniform(0, 2, 400)]
    points = spark.createDataFrame([tuple(map(float, p)) for p in np.r_[flat, wall]], "x double, y double, z double")
    whole = sorted(map(tuple, E.upright(points).collect()))
    monkeypatch.setattr(N, "TILE", 50)
    assert sorted(map(tuple, E.upright(points).collect())) == whole and 300 < len(whole) < 500


@pytest.mark.parametrize("name", ("denoise_cloud", "yaw_vote"))
def test_places_are_not_written_for_each_cell_around(spark, sf, monkeypatch, name):
    """Places travel packed in tiles: what the search is given has few rows, and no cells around."""
    monkeypatch.setattr(E, "neighbour_cells", lambda cells, keys, *a: pytest.fail("27 rows for a place") if len(keys) == 3 else N_cells(cells, keys, *a))
    given, real = [], E.nearest
    monkeypatch.setattr(E, "nearest", lambda pieces, *a, **k: given.append(pieces.count()) or real(pieces, *a, **k))
    assert registry.QUERIES[name](spark, sf).count() > 0
    assert given and max(given) < 50


N_cells = E.neighbour_cells
