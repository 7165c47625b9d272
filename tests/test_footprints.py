"""Footprints in discs, summed in tiles, against pairs one by one."""

import math

import numpy as np
import pytest

from streetloom.functions import kernels as K
from streetloom.operators import polygons, spatial_join


def _convex_cut(ring, radius, sides):
    """Area of an open ring inside the regular polygon around the origin, cut side by side."""
    p = [tuple(v) for v in ring]
    for k in range(sides):
        a = (k + 0.5) * 2 * math.pi / sides
        room = lambda v: radius * math.cos(math.pi / sides) - v[0] * math.cos(a) - v[1] * math.sin(a)  # noqa: B023, E731
        out = []
        for u, v in zip(p, p[1:] + p[:1], strict=True):
            ru, rv = room(u), room(v)
            if ru >= 0:
                out.append(u)
            if (ru >= 0) != (rv >= 0):
                t = ru / (ru - rv)
                out.append((u[0] + t * (v[0] - u[0]), u[1] + t * (v[1] - u[1])))
        p = out
        if not p:
            return 0.0
    return abs(float(K.signed_areas(np.array(p)[None])[0])) if len(p) > 2 else 0.0


@pytest.mark.parametrize("sides", [8, 64])
def test_areas_of_sides_that_graze(sides):
    rng = np.random.default_rng(3)
    reach = 100.0 * math.cos(math.pi / sides)
    rows = []
    for k in range(600):
        a, d = rng.uniform(0, 2 * math.pi), rng.uniform(0.96, 1.005) * (reach if k % 2 else 100.0)
        n, t = np.array([math.cos(a), math.sin(a)]), np.array([-math.sin(a), math.cos(a)])
        u, v = rng.uniform(-150, 0), rng.uniform(0, 150)
        rows.append([n * d + t * u, n * d + t * v, n * (d + rng.choice([-60, 60])) + t * v * 0.5])
    rings = np.array(rows)
    want = [_convex_cut(r, 100.0, sides) for r in rings]
    assert K.disc_areas(rings, np.zeros((len(rings), 2)), 100.0, sides) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("rows", [20, 200_000])
def test_sums_of_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(spatial_join, "TILE_ROWS", rows)
    rng = np.random.default_rng(4)
    at = rng.integers(0, 300, (60, 2)).astype(float)
    boxes = [(k, *map(float, (*rng.integers(-40, 320, 2), *rng.integers(3, 60, 2)))) for k in range(80)]
    ring = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    r = [(k, ring(x, y, w, h), None if k % 5 == 0 else w * h) for k, x, y, w, h in boxes] + [(900, None, 5.0), (901, [(1.0, 1.0), (None, 2.0), (3.0, 3.0), (1.0, 1.0)], 7.0)]
    points = spark.createDataFrame([(k, *map(float, a)) for k, a in enumerate(at)] + [(999, None, 1.0)], "p long, x double, y double")
    got = {x.p: x for x in polygons.disc_footprints(points, spark.createDataFrame(r, "id long, ring array<struct<x:double,y:double>>, size double"), "p", 50.0, ["size"]).collect()}
    for p, (x, y) in enumerate(at):
        shared = {k: _convex_cut(np.array(ring(*b)[:4]) - (x, y), 50.0, 64) for k, *b in boxes}
        met = [k for k, s in shared.items() if s > 1e-9]
        sizes = [boxes[k][3] * boxes[k][4] for k in met if k % 5]
        assert (p in got) == bool(met)
        if met:
            assert got[p].building_count == len(met) and got[p].clipped_area == pytest.approx(sum(shared.values()), abs=1e-6)
            assert got[p].size_sum == (pytest.approx(sum(sizes)) if sizes else None) and got[p].size_mean == (pytest.approx(np.mean(sizes)) if sizes else None)
            assert got[p].size_std == (pytest.approx(np.std(sizes, ddof=1)) if len(sizes) > 1 else None)
    assert 999 not in got


def test_no_pair_leaves_a_task(spark):
    """The plan has no expression on pairs: only targets, polygons and sums are moved."""
    points = spark.createDataFrame([(1, 0.0, 0.0)], "p long, x double, y double")
    rings = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)])], "id long, ring array<struct<x:double,y:double>>")
    got = polygons.disc_footprints(points, rings, "p", 50.0, [])
    assert got.columns == ["p", "building_count", "clipped_area"] and got.first().building_count == 1
