"""Points near segments, looked up in bands, against all pairs."""

import numpy as np
import pytest

from streetloom.functions import kernels as K
from streetloom.operators import segments, spatial_join


def _apart(at, s):
    u, way = s[:, :2], s[:, 2:] - s[:, :2]
    t = np.clip(((at[:, None] - u) * way).sum(2) / np.maximum((way * way).sum(1), 1e-12), 0, 1)
    return np.hypot(*np.moveaxis(at[:, None] - u - t[..., None] * way, 2, 0))


@pytest.mark.parametrize("radius", [0.3, 7.0, 200.0])
def test_kernel(radius):
    rng = np.random.default_rng(8)
    at = rng.integers(0, 300, (500, 2)).astype(float)
    s = rng.integers(-100, 400, (400, 4)).astype(float)
    s[:20, 2:] = s[:20, :2]  # of no length
    s[20:40, 3], s[40:60, 2] = s[20:40, 1], s[40:60, 0]  # along the axes
    i, j = K.near_pairs(at, s, radius)
    want = set(zip(*(k.tolist() for k in np.nonzero(_apart(at, s) <= radius)), strict=True))
    assert len(i) == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want and want
    assert len(K.near_pairs(at[:1], s[:1], radius)[0]) == (_apart(at[:1], s[:1]) <= radius).sum() and not len(K.near_pairs(at[:0], s, radius)[0])


def test_pairs_of_tiles_in_parts(spark, monkeypatch):
    """Looked-up pairs equal joined ones, in tiles of more rows than a task may hold too."""
    monkeypatch.setattr(spatial_join, "TILE_ROWS", 40)
    rng = np.random.default_rng(9)
    p = spark.createDataFrame([(k, *map(float, a)) for k, a in enumerate(rng.integers(0, 300, (200, 2)))] + [(999, None, 1.0)], "p long, x double, y double")
    s = spark.createDataFrame([(k, *map(float, a)) for k, a in enumerate(rng.integers(0, 300, (90, 4)))], "s long, ux double, uy double, vx double, vy double")
    rows = lambda df: sorted(map(tuple, df.select("p", "s", "t", "distance", "x", "y", "ux", "vy").collect()))
    want = rows(segments.near_segments(p, s, "p", "s", 5.0))
    assert rows(segments.near_segments(p, s, "p", "s", 5.0, tile=90.0)) == want and len(want) > 200


def test_nearest_segment_joins_no_cells(spark, monkeypatch):
    looked = []
    monkeypatch.setattr(segments, "_looked_up", lambda *a, _real=segments._looked_up: (looked.append(a), _real(*a))[1])
    p = spark.createDataFrame([(1, 0.0, 1.0)], "p long, x double, y double")
    s = spark.createDataFrame([(7, 0.0, 0.0, 9.0, 0.0)], "s long, ux double, uy double, vx double, vy double")
    assert [(r.p, r.s, r.distance) for r in segments.nearest_segment(p, s, "p", "s", 5.0).collect()] == [(1, 7, 1.0)] and looked


def test_only_the_nearest_leave_a_task(spark):
    """Of ten segments near a point the nearest and its equal come out of a tile, not all to be ranked."""
    p = spark.createDataFrame([(1, 5.0, 0.0)], "p long, x double, y double")
    s = spark.createDataFrame([(k, 0.0, float(k), 9.0, float(k)) for k in range(1, 10)] + [(0, 0.0, -1.0, 9.0, -1.0)], "s long, ux double, uy double, vx double, vy double")
    assert sorted(r.s for r in segments.near_segments(p, s, "p", "s", 20.0, tile=90.0, nearest=True).collect()) == [0, 1]
    assert [r.s for r in segments.nearest_segment(p, s, "p", "s", 20.0).collect()] == [0]
    assert sorted(r.s for r in segments.nearest_segment(p, s, "p", "s", 20.0, ties=True).collect()) == [0, 1]
