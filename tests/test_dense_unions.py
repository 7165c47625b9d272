"""Unions of piles of polygons: what others cover is taken away before sides are cut at crossings."""

import numpy as np
import pytest

from streetloom.functions import kernels as K
from streetloom.operators import polygons

RING = "array<struct<x:double,y:double>>"


def _boxes(n, span, seed=3):
    rng = np.random.default_rng(seed)
    x, y, w, h = rng.integers(0, span, n), rng.integers(0, span, n), rng.integers(20, 60, n), rng.integers(20, 60, n)
    return [np.array([[a, b], [a + c, b], [a + c, b + d], [a, b + d], [a, b]], float) for a, b, c, d in zip(x, y, w, h, strict=True)]


def test_what_boxes_leave_of_sides():
    boxes = _boxes(12, 150)
    xy, sides = np.concatenate(boxes), np.concatenate([np.hstack([r[:-1], r[1:]]) for r in boxes])
    row, low, high = K.uncovered(sides, np.zeros(len(sides)), np.ones(len(sides)), (np.arange(12) * 5, np.full(12, 4), xy), 1e-5, 1e-2)
    t = (np.arange(5000) + 0.5) / 5000
    for k, s in enumerate(sides):
        p = s[:2] + t[:, None] * (s[2:] - s[:2])
        inside = np.any([((p > r.min(axis=0)) & (p < r.max(axis=0))).all(axis=1) for r in boxes], axis=0)
        kept = np.any([np.zeros(5000, bool), *[(t >= a) & (t <= b) for a, b in zip(low[row == k], high[row == k], strict=True)]], axis=0)
        assert not (~inside & ~kept).any() and (inside & kept).sum() < 50, k


def test_union_of_a_pile_cuts_few_sides(spark, monkeypatch):
    boxes, cut, seen = _boxes(400, 200), polygons.cut_at_crossings, []
    monkeypatch.setattr(polygons, "cut_at_crossings", lambda sides, *a: seen.append(sides.count()) or cut(sides, *a))
    rows = [(1, [tuple(p) for p in r.tolist()]) for r in boxes]
    got = polygons.union(spark.createDataFrame(rows, f"g long, ring {RING}"), "g", 50.0).first()
    grid = np.zeros((262, 262), bool)
    for r in boxes:
        (x0, y0), (x1, y1) = r.min(axis=0).astype(int), r.max(axis=0).astype(int)
        grid[x0 + 1 : x1 + 1, y0 + 1 : y1 + 1] = True
    assert got.area == pytest.approx(grid.sum()) and got.perimeter == pytest.approx(np.abs(np.diff(grid.astype(int), axis=0)).sum() + np.abs(np.diff(grid.astype(int), axis=1)).sum())
    assert seen[0] < 200  # of 1600
