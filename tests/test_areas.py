"""Traced rings, plots with holes, unions of overlapping polygons and polygons with holes, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetloom.functions import geometry as G
from streetloom.functions import kernels as K
from streetloom.operators import crossings, plots, polygons, rings

RING = "array<struct<x:double,y:double>>"


def ring(*points):
    return [(float(x), float(y)) for x, y in [*points, points[0]]]


def box(x, y, w, h):
    return ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))


@pytest.mark.parametrize("few", [0, 40, 10_000])
def test_cycles_by_rounds_and_by_walk(spark, monkeypatch, few):
    rng = random.Random(few)
    monkeypatch.setattr(rings, "FEW", few)
    names, rows, want = rng.sample(range(-5000, 5000), 420), [], set()
    for size in [1, 2, 3, 3, 4, 5, 8, 9, 64, 101, 200]:
        way, names = names[:size], names[size:]
        rows += list(zip(way, way[1:] + way[:1]))
        at = way.index(min(way))
        want |= {(k, min(way), (at - i - 1) % size + 1) for i, k in enumerate(way)}
    rows += list(zip(names, names[1:]))  # a chain that ends
    rng.shuffle(rows)
    got = rings.cycles(spark.createDataFrame(rows, "item long, next long"))
    assert {tuple(r) for r in got.collect()} == want
    assert rings.cycles(spark.createDataFrame([], "item long, next long")).count() == 0


def segments(spark, lines):
    return spark.createDataFrame([(k, *map(float, s)) for k, s in enumerate(lines)], "id long, ux double, uy double, vx double, vy double")


def sides(x, y, w, h):
    return [(x, y, x + w, y), (x + w, y, x + w, y + h), (x + w, y + h, x, y + h), (x, y + h, x, y)]


@pytest.mark.parametrize("few", [0, 10_000])
def test_plots_with_holes(spark, monkeypatch, few):
    """A square with two islands, one of which holds an island of its own; a dead end and a bridge are no borders."""
    monkeypatch.setattr(rings, "FEW", few)
    lines = sides(0, 0, 100, 100) + sides(10, 10, 40, 40) + sides(20, 20, 10, 10) + sides(60, 60, 20, 20) + [(60, 70, 80, 70), (100, 50, 90, 50), (50, 30, 45, 30), (10, 10, 5, 5)]
    lines += sides(200, 0, 10, 10) + sides(230, 0, 10, 10) + [(210, 5, 230, 5)]
    got = plots.plots(plots.split_at_crossings(segments(spark, lines), "id", 30.0)).collect()
    figures = sorted((r.area, r.perimeter, len(r.holes)) for r in got)
    assert figures == [(100.0, 40.0, 0), (100.0, 40.0, 0), (100.0, 40.0, 0), (200.0, 60.0, 0), (200.0, 60.0, 0), (1500.0, 200.0, 1), (8000.0, 400.0 + 160.0 + 80.0, 2)]
    outer = next(r for r in got if r.area == 8000.0)
    assert tuple(outer.ring[0]) == (0.0, 0.0) and {tuple(h[0]) for h in outer.holes} == {(10.0, 10.0), (60.0, 60.0)} and len({r.plot_id for r in got}) == len(got)


def test_plots_of_random_lines_fill_their_outline(spark):
    """Euler: faces = edges - vertices + parts; faces' areas are those of a raster's regions between the lines."""
    rng = random.Random(8)
    lines = [(rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(24)] + sides(0, 0, 60, 60)
    cut = plots.split_at_crossings(segments(spark, lines), "id", 20.0, 1e-6)
    edges = [(tuple(r.a), tuple(r.b)) for r in cut.collect()]
    up = {v: v for e in edges for v in e}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        up[top(a)] = top(b)
    got = plots.plots(cut).collect()
    assert len(got) == len(edges) - len(up) + len({top(v) for v in up})
    assert sum(r.area for r in got) == pytest.approx(3600, abs=1e-3)


def test_both_segments_of_a_crossing_take_one_point(spark):
    rng = random.Random(3)
    lines = [tuple(rng.uniform(0, 1) for _ in range(4)) for _ in range(60)]
    pieces = crossings.cut_at_crossings(segments(spark, lines), "id", 0.3, 1e-9).collect()
    at = {}
    for r in pieces:
        for p in (tuple(r.a), tuple(r.b)):
            at.setdefault(p, set()).add(r.id)
    crossed = sum(1 for i, a in enumerate(lines) for b in lines[:i] if meets(a, b))
    assert sum(1 for v in at.values() if len(v) == 2) == crossed > 50


def meets(a, b):
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    p, q, r, s = a[:2], a[2:], b[:2], b[2:]
    return side(p, q, r) * side(p, q, s) < 0 and side(r, s, p) * side(r, s, q) < 0


def covered(shapes, n=1200, span=60.0):
    """Area of the union of rings by a fine raster."""
    at = (np.arange(n) + 0.5) * span / n
    x, y = (v.ravel() for v in np.meshgrid(at, at))
    inside = np.zeros(len(x), bool)
    for s in shapes:
        odd = np.zeros(len(x), bool)
        for (ax, ay), (bx, by) in zip(s, s[1:]):
            with np.errstate(divide="ignore", invalid="ignore"):
                odd ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        inside |= odd
    return inside.mean() * span * span


def test_union_of_any_polygons(spark):
    rng = random.Random(5)

    def star(x, y, r):
        n = rng.randint(4, 9)
        turns = [(k + rng.uniform(0, 0.9)) * 2 * math.pi / n for k in range(n)]
        return ring(*[(x + rng.uniform(0.3, 1) * r * math.cos(t), y + rng.uniform(0.3, 1) * r * math.sin(t)) for t in turns])

    groups = {"a": [star(rng.uniform(15, 45), rng.uniform(15, 45), rng.uniform(3, 14)) for _ in range(14)], "b": [box(10, 10, 20, 20), box(30, 10, 10, 20), box(20, 20, 5, 25), box(10, 10, 20, 20)], "c": [star(30, 30, 10)], "d": [box(5, 5, 10, 10), box(15, 15, 10, 10), box(40, 40, 2, 2)]}
    groups["c"] += [s[::-1] for s in groups["c"]]
    groups["g"] = [ring((10, 10), (30, 30), (30, 10), (10, 30)), ring((5, 5), (50, 20), (7, 50), (40, 2), (35, 55))]
    rows = [(g, s) for g, shapes in groups.items() for s in shapes] + [("e", None), ("f", [])]
    got = {r.g: r for r in polygons.union(spark.createDataFrame(rows, f"g string, ring {RING}"), "g", 8.0).collect()}
    assert set(got) == set(groups)
    for g, shapes in groups.items():
        assert got[g].area == pytest.approx(covered(shapes), rel=0.01), g
    assert (got["b"].area, got["b"].perimeter, len(got["b"].rings)) == (pytest.approx(675), pytest.approx(130), 1)
    # Two squares that touch at a corner stay two rings.
    assert (got["d"].area, got["d"].perimeter, len(got["d"].rings)) == (pytest.approx(204), pytest.approx(88), 3)


def test_union_keeps_yards_and_fills_holes(spark):
    frame = rings.keyhole(F.array("o", "h"))
    rows = [("open", box(0, 0, 30, 30), box(10, 10, 10, 10)), ("shut", box(0, 0, 30, 30), box(10, 10, 10, 10))]
    df = spark.createDataFrame(rows, f"g string, o {RING}, h {RING}").select("g", frame.alias("ring"))
    lid = spark.createDataFrame([("shut", box(9, 9, 12, 12)), ("open", box(12, 12, 2, 2))], f"g string, ring {RING}")
    got = {r.g: r for r in polygons.union(df.union(lid), "g", 10.0).collect()}
    assert (got["open"].area, got["open"].perimeter, len(got["open"].rings)) == (pytest.approx(804), pytest.approx(168), 3)
    assert (got["shut"].area, got["shut"].perimeter, len(got["shut"].rings)) == (pytest.approx(900), pytest.approx(120), 1)


def test_keyholed_polygons_in_kernels(spark):
    """Points, overlaps and segments see the holes, whatever way the rings run."""
    rows = [(k, [o, *h]) for k, (o, h) in enumerate([(box(0, 0, 10, 10), [box(2, 2, 3, 3), box(6, 6, 2, 2)]), (box(0, 0, 10, 10)[::-1], [box(2, 2, 3, 3), box(6, 6, 2, 2)[::-1]]), (box(0, 0, 10, 10), [])])]
    df = spark.createDataFrame([*rows, (9, None), (8, [])], f"k long, rings array<{RING}>").withColumn("ring", rings.keyhole(F.col("rings")))
    assert {r.k: r.a for r in df.select("k", G.area(F.col("ring")).alias("a")).collect()} == {0: 87.0, 1: 87.0, 2: 100.0, 8: None, 9: None}
    points = spark.createDataFrame([(0, 1.0, 1.0), (1, 3.0, 3.0), (2, 7.0, 7.0), (3, 9.0, 9.0), (4, 11.0, 1.0)], "p long, x double, y double")
    got = {(r.k, r.p) for r in polygons.points_in(points, df.select("k", "ring"), 4.0).collect()}
    assert got == {(k, p) for k in (0, 1, 2) for p in (0, 3)} | {(2, 1), (2, 2)}
    other = spark.createDataFrame([(0, box(1, 1, 3, 3)), (1, box(2, 2, 3, 3)), (2, box(-5, -5, 30, 30)), (3, box(3, 3, 1, 1))], f"o long, other {RING}")
    got = {(r.k, r.o): r.overlap for r in polygons.overlaps(df.select("k", "ring"), other, 5.0, "ring", "other").collect()}
    for k, want in ((0, {0: 5.0, 2: 87.0}), (1, {0: 5.0, 2: 87.0}), (2, {0: 9.0, 1: 9.0, 2: 100.0, 3: 1.0})):
        assert {o: v for (q, o), v in got.items() if q == k} == pytest.approx(want), k
    line = spark.createDataFrame([(0, -1.0, 3.5, 11.0, 3.5)], "s long, ux double, uy double, vx double, vy double")
    assert {r.k: round(r.inside_length, 6) for r in polygons.segments_in(line, df.select("k", "ring"), 5.0).collect()} == {0: 7.0, 1: 7.0, 2: 10.0}


def test_border_of_sides_walked_both_ways():
    a = np.array([[[0, 0], [4, 0], [4, 4], [0, 4.0]]])
    keyed = np.array([[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0], [1, 1], [1, 3], [3, 3], [3, 1], [1, 1.0]]])
    # The side from (0, 0) to (1, 1) lies along the cut: inside, not on the border.
    wedge = np.array([[[0, 0], [1, 1], [0, 1.0]]])
    assert K.overlap_areas(wedge, keyed)[0] == pytest.approx(0.5) and K.overlap_areas(a, keyed)[0] == pytest.approx(12)
