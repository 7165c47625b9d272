"""Closed-form shapes, and grid joins against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetloom.functions import geometry as G
from streetloom.operators import clean, graph, spatial_join

SHAPES = {
    "square": [(0, 0), (1, 0), (1, 1), (0, 1)],
    "rectangle": [(0, 0), (4, 0), (4, 3), (0, 3)],
    "turned": [(0, 0), (3 * math.sqrt(0.5), 3 * math.sqrt(0.5)), (math.sqrt(0.5), 5 * math.sqrt(0.5)), (-2 * math.sqrt(0.5), 2 * math.sqrt(0.5))],
    "ell": [(0, 0), (4, 0), (4, 1), (2, 1), (2, 3), (0, 3)],
    "clockwise": [(0, 3), (4, 3), (4, 0), (0, 0)],
}


@pytest.fixture(scope="module")
def shapes(spark):
    rows = [(n, [{"x": float(x), "y": float(y)} for x, y in [*p, p[0]]]) for n, p in SHAPES.items()]
    return spark.createDataFrame(rows, "name string, ring array<struct<x:double,y:double>>")


def test_ring_metrics(shapes):
    r = {x.name: x for x in shapes.select("name", G.area(F.col("ring")).alias("a"), G.length(F.col("ring")).alias("p"), G.corners(F.col("ring")).alias("c"), G.squareness(F.col("ring")).alias("s")).collect()}
    assert (r["rectangle"].a, r["rectangle"].p, r["rectangle"].c) == (12, 14, 4)
    assert r["clockwise"].a == 12 and r["ell"].a == 8 and r["ell"].c == 6
    assert abs(r["turned"].s) < 1e-5 and abs(r["square"].s) < 1e-5


def test_kernels(shapes):
    r = {x.name: x for x in G.morphology(shapes).collect()}
    for n in ("square", "rectangle", "turned"):
        assert r[n].convexity == pytest.approx(1) and r[n].rectangularity == pytest.approx(1) and r[n].eri == pytest.approx(1)
    assert r["rectangle"].longest_axis == pytest.approx(5) and r["rectangle"].elongation == pytest.approx(0.75)
    assert r["turned"].orientation == pytest.approx(45) and r["ell"].convexity == pytest.approx(8 / 10)


def test_least_circle_holds_all_points():
    rng = np.random.default_rng(0)
    for _ in range(50):
        p = rng.random((rng.integers(3, 30), 2)) * 100
        r = G.enclosing_radius(G.hull(p))
        assert r <= np.hypot(*np.ptp(p, axis=0)) and r >= max(np.hypot(*(a - b)) for a in p for b in p) / 2 - 1e-9


def test_grid_join_is_brute_force(spark):
    rng = random.Random(1)
    p = [(k, rng.uniform(-500, 500), rng.uniform(-500, 500)) for k in range(400)]
    df = spark.createDataFrame(p, "id long, x double, y double")
    other = df.select(F.col("id").alias("o"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    got = {(r.id, r.o) for r in spatial_join.within_distance(df, other, 60.0).collect()}
    assert got == {(a, b) for a, ax, ay in p for b, bx, by in p if (ax - bx) ** 2 + (ay - by) ** 2 <= 3600}
    near = {(r.id, r.neighbour) for r in spatial_join.knn(df, "id", 4, 10.0).collect()}
    assert near == {(a, b) for a, ax, ay in p for b in [o[0] for o in sorted(p, key=lambda o: ((ax - o[1]) ** 2 + (ay - o[2]) ** 2, o[0]))[:4]]}


def test_point_in_polygon(spark, shapes):
    q = shapes.where("name = 'ell'").select(G.inside(F.lit(1.0), F.lit(2.0), F.col("ring")).alias("a"), G.inside(F.lit(3.0), F.lit(2.0), F.col("ring")).alias("b")).first()
    assert q.a and not q.b


def test_components_are_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, 500) for k in range(400, 500)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_trim_keeps_more_than_least(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 6, "c string")
    assert {r.c for r in clean.relabel_and_trim(df, "c", {}, 5).collect()} == {"b"}
