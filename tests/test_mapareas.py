"""Relations of packed extracts and the areas stitched from their ways."""

import pytest
from pyspark.sql import functions as F

from streetloom.functions import geometry as G
from streetloom.sources import mapareas, mapdata

TAGS = {"type": "multipolygon", "building": "yes"}


def _square(first, x, y, side):
    return [(first + k, x + dx * side, y + dy * side, {}) for k, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))]


def _tables(spark, tmp_path, nodes, ways, relations):
    path = f"{tmp_path}/areas.pbf"
    mapdata.write_extract(nodes, ways, path, relations)
    return *mapdata.read_extract(spark, [path]), mapdata.read_relations(spark, [path])


def test_relations_round_trip(spark, tmp_path):
    relations = [(7, [("way", 3, "outer"), ("node", -5, ""), ("relation", 9, "sub area")], TAGS), (-8, [], {}), (2**40, [("way", 1, "inner")], {"type": "boundary"})]
    *_, got = _tables(spark, tmp_path, [(1, 0.0, 0.0, {})], [], relations)
    assert {r.id: ([tuple(m) for m in r.members], r.tags) for r in got.collect()} == {k: (m, t) for k, m, t in relations}


def test_areas_of_relations(spark, tmp_path):
    nodes = [*_square(1, 0.0, 0.0, 10.0), *_square(11, 2.0, 2.0, 6.0), *_square(21, 4.0, 4.0, 1.0), *_square(31, 20.0, 0.0, 5.0), *_square(41, 25.0, 5.0, 5.0)]
    ways = [
        (1, [1, 2, 3], {}), (2, [1, 4, 3], {}),  # an outer ring of two ways, one of them against the other
        (3, [11, 12], {}), (4, [13, 12], {}), (5, [13, 14, 11], {}),  # a hole of three
        (6, [21, 22, 23, 24, 21], {}),  # an island in the hole
        (7, [31, 32, 33], {}), (8, [33, 34, 31], {}), (9, [33, 42, 43], {}), (10, [33, 44, 43], {}),  # two outer rings that touch at a node
        (11, [1, 2, 3, 4, 1], {"building": "hut"}), (12, [1, 99, 3], {}),  # a closed way with tags of its own; one that lacks a node
        (13, [13, 14, 11], {}), (14, [13, 12, 11], {}), (15, [11, 22, 13], {}),  # both halves of a square along its diagonal
    ]
    way = lambda role, *refs: [("way", r, role) for r in refs]
    relations = [
        (100, way("outer", 2, 1, 1) + way("inner", 5, 3, 4) + way("", 6) + [("node", 1, "")], TAGS),
        (101, way("outer", 7, 8, 9, 10), TAGS),
        (102, way("outer", 1, 12) + way("inner", 6), TAGS),  # does not close
        (103, way("outer", 1, 2), {"type": "route", "building": "yes"}),
        (104, way("outer", 1, 2) + way("inner", 7, 8), TAGS),  # a hole that lies elsewhere
        (105, [], TAGS), (106, way("outer", 1, 2), {"type": "multipolygon", "landuse": "x"}),
        (107, way("outer", 1, 2) + way("inner", 13, 14, 15), TAGS),  # two holes that share a way
    ]
    n, w, r = _tables(spark, tmp_path, nodes, ways, relations)
    got = mapareas.multipolygons(n, w, r).select("id", "part", F.size("rings").alias("n"), G.area(F.col("ring")).alias("a"), F.size(F.expr("rings[0]")).alias("v"), "tags").collect()
    assert sorted((x.id, x.part, x.n, round(x.a, 6), x.v) for x in got) == [(100, 0, 2, 64.0, 5), (100, 1, 1, 1.0, 5), (101, 0, 1, 25.0, 5), (101, 1, 1, 25.0, 5), (104, 0, 1, 100.0, 5), (107, 0, 3, 64.0, 5)]
    every = mapareas.areas(n, w, r)
    assert sorted((x.kind, x.id) for x in every.collect()) == [("relation", 100), ("relation", 100), ("relation", 101), ("relation", 101), ("relation", 104), ("relation", 107), ("way", 11)]
    assert mapareas.multipolygons(n, w, r.where("id IS NULL")).count() == 0 and mapareas.multipolygons(n.limit(0), w, r).count() == 0


@pytest.mark.parametrize("ring", [[(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], [(0, 0), (1, 3), (2, 0), (3, 9), (4, -2), (5, 9), (-1, 9)], [(0, 0), (5, 5), (0, 5)]])
def test_inner_point(spark, ring):
    pts = [{"x": float(x), "y": float(y)} for x, y in [*ring, ring[0]]]
    df = spark.createDataFrame([(pts,)], "ring array<struct<x:double,y:double>>").select("ring", mapareas.inner_point(F.col("ring")).alias("p"))
    assert df.where(G.inside(F.col("p.x"), F.col("p.y"), F.col("ring"))).count() == 1
