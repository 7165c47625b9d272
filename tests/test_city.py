"""Polygon kernels and joins, bad rows, map-data extracts, rasters, yearly graphs: closed forms and brute force on small tables."""

import ast
import math
import random
from pathlib import Path

import numpy as np
import pytest
import streetloom
from pyspark.sql import functions as F
from streetloom.functions import geometry as G
from streetloom.functions import kernels as K
from streetloom.functions import shapes
from streetloom.operators import clean, graph, overlay, polygons, segments, spatial_join, temporal
from streetloom.sources import mapdata, rasters

RING = "array<struct<x:double,y:double>>"
POINTS = "id long, x double, y double"


def closed(points):
    return [*points, points[0]]


def star(rng, n, x, y, r):
    """A simple ring with n vertices that is seldom convex."""
    turns = [(k + rng.uniform(0, 0.9)) * 2 * math.pi / n for k in range(n)]
    return [(x + f * math.cos(t), y + f * math.sin(t)) for t in turns for f in (r * rng.uniform(0.3, 1),)]


def grid_share(a, b, n=300):
    """Area of two rings' intersection by a grid of points."""
    pts = np.array(a + b)
    (x0, y0), (x1, y1) = pts.min(axis=0), pts.max(axis=0)
    x, y = np.meshgrid(x0 + (np.arange(n) + 0.5) * (x1 - x0) / n, y0 + (np.arange(n) + 0.5) * (y1 - y0) / n)

    def inside(ring):
        r = np.array(ring)
        s = np.roll(r, -1, axis=0)
        odd = np.zeros(x.shape, bool)
        for (ax, ay), (bx, by) in zip(r, s):
            if ay != by:
                odd ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        return odd

    return (inside(a) & inside(b)).mean() * (x1 - x0) * (y1 - y0)


def test_overlap_of_any_shapes():
    rng = random.Random(2)
    for n, k in ((3, 5), (8, 7), (12, 4)):
        a = [star(rng, n, 0, 0, 10) for _ in range(20)]
        b = [star(rng, k, rng.uniform(-8, 8), rng.uniform(-8, 8), 10) for _ in range(20)]
        got = K.overlap_areas(np.array(a), np.array(b))
        for p, q, area in zip(a, b, got):
            assert area == pytest.approx(grid_share(p, q), abs=1.5)


def test_overlap_with_shared_borders():
    square = np.array([[(0, 0), (4, 0), (4, 4), (0, 4)]], float)
    for other, want in (([(4, 0), (8, 0), (8, 4), (4, 4)], 0), ([(0, 0), (2, 0), (2, 4), (0, 4)], 8), ([(0, 0), (4, 0), (4, 4), (0, 4)], 16), ([(1, 1), (1, 3), (3, 3), (3, 1)], 4), ([(4, 4), (5, 4), (5, 5), (4, 5)], 0)):
        ring = np.array([other], float)
        assert K.overlap_areas(square, ring)[0] == pytest.approx(want) == K.overlap_areas(ring, square)[0]


def test_disc_area_is_that_of_the_clip():
    rng = random.Random(4)
    rings = np.array([star(rng, 7, rng.uniform(-90, 90), rng.uniform(-90, 90), 60) for _ in range(60)])
    centres = np.zeros((60, 2))
    got = K.disc_areas(rings, centres, 80.0, 64)
    for ring, area in zip(rings, got):
        turned = K.counter_clockwise(ring[None])[0]
        assert area == pytest.approx(overlay._area(overlay.clip_convex(turned, overlay.disc(0, 0, 80.0))), abs=1e-6)


def test_stacked_metrics_are_those_of_single_rings():
    rng = random.Random(5)
    for n in (3, 6, 9):
        rings = np.array([star(rng, n, 3, 4, 10) for _ in range(30)])
        for p, (area, _, around, long, short, azimuth, r) in zip(rings, K.bounding_metrics(rings)):
            h = G.hull(p)
            a, b, at = G.bounding_rectangle(h)
            assert (area, around, long * short, r) == pytest.approx((G._ring_area(p), G._ring_area(h), a * b, G.enclosing_radius(h)), rel=1e-7)
            # A triangle's three rectangles have the same area.
            assert n == 3 or (long == pytest.approx(a, rel=1e-7) and abs((azimuth - at + 45) % 90 - 45) < 1e-6)


def test_morphology_of_bad_rings(spark):
    rows = [(1, None), (2, closed([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)])), (3, [(0.0, 0.0)]), (4, []), (5, closed([(0.0, 0.0), (2.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)])), (6, closed([(0.0, None), (2.0, 0.0), (2.0, 1.0)])), (7, closed([(math.cos(t / 9), math.sin(t / 9)) for t in range(56)]))]
    got = {r.id: r for r in G.morphology(spark.createDataFrame(rows, f"id int, ring {RING}")).collect()}
    assert all(got[k].convexity is None for k in (1, 2, 3, 4, 6))
    assert (got[5].convexity, got[5].rectangularity, got[5].elongation) == pytest.approx((1, 1, 0.5)) and got[7].circular_compactness == pytest.approx(1, abs=0.01)
    ok = shapes.valid_polygons(spark.createDataFrame([*rows, (8, closed([(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)]))], f"id int, ring {RING}")).collect()
    assert sorted(r.id for r in ok) == [5, 7] and len({r.id: r.ring for r in ok}[5]) == 5


def test_squareness_of_bad_rings(spark):
    rows = [(1, closed([(0.0, 0.0), (2.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)])), (2, closed([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]))]
    got = {r.id: r.s for r in spark.createDataFrame(rows, f"id int, ring {RING}").select("id", G.squareness(F.col("ring")).alias("s")).collect()}
    assert got[1] == pytest.approx(0) and got[2] is None or got[2] > 80


def test_knn_ends_with_missing_places(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 0.0), (3, None, None), (4, float("nan"), 1.0), (5, 900.0, 0.0)], POINTS)
    got = {(r.id, r.neighbour) for r in spatial_join.knn(df, "id", 2, 1.0).collect()}
    assert got == {(1, 1), (1, 2), (2, 2), (2, 1), (5, 5), (5, 2)}
    right = df.select(F.col("id").alias("to"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    assert {(r.id, r.to) for r in spatial_join.nearest_any(df, right, "id", "to", 1.0).collect()} == {(1, 1), (2, 2), (5, 5)}
    assert spatial_join.knn(df.limit(0), "id", 2, 1.0).count() == 0


def test_near_segments_by_brute_force(spark):
    rng = random.Random(8)
    pts = [(k, rng.uniform(-300, 300), rng.uniform(-300, 300)) for k in range(200)] + [(900, None, 1.0)]
    seg = [(k, *[rng.choice([rng.uniform(-300, 300), 0.0, 40.0]) for _ in range(4)]) for k in range(60)]
    got = {(r.id, r.s): r.distance for r in segments.near_segments(spark.createDataFrame(pts, POINTS), spark.createDataFrame(seg, "s long, ux double, uy double, vx double, vy double"), "id", "s", 20.0).collect()}
    want = {}
    for i, x, y in pts[:-1]:
        for k, a, b, c, d in seg:
            n = (c - a) ** 2 + (d - b) ** 2
            t = max(0, min(1, ((x - a) * (c - a) + (y - b) * (d - b)) / n)) if n else 0
            far = math.hypot(x - a - t * (c - a), y - b - t * (d - b))
            if far <= 20:
                want[i, k] = far
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_nearest_segment_ties(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0)], POINTS)
    s = spark.createDataFrame([(2, -1.0, 1.0, 1.0, 1.0), (3, -1.0, -1.0, 1.0, -1.0)], "s long, ux double, uy double, vx double, vy double")
    assert [r.s for r in segments.nearest_segment(p, s, "id", "s", 5.0).collect()] == [2]
    assert sorted(r.s for r in segments.nearest_segment(p, s, "id", "s", 5.0, ties=True).collect()) == [2, 3]


def test_lines_with_inner_vertices_are_not_one(spark):
    rows = [(1, [(0.0, 0.0), (1.0, 1.0), (2.0, 0.0)]), (2, [(0.0, 0.0), (1.0, -1.0), (2.0, 0.0)]), (3, [(2.0, 0.0), (1.0, 1.0), (0.0, 0.0)])]
    assert sorted(r.id for r in clean.line_dedup(spark.createDataFrame(rows, f"id int, line {RING}"), "id").collect()) == [1, 2]


def test_dissolve_keeps_holes(spark):
    """A ring of eight squares around an empty one, and two squares that touch in a corner."""
    sq = lambda x, y: closed([(x, y), (x + 1.0, y), (x + 1.0, y + 1.0), (x, y + 1.0)])
    rows = [("a", sq(float(x), float(y))) for x in range(3) for y in range(3) if (x, y) != (1, 1)] + [("b", sq(0.0, 0.0)), ("b", sq(1.0, 1.0)[::-1])]
    got = {r.g: r for r in polygons.dissolve(spark.createDataFrame(rows, f"g string, ring {RING}"), "g").collect()}
    assert (got["a"].area, got["a"].perimeter, len(got["a"].rings)) == (8, 16, 2) and (got["b"].area, got["b"].perimeter) == (2, 8)


def test_triangles_at_a_hub(spark):
    """A hub with many neighbours, of which two are joined: one wedge, not all pairs of the hub's neighbours."""
    rows = [(0, k) for k in range(1, 400)] + [(1, 2)]
    both = spark.createDataFrame([(u, v, 1) for a, b in rows for u, v in ((a, b), (b, a))], "u long, v long, w long")
    assert {r.i: r.t for r in graph.triangles(both).collect()} == {0: 2, 1: 2, 2: 2}


def test_iterations_in_numpy_and_in_frames_agree(spark, monkeypatch):
    rng = random.Random(3)
    nodes = spark.createDataFrame([(k,) for k in range(30)], "id long")
    edges = spark.createDataFrame([(rng.randrange(28), rng.randrange(28)) for _ in range(120)], "u long, v long")
    runs = [lambda: graph.pagerank(nodes, edges, "id", damping=0.5), lambda: graph.katz(nodes, edges, "id")]
    small = [{r.id: r[1] for r in run().collect()} for run in runs]
    monkeypatch.setattr(graph, "SMALL", 5)
    for run, want in zip(runs, small):
        assert {r.id: r[1] for r in run().collect()} == pytest.approx(want, abs=1e-6)


def test_eigenvector_is_one(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(12), rng.randrange(12)) for _ in range(70)]
    got = {r.id: r.eigenvector for r in graph.eigenvector(spark.createDataFrame([(k,) for k in range(12)], "id long"), spark.createDataFrame(pairs, "u long, v long"), "id").collect()}
    a = np.eye(12)
    for u, v in pairs:
        a[v, u] += 1
    x = np.array([got[k] for k in range(12)])
    y = a @ x
    assert y / np.linalg.norm(y) == pytest.approx(x, abs=1e-6) and (x >= 0).all()


def test_yearly_metrics_are_those_of_each_year(spark):
    edges = [(1, 2), (2, 3), (3, 1), (4, 5), (3, 4)]
    kept = spark.createDataFrame([(k, y) for y, ks in ((2000, (1, 2, 3)), (2010, (1, 2, 3, 4, 5))) for k in ks] + [(9, 2010)], "id long, year int")
    got = {(r.year, r.id): r for r in temporal.metrics(*temporal.largest(kept, spark.createDataFrame(edges, "u long, v long"), "id"), "id").collect()}
    assert set(got) == {(2000, k) for k in (1, 2, 3)} | {(2010, k) for k in range(1, 6)}
    assert got[2000, 1].pagerank == pytest.approx(1 / 3, abs=1e-4) and got[2000, 1].closeness == pytest.approx(2 / 3, abs=1e-4)
    assert got[2010, 3].degree == 2 and got[2010, 5].closeness == 0 and got[2010, 3].betweenness > got[2010, 1].betweenness


def test_packed_extract_round_trip(spark, tmp_path):
    nodes = [(10, 103.5, 1.25, {"amenity": "café"}), (7, -0.1234567, 51.5, {}), (12, 103.6, 1.26, {"shop": "x", "name": "y"})]
    ways = [(3, [10, 7, 12], {"highway": "primary"}), (-4, [12, 10], {}), (5, [10, 7, 12, 10], {"building": "yes"})]
    for k in range(2):
        mapdata.write_extract(nodes if not k else [(99, 1.0, 2.0, {})], ways if not k else [], f"{tmp_path}/{k}.pbf")
    n, w = mapdata.read_extract(spark, [f"{tmp_path}/{k}.pbf" for k in range(2)])
    got = {r.id: (round(r.lon, 7), round(r.lat, 7), r.tags) for r in n.collect()}
    assert got == {**{k: (x, y, t) for k, x, y, t in nodes}, 99: (1.0, 2.0, {})}
    assert [(r.nodes, r.tags) for r in w.where("id = 3").collect()] == [([10, 7, 12], {"highway": "primary"})] and w.count() == 3
    e = mapdata.street_edges(n, w).collect()
    assert {(r.u, r.v) for r in e} == {(10, 7), (7, 10), (7, 12), (12, 7)}
    assert [len(r.ring) for r in mapdata.rings(n, w).collect()] == [4] and {r.id for r in mapdata.points_of_interest(n).collect()} == {10, 12}


def test_rasters(spark, tmp_path):
    grid = rasters.Grid((0.0, 0.0, 70.0, 50.0), 5, 7)
    cells = spark.range(35).select(F.floor(F.col("id") / 7).alias("row"), (F.col("id") % 7).alias("col"), (F.col("id") * 1.5).alias("value"))
    files_ = rasters.write_geotiffs(cells, grid, 3, f"{tmp_path}/tiles")
    assert files_.count() == 6 and len(rasters.prune(files_, (0.0, 0.0, 5.0, 5.0))) == 1
    from streetloom.sources import files

    back = {(round(r.x, 6), round(r.y, 6)): r.value for r in files.read_geotiff(spark, f"{tmp_path}/tiles").collect()}
    assert back == {(c * 10 + 5, 45 - r * 10): (r * 7 + c) * 1.5 for r in range(5) for c in range(7)}
    assert rasters.window(cells, grid, (11.0, 11.0, 12.0, 12.0)).count() == 1


def test_catalog_and_tiles(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"Singapore": "SG", "New Town": {"lat": 1}}')
    t = mapdata.catalog(spark, f"{tmp_path}/c.json")
    assert mapdata.find_in_catalog(t, " singapore").first().value == "SG" and t.count() == 2
    spark.createDataFrame([("a", 1), ("b", 2)], "tile_id string, v int").write.partitionBy("tile_id").parquet(f"{tmp_path}/t")
    assert [r.v for r in mapdata.tiled(spark, f"{tmp_path}/t", spark.createDataFrame([("b",)], "tile_id string")).collect()] == [2]


def test_wkb_of_both_orders_and_dimensions():
    import struct

    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    assert K.parse_wkb(K.make_wkb([ring])) == ("Polygon", [[ring]])
    big = struct.pack(">BII", 0, 1002, 2) + b"".join(struct.pack(">3d", x, 0.0, 9.0) for x in (1.0, 2.0))
    assert K.parse_wkb(big) == ("LineString", [[[(1.0, 0.0), (2.0, 0.0)]]])
    many = struct.pack("<BII", 1, 6, 2) + K.make_wkb([ring]) * 2
    assert K.parse_wkb(many) == ("MultiPolygon", [[ring], [ring]])


def test_places_and_colours(spark):
    one = spark.range(1)
    line = shapes.line_at(F.lit(5.0), F.lit(5.0), F.lit(90.0), F.lit(4.0))
    r = one.select(line.alias("l"), shapes.rgb(F.lit("#ff8000")).alias("c"), shapes.chip_window(F.lit(1.0), F.lit(9.0), 2, (0.0, 0.0, 10.0, 10.0), 10, 10).alias("w")).first()
    assert (r.l[0].x, r.l[1].x) == pytest.approx((3, 7)) and tuple(r.c) == (255, 128, 0) and tuple(r.w) == (0, 3, 0, 3)
    p = shapes.tile_pixels(shapes.tiles_of_box(spark, (0.1, 0.1, 0.2, 0.2), 8), 4, 8)
    assert p.count() == 16 and p.agg(F.min("lon")).first()[0] > 0
    assert one.select(clean.local_time(F.lit(1_700_000_000_000), "Asia/Singapore").alias("m")).first().m == 6 * 60 + 13
    assert [tuple(x) for x in clean.side_by_side(spark.range(3), spark.createDataFrame([(5, "a"), (9, "b")], "k long, v string"), "id", "k").orderBy("id").collect()] == [(0, 5, "a"), (1, 9, "b"), (2, None, None)]


def test_no_function_of_a_module_is_defined_twice():
    """A second definition takes the place of the first in all its callers."""
    for path in sorted(Path(streetloom.__file__).parent.rglob("*.py")):
        names = [n.name for n in ast.parse(path.read_text()).body if isinstance(n, ast.FunctionDef)]
        assert len(names) == len(set(names)), path


def test_outside_parts_add_up_to_the_outside_length(spark):
    """Through a square and a star, along each side of the square, past both; a segment of no ring keeps its whole length."""
    rng = random.Random(5)
    rings = [([(100.0, 100.0), (200.0, 100.0), (200.0, 200.0), (100.0, 200.0)],), (star(rng, 9, 400.0, 150.0, 90.0),)]
    rings = spark.createDataFrame([(closed(r[0]),) for r in rings] + [(None,)], f"ring {RING}")
    ends = [(50.0, y, 250.0, y) for y in (100.0, 150.0, 200.0)] + [(x, 50.0, x, 250.0) for x in (100.0, 150.0, 200.0)]
    ends += [tuple(rng.uniform(0, 500) for _ in range(4)) for _ in range(60)] + [(0.0, 0.0, 10.0, 0.0), (120.0, 120.0, 180.0, 180.0)]
    lines = spark.createDataFrame([(k, *e) for k, e in enumerate(ends)], "k long, ux double, uy double, vx double, vy double")
    want = {r.k: r.outside_length for r in polygons.outside_length(lines, rings, "k", 100.0).collect()}
    got = dict.fromkeys(want, 0.0)
    for r in polygons.outside_parts(lines, rings, "k", 100.0).collect():
        got[r.k] += math.hypot(r.vx - r.ux, r.vy - r.uy)
    assert got == pytest.approx(want, abs=1e-6) and want[0] == want[5] == pytest.approx(100.0) and got[len(ends) - 1] == 0.0
