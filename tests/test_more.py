"""Paths, overlays, plots, files and grids against brute force and known values."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetloom.functions import geometry as G
from streetloom.functions import grids, sql
from streetloom.operators import clean, export, hetero, overlay, paths, plots, segments, spatial_join
from streetloom.sources import files

RING = "ring array<struct<x: double, y: double>>"


def ring(*pts):
    return [{"x": float(x), "y": float(y)} for x, y in [*pts, pts[0]]]


def test_simplify_chain_ring_and_parallel(spark):
    two_way = [(0, 1), (1, 2), (2, 3)]
    rows = [(k, u, v, 1.0) for k, (u, v) in enumerate(two_way + [(v, u) for u, v in two_way])]
    rows += [(10, 3, 4, 2.0), (11, 3, 4, 3.0), (12, 3, 60, 1.0), (20, 50, 51, 1.0), (21, 51, 52, 1.0), (22, 52, 50, 1.0)]
    got = {r.street_id: (r.u, r.v, r.length, r.n_parts, r.nodes, r.parts) for r in paths.simplify(spark.createDataFrame(rows, "street_id long, u long, v long, length double")).collect()}
    assert got[0] == (0, 3, 3.0, 3, [0, 1, 2, 3], [0, 1, 2])
    assert got[5] == (3, 0, 3.0, 3, [3, 2, 1, 0], [5, 4, 3])
    assert got[10][:4] == (3, 4, 2.0, 1) and got[11][:4] == (3, 4, 3.0, 1)
    assert len(got) == 5  # the ring that no endpoint touches is gone


def test_simplify_long_chain_and_empty(spark):
    n = 100
    rows = [(k, k, k + 1, 1.0) for k in range(n)]
    got = paths.simplify(spark.createDataFrame(rows, "street_id long, u long, v long, length double")).collect()
    assert [(r.u, r.v, r.length, r.nodes) for r in got] == [(0, n, float(n), list(range(n + 1)))]
    assert paths.simplify(spark.createDataFrame([], "street_id long, u long, v long, length double")).count() == 0


def test_half_streets_odd_and_even(spark):
    line = lambda *p: [{"x": float(x), "y": 0.0} for x in p]
    rows = [(1, 5, 6, line(0, 2, 10)), (2, 6, 7, line(0, 2, 4, 10))]
    halves, middles = paths.half_streets(spark.createDataFrame(rows, "street_id long, u long, v long, line array<struct<x: double, y: double>>"))
    got = {r.half_id: (r.u, r.v, [p.x for p in r.line]) for r in halves.collect()}
    assert got == {"1_0": ("5", "1_m", [0, 2]), "1_1": ("1_m", "6", [2, 10]), "2_0": ("6", "2_m", [0, 2, 3]), "2_1": ("2_m", "7", [3, 4, 10])}
    assert {r.node_id: r.x for r in middles.collect()} == {"1_m": 2.0, "2_m": 3.0}


def test_clip_against_fine_grid():
    ell = np.array([(0, 0), (6, 0), (6, 2), (3, 2), (3, 5), (0, 5)], dtype=float)
    window = overlay.disc(4.0, 2.5, 2.5)
    step = 0.01
    x, y = np.meshgrid(np.arange(0, 6, step) + step / 2, np.arange(0, 5, step) + step / 2)
    inside = ((y < 2) | (x < 3)) & np.all([(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0 for a, b in zip(window, np.roll(window, -1, axis=0))], axis=0)
    assert overlay._area(overlay.clip_convex(ell, window)) == pytest.approx(inside.sum() * step * step, rel=1e-3)


def test_discs_pair_each_polygon_once(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 500.0, 0.0)], "pid long, x double, y double")
    shapes = spark.createDataFrame([(1, ring((-1, -1), (1, -1), (1, 1), (-1, 1))), (2, ring((99, -1), (300, -1), (300, 1), (99, 1))), (3, ring((450, 0), (460, 0), (460, 10), (450, 10)))], "bid long, " + RING)
    got = {(r.pid, r.bid): r.clipped_area for r in overlay.with_discs(points, shapes, 100.0).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 3)}
    assert got[1, 1] == pytest.approx(4.0) and got[2, 3] == pytest.approx(100.0) and 0 < got[1, 2] < 2.1


def test_merge_and_largest(spark):
    z = spark.createDataFrame([("a", ring((0, 0), (1, 0), (1, 1), (0, 1))), ("a", ring((1, 0), (2, 0), (2, 1), (1, 1))), ("b", ring((5, 5), (6, 5), (6, 6), (5, 6)))], "g string, " + RING)
    assert {r.g: (r.n_zones, r.perimeter, len(r.rings)) for r in overlay.merge_zones(z, "g").collect()} == {"a": (2, 6.0, 2), "b": (1, 4.0, 1)}
    b = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, 1.0), (2, 5.0)], "bid long, area double")
    assert sorted(map(tuple, overlay.drop_overlapped(b, "bid", "area").collect())) == [(1, 2.0), (2, 5.0)]


def test_plots_with_crossings_and_dead_ends(spark):
    rows = [(1, 0, 0, 10, 0), (2, 10, 0, 10, 10), (3, 10, 10, 0, 10), (4, 0, 10, 0, 0), (5, 0, 0, 10, 10), (6, 0, 10, 10, 0), (7, 10, 5, 14, 5), (8, 5, 5, 7, 5)]
    rows += [(20, 30, 0, 40, 0), (21, 40, 0, 40, 10), (22, 40, 10, 30, 0), (23, 14, 5, 30, 0)]
    cut = plots.split_at_crossings(spark.createDataFrame([tuple(map(float, r)) for r in rows], "id double, ux double, uy double, vx double, vy double"), "id", 4.0)
    got = plots.plots(cut).select("area", "perimeter", "ring", G.area(F.col("ring")).alias("again")).collect()
    assert sorted(r.area for r in got) == [25.0, 25.0, 25.0, 25.0, 50.0]
    assert all(r.again == pytest.approx(r.area) for r in got)
    assert all(r.ring[0] == r.ring[-1] and r.ring[0] == min(r.ring) for r in got)


def test_nearest_any_reaches_far(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 900.0, 0.0), (3, None, 0.0)], "id long, x double, y double")
    right = spark.createDataFrame([(7, 10.0, 0.0), (8, -10.0, 0.0), (9, 5000.0, 0.0)], "other long, rx double, ry double")
    assert sorted(map(tuple, spatial_join.nearest_any(left, right, "id", "other", 20.0).collect())) == [(1, 7, 10.0), (2, 7, 890.0)]
    assert spatial_join.nearest_any(left, right.limit(0), "id", "other", 20.0).count() == 0


def test_geojson_kinds(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": 1}, "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [3, 4]]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}}, {"type": "Feature", "properties": null, "geometry": null}]}')
    got = {r.gtype: r for r in files.read_geojson(spark, str(tmp_path / "a.json")).collect()}
    assert got["Point"].properties == {"n": "1"} and tuple(got["Point"].parts[0][0][0]) == (1.0, 2.0)
    assert [tuple(p) for p in got["LineString"].parts[0][0]] == [(0.0, 0.0), (3.0, 4.0)]
    assert len(got["MultiPolygon"].parts) == 2 and got[None].parts is None


def _tiff(band, packing):
    data = zlib.compress(band.tobytes()) if packing == 8 else band.tobytes()
    scale, tie = struct.pack("<3d", 2.0, 2.0, 0.0), struct.pack("<6d", 0, 0, 0, 100.0, 50.0, 0)
    entries = [(256, 3, 1, band.shape[1]), (257, 3, 1, band.shape[0]), (258, 3, 1, 32), (259, 3, 1, packing), (273, 4, 1, 8 + 24 + 48), (278, 3, 1, band.shape[0]), (279, 4, 1, len(data)), (339, 3, 1, 3), (33550, 12, 3, 8), (33922, 12, 6, 32)]
    body = scale + tie + data
    return b"II*\0" + struct.pack("<I", 8 + len(body)) + body + struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + b"\0\0\0\0"


@pytest.mark.parametrize("packing", [1, 8])
def test_geotiff(spark, tmp_path, packing):
    band = np.arange(12, dtype="<f4").reshape(3, 4)
    (tmp_path / "r.tif").write_bytes(_tiff(band, packing))
    got = {(r.row, r.col): (r.x, r.y, r.value) for r in files.read_geotiff(spark, str(tmp_path)).collect()}
    assert len(got) == 12 and got[0, 0] == (101.0, 49.0, 0.0) and got[2, 3] == (107.0, 45.0, 11.0)
    assert files.read_geotiff(spark, str(tmp_path), (100.0, 48.0, 104.0, 50.0)).count() == 2


def test_projection_and_tiles(spark):
    one = spark.range(1)
    e, n = grids.utm(F.lit(9.0), F.lit(0.0), 32)
    assert one.select(e, n).first() == pytest.approx((500000.0, 0.0), abs=1e-6)
    # A quarter meridian on the ellipsoid is 10 001 965.729 m.
    e, n = grids.utm(F.lit(9.0), F.lit(89.9999999), 32)
    assert one.select(n).first()[0] == pytest.approx(0.9996 * 10001965.729, abs=0.05)
    tile = G.tile_id(F.lit(103.8), F.lit(1.3), 14)
    b = one.select(grids.tile_bounds(tile).alias("b")).select("b.*").first()
    assert b.west <= 103.8 < b.east and b.south < 1.3 <= b.north
    lon, lat = grids.tile_pixel(tile, F.lit(0), F.lit(4096))
    assert one.select(lon, lat).first() == pytest.approx((b.west, b.south))


def test_grid_without_cells_and_numbers(spark):
    assert grids.delta_grid(spark, (0.0, 0.0, 1.0, 1.0), 10.0).count() == 0
    keys = [5, 70000, -3, 200000, 65536]
    got = {r.k: r.ix for r in clean.numbered(spark.createDataFrame([(k,) for k in keys], "k long"), "k", "ix").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_words_and_sql(spark):
    rows = spark.createDataFrame([("Trunk",), ("trunk_link",), (None,), ("['primary', 'trunk']",)], "h string")
    assert [r[0] for r in rows.select(clean.has_word(F.col("h"), "trunk")).collect()] == [1, 0, 0, 1]
    assert set(sql.register(spark)) == {*sql.FUNCTIONS, "ug_grid", "ug_tiles"}
    assert [r.tile_id for r in spark.sql("SELECT * FROM ug_tiles(103.8D, 1.3D, 103.81D, 1.31D, 10)").collect()] == ["10/807/508"]
    assert spark.sql("SELECT ug_tile(103.8D, 1.3D, 14)").first()[0] == spark.range(1).select(G.tile_id(F.lit(103.8), F.lit(1.3), 14)).first()[0]
    assert spark.sql("SELECT ug_bearing(0D, 0D, 1D, 0D), ug_haversine(0D, 0D, 1D, 0D), ug_complexity(16D, 16D)").first() == pytest.approx((90.0, math.radians(1) * 6371009, 8.0))


def test_export(spark, tmp_path):
    n = spark.createDataFrame([(10, 1.0, True), (5, None, False), (7, 3.0, True)], "id long, a double, f boolean")
    e = spark.createDataFrame([(5, 10), (7, 99)], "src long, dst long")
    export.write(hetero.UrbanGraph({"n": n}, {"r": e}), {"n": "id"}, {"r": ("n", "n")}, str(tmp_path / "out"))
    got = {r.id: (r.ix, [round(v, 4) for v in r.features]) for r in spark.read.parquet(str(tmp_path / "out/features/n")).collect()}
    assert got == {5: (0, [0.0, 0.0]), 7: (1, [1.2247, 1.0]), 10: (2, [-1.2247, 1.0])}
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out/edges")).select("src", "dst").collect()] == [(0, 2)]


def test_segments_by_square_keep_their_length(spark):
    rows = [(1, 5.0, 5.0, 35.0, 5.0), (2, 0.0, 0.0, 30.0, 40.0), (3, 5.0, 5.0, 5.0, 5.0), (4, -7.0, 3.0, 12.0, -8.0)]
    got = segments.by_square(spark.createDataFrame(rows, "id long, ux double, uy double, vx double, vy double"), "id", 10.0).groupBy("id").agg(F.sum("length").alias("l"), F.count("length").alias("n")).collect()
    assert {r.id: round(r.l, 6) for r in got} == {1: 30.0, 2: 50.0, 4: round(math.hypot(19, 11), 6)}
    assert {r.id: r.n for r in got}[1] == 4
