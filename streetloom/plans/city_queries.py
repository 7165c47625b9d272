"""Registered queries of polygon joins, the high-level methods, relations, map-data extracts, rasters and yearly graphs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import grids, shapes, sql
from ..operators import clean, graph, polygons, relations, temporal
from ..sources import layers as L
from ..sources import mapdata, rasters
from . import city as C
from .more import CHAIN, DISCS
from .queries import BUILDINGS, LINES, NODES, ORACLES, POIS, POPULATION, STREETS, YEARS, _pivot_sql, query

# Zones that are no squares: each square of 1000 m cut in two by a line that passes no point of whole coordinates.
SLOPE, RISE = 0.7310585, 13.37


def half_zones(spark):
    """(zone_id, ring): lower parts have even numbers, upper parts odd ones."""
    z = spark.range(50).select(F.col("id").alias("zone_id"), (F.floor(F.col("id") / 2) % 5 * 1000.0).alias("x"), (F.floor(F.floor(F.col("id") / 2) / 5) * 1000.0).alias("y"))
    at = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    left, right = RISE, RISE + SLOPE * 1000
    low = F.array(at(0, 0), at(1000, 0), at(1000, right), at(0, left), at(0, 0))
    high = F.array(at(0, left), at(1000, right), at(1000, 1000), at(0, 1000), at(0, left))
    return F.broadcast(z.select("zone_id", F.when(F.col("zone_id") % 2 == 0, low).otherwise(high).alias("ring")))


def _half(x: str = "x", y: str = "y") -> str:
    return f"CAST((floor({y} / 1000) * 5 + floor({x} / 1000)) * 2 + CASE WHEN {y} - floor({y} / 1000) * 1000 > {RISE} + {SLOPE} * ({x} - floor({x} / 1000) * 1000) THEN 1 ELSE 0 END AS BIGINT)"


# The parts of streets in half-zones: the stay in the square, and in it the stay below or above the line.
CUT = """cut AS (SELECT *, row * 1000.0 + {rise} + {slope} * (ux - col * 1000.0) - uy AS g0, row * 1000.0 + {rise} + {slope} * (vx - col * 1000.0) - vy AS g1 FROM (SELECT *, unnest(generate_series(CAST(floor(least(uy, vy) / 1000) AS BIGINT), CAST(floor(greatest(uy, vy) / 1000) AS BIGINT))) AS row FROM (SELECT *, unnest(generate_series(CAST(floor(least(ux, vx) / 1000) AS BIGINT), CAST(floor(greatest(ux, vx) / 1000) AS BIGINT))) AS col FROM lines))),
 stay AS (SELECT street_id, length, row, col, side, greatest(0, CASE WHEN vx = ux THEN 0 ELSE least((col * 1000 - ux) / (vx - ux), (col * 1000 + 1000 - ux) / (vx - ux)) END, CASE WHEN vy = uy THEN 0 ELSE least((row * 1000 - uy) / (vy - uy), (row * 1000 + 1000 - uy) / (vy - uy)) END, CASE WHEN (side = 0 AND g0 < 0 AND g1 > g0) OR (side = 1 AND g0 > 0 AND g1 < g0) THEN g0 / (g0 - g1) WHEN (side = 0 AND g0 < 0) OR (side = 1 AND g0 > 0) THEN 1 ELSE 0 END) AS t0,
   least(1, CASE WHEN vx = ux THEN 1 ELSE greatest((col * 1000 - ux) / (vx - ux), (col * 1000 + 1000 - ux) / (vx - ux)) END, CASE WHEN vy = uy THEN 1 ELSE greatest((row * 1000 - uy) / (vy - uy), (row * 1000 + 1000 - uy) / (vy - uy)) END, CASE WHEN (side = 0 AND g0 >= 0 AND g1 < 0) OR (side = 1 AND g0 <= 0 AND g1 > 0) THEN g0 / (g0 - g1) ELSE 1 END) AS t1 FROM cut, (SELECT unnest([0, 1]) AS side)),
 street_in AS (SELECT street_id, length, (row * 5 + col) * 2 + side AS zone_id, (t1 - t0) * length AS part FROM stay WHERE t1 - t0 > 1e-9 AND row < 5 AND col < 5)""".format(rise=RISE, slope=SLOPE)
# Buildings as rectangles, whole or as the two of an L.
RECTS = "rects AS (SELECT bid, x AS x0, y AS y0, x + width AS x1, y + CASE WHEN bid % 2 = 0 THEN depth ELSE depth / 2 END AS y1 FROM buildings UNION ALL SELECT bid, x, y + depth / 2, x + width / 2, y + depth FROM buildings WHERE bid % 2 = 1)"
BUILT_IN = f"""{RECTS}, cells AS (SELECT *, unnest(generate_series(CAST(floor(y0 / 1000) AS BIGINT), CAST(floor(y1 / 1000) AS BIGINT))) AS row FROM (SELECT *, unnest(generate_series(CAST(floor(x0 / 1000) AS BIGINT), CAST(floor(x1 / 1000) AS BIGINT))) AS col FROM rects)),
 parts AS (SELECT bid, row, col, greatest(x0, col * 1000) - col * 1000 AS a0, least(x1, col * 1000 + 1000) - col * 1000 AS a1, greatest(y0, row * 1000) - row * 1000 AS b0, least(y1, row * 1000 + 1000) - row * 1000 AS b1 FROM cells WHERE row < 5 AND col < 5),
 square_in AS (SELECT DISTINCT bid, row * 5 + col AS zone_id FROM parts WHERE a1 > a0 AND b1 > b0),
 built_in AS (SELECT DISTINCT bid, (row * 5 + col) * 2 + side AS zone_id FROM parts, (SELECT unnest([0, 1]) AS side) WHERE a1 > a0 AND b1 > b0 AND CASE WHEN side = 0 THEN {RISE} + {SLOPE} * a1 > b0 ELSE b1 > {RISE} + {SLOPE} * a0 END)"""
WHOLE = "b AS (SELECT bid, CASE WHEN bid % 2 = 0 THEN area ELSE area * 0.75 END AS area, perimeter FROM buildings)"


def _rings(spark, d):
    return L.building_rings(spark, d).select("bid", "ring")


def _turned(spark, d):
    """Buildings turned about their first corner by 7 degrees times their number, less than 90."""
    b = L.building_rings(spark, d)
    angle = F.radians((F.col("bid") * 7 % 90).cast("double"))
    c, s = F.cos(angle), F.sin(angle)
    turn = lambda p: F.struct((F.col("x") + (p["x"] - F.col("x")) * c - (p["y"] - F.col("y")) * s).alias("x"), (F.col("y") + (p["x"] - F.col("x")) * s + (p["y"] - F.col("y")) * c).alias("y"))
    return b.select("bid", F.transform("ring", turn).alias("ring"))


TURNED = """t AS (SELECT bid, x, y, width AS w, depth AS d, radians(CAST(bid * 7 % 90 AS DOUBLE)) AS g, CAST(bid * 7 % 90 AS DOUBLE) AS deg, bid % 2 = 0 AS even, CASE WHEN bid % 2 = 0 THEN area ELSE area * 0.75 END AS a, perimeter AS p, CASE WHEN bid % 2 = 0 THEN 1.0::DOUBLE ELSE 0.75::DOUBLE / 0.875 END AS convexity, CASE WHEN bid % 2 = 0 THEN 0.5::DOUBLE ELSE 5.0::DOUBLE / 12 END AS m, sqrt(width * width + depth * depth) AS diag FROM buildings)"""


@query("building_layer", f"WITH {BUILDINGS}, {TURNED} SELECT bid, round(a, 4) AS bid_area, round(p, 4) AS bid_perimeter, round(x + m * w * cos(g) - m * d * sin(g), 4) AS cx, round(y + m * w * sin(g) + m * d * cos(g), 4) AS cy, round(p / sqrt(sqrt(a)), 5) AS complexity, round(a / (pi() * diag * diag / 4), 5) AS circular_compactness, round(convexity, 5) AS convexity, CAST(CASE WHEN even THEN 4 ELSE 6 END AS BIGINT) AS corners, round(least(w, d) / greatest(w, d), 5) AS elongation, round(abs(deg + 45 - 90 * floor((deg + 45) / 90) - 45), 4) AS orientation, round(diag, 5) AS longest_axis, round(sqrt(a / (w * d)), 5) AS eri, round(2 * ln(p / 4) / ln(a), 5) AS fractal_dimension, round(a / (w * d), 5) AS rectangularity, round(pow(4 * sqrt(a) / p, 2), 4) AS square_compactness, round(sqrt(a / pi()) / (diag / 2), 5) AS shape_index, 0.0::DOUBLE AS squareness FROM t WHERE a > 29.5")
def building_layer(spark, d):
    """All thirteen metrics of buildings that stand at an angle."""
    b = C.building_layer(_turned(spark, d), least=29.5)
    r = lambda c, k=5: F.round(c, k).alias(c)
    return b.select("bid", r("bid_area", 4), r("bid_perimeter", 4), F.round("bid_centroid.x", 4).alias("cx"), F.round("bid_centroid.y", 4).alias("cy"), *[r(c, 4 if c in ("orientation", "square_compactness") else 5) for c in C.SHAPE if c not in ("corners", "squareness")], "corners", F.abs(F.round("squareness", 4)).alias("squareness"))


@query("sheared_squareness", f"WITH {BUILDINGS} SELECT bid, round(abs(90 - degrees(atan2(depth, CAST(bid % 7 + 1 AS DOUBLE)))), 6) AS squareness FROM buildings")
def sheared_squareness(spark, d):
    """Parallelograms: every corner is off a right angle by the same amount."""
    b = L.buildings(spark, d)
    s = (F.col("bid") % 7 + 1).cast("double")
    at = lambda x, y: F.struct((F.col("x") + x).alias("x"), (F.col("y") + y).alias("y"))
    o, w, h = F.lit(0.0), F.col("width"), F.col("depth")
    ring = F.array(at(o, o), at(w, o), at(w + s, h), at(s, h), at(o, o))
    return b.select("bid", F.round(G.squareness(ring), 6).alias("squareness"))


@query("height_by_overlap", f"WITH {BUILDINGS}, {RECTS}, k AS (SELECT *, unnest(generate_series(CAST(floor(y0 / 50) AS BIGINT), CAST(ceil(y1 / 50) AS BIGINT) - 1)) AS row FROM (SELECT *, unnest(generate_series(CAST(floor(x0 / 50) AS BIGINT), CAST(ceil(x1 / 50) AS BIGINT) - 1)) AS col FROM rects)), c AS (SELECT DISTINCT bid, row, col FROM k WHERE row < 100 AND col < 100 AND (row * 3 + col * 7) % 4 <> 0) SELECT bid, round(avg((row * 29 + col * 13) % 50 + 3), 6) AS height, count(*) AS n FROM c GROUP BY bid")
def height_by_overlap(spark, d):
    """The mean height of the height polygons (squares of 50 m, some missing) that a building overlaps."""
    cells = spark.range(10_000).select(F.floor(F.col("id") / 100).alias("row"), (F.col("id") % 100).alias("col")).where((F.col("row") * 3 + F.col("col") * 7) % 4 != 0)
    x, y = F.col("col") * 50.0, F.col("row") * 50.0
    h = cells.select(((F.col("row") * 29 + F.col("col") * 13) % 50 + 3).alias("height"), grids.square(x, y, x + 50, y + 50).alias("_h"))
    met = polygons.overlaps(_rings(spark, d).withColumnRenamed("ring", "_b"), h, 100.0, "_b", "_h")
    return met.groupBy("bid").agg(F.round(F.avg("height"), 6).alias("height"), F.count(F.lit(1)).alias("n"))


@query("points_in_polygons", f"WITH {POIS} SELECT {_half()} AS zone_id, count(*) AS n, round(sum(value), 4) AS total FROM pois GROUP BY 1")
def points_in_polygons(spark, d):
    met = polygons.points_in(L.pois(spark, d).select("poi_id", "x", "y", "value"), half_zones(spark), 500.0)
    return met.groupBy("zone_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("lines_in_polygons", f"WITH {LINES}, {CUT} SELECT zone_id, count(*) AS streets, round(sum(part), 3) AS inside_length FROM street_in GROUP BY 1")
def lines_in_polygons(spark, d):
    met = polygons.segments_in(L.located_streets(spark, d).select("street_id", "ux", "uy", "vx", "vy"), half_zones(spark), 1000.0)
    return met.groupBy("zone_id").agg(F.count(F.lit(1)).alias("streets"), F.round(F.sum("inside_length"), 3).alias("inside_length"))


@query("polygons_in_polygons", f"WITH {BUILDINGS}, {BUILT_IN} SELECT bid, zone_id FROM built_in")
def polygons_in_polygons(spark, d):
    return polygons.overlaps(_rings(spark, d).withColumnRenamed("ring", "_b"), half_zones(spark), 1000.0, "_b", "ring").select("bid", "zone_id")


BLOCKS = "clip AS (SELECT street_id, length, greatest(0, least(1, CASE WHEN vx = ux THEN CASE WHEN ux > x0 AND ux < x0 + 500 THEN 1 ELSE 0 END ELSE greatest((x0 - ux) / (vx - ux), (x0 + 500 - ux) / (vx - ux)) END, CASE WHEN vy = uy THEN CASE WHEN uy > y0 AND uy < y0 + 500 THEN 1 ELSE 0 END ELSE greatest((y0 - uy) / (vy - uy), (y0 + 500 - uy) / (vy - uy)) END) - greatest(0, CASE WHEN vx = ux THEN 0 ELSE least((x0 - ux) / (vx - ux), (x0 + 500 - ux) / (vx - ux)) END, CASE WHEN vy = uy THEN 0 ELSE least((y0 - uy) / (vy - uy), (y0 + 500 - uy) / (vy - uy)) END)) AS part FROM lines, (SELECT n_nationkey % 5 * 1000 + 200.5 AS x0, n_nationkey // 5 * 1000 + 300.5 AS y0 FROM nation))"


def _blocks(spark, d):
    x, y = F.col("zone_id") % 5 * 1000 + F.lit(200.5), F.floor(F.col("zone_id") / 5) * 1000 + F.lit(300.5)
    return L.zones(spark, d).select(grids.square(x, y, x + 500, y + 500).alias("ring"))


OUTSIDE = f"WITH {LINES}, {BLOCKS} SELECT street_id, round(any_value(length) * (1 - sum(part)), 3) AS outside_length FROM clip GROUP BY 1"


@query("lines_minus_polygons", OUTSIDE)
def lines_minus_polygons(spark, d):
    return polygons.outside_length(L.located_streets(spark, d), _blocks(spark, d), "street_id", 500.0).withColumn("outside_length", F.round("outside_length", 3))


@query("lines_minus_polygons_parts", OUTSIDE.replace(" GROUP BY 1", " GROUP BY 1 HAVING any_value(length) * (1 - sum(part)) > 1e-6"))
def lines_minus_polygons_parts(spark, d):
    parts = polygons.outside_parts(L.located_streets(spark, d), _blocks(spark, d), "street_id", 500.0)
    return parts.groupBy("street_id").agg(F.round(F.sum(F.hypot(F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy"))), 3).alias("outside_length"))


@query("dissolve_zones", "WITH z AS (SELECT n_nationkey AS k, CAST(n_regionkey AS BIGINT) AS r, n_nationkey % 5 AS c FROM nation), s AS (SELECT a.r, count(*) AS n FROM z a JOIN z b ON a.r = b.r AND (b.k = a.k + 5 OR (b.k = a.k + 1 AND a.c < 4)) GROUP BY 1) SELECT z.r AS region_id, 1000000.0::DOUBLE * count(*) AS area, 4000.0::DOUBLE * count(*) - 2000.0::DOUBLE * coalesce(any_value(s.n), 0) AS perimeter FROM z LEFT JOIN s ON s.r = z.r GROUP BY 1")
def dissolve_zones(spark, d):
    z = L.zones(spark, d)
    x, y = F.col("zone_id") % 5 * 1000.0, F.floor(F.col("zone_id") / 5) * 1000.0
    return polygons.dissolve(z.select("region_id", grids.square(x, y, x + 1000, y + 1000).alias("ring")), "region_id").select("region_id", "area", "perimeter")


@query("shared_walls", "WITH z AS (SELECT CAST(n_nationkey AS BIGINT) AS k, n_nationkey % 5 AS c FROM nation) SELECT a.k AS zone_id, 1000.0::DOUBLE * count(b.k) AS shared_length, 0.25::DOUBLE * count(b.k) AS shared_ratio FROM z a LEFT JOIN z b ON abs(a.k - b.k) = 5 OR (b.k = a.k + 1 AND a.c < 4) OR (b.k = a.k - 1 AND a.c > 0) GROUP BY 1")
def shared_walls(spark, d):
    x, y = F.col("zone_id") % 5 * 1000.0, F.floor(F.col("zone_id") / 5) * 1000.0
    z = L.zones(spark, d).select("zone_id", grids.square(x, y, x + 1000, y + 1000).alias("ring"))
    return polygons.shared_walls(z, "zone_id", 500.0).select("zone_id", F.round("shared_length", 6).alias("shared_length"), F.round("shared_ratio", 6).alias("shared_ratio"))


@query("total_bounds", f"WITH {BUILDINGS} SELECT min(x) AS minx, min(y) AS miny, max(x + width) AS maxx, max(y + depth) AS maxy FROM buildings")
def total_bounds(spark, d):
    return polygons.total_bounds(_rings(spark, d))


@query("zonal_polygon_moments", f"WITH r AS (SELECT {_half()} AS zone_id, v FROM (SELECT (range % 50) * 100.0 + 50.5 AS x, (range // 50) * 100.0 + 50.25 AS y, CAST((range // 50 * 31 + range % 50 * 17 + 2020) % 997 AS DOUBLE) AS v FROM range(2500))), m AS (SELECT zone_id, avg(v) AS mu FROM r GROUP BY 1) SELECT r.zone_id, count(*) AS cells, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS stdev, round(avg(pow(v - mu, 3)) / pow(avg(pow(v - mu, 2)), 1.5), 6) AS skewness, round(avg(pow(v - mu, 4)) / pow(avg(pow(v - mu, 2)), 2) - 3, 6) AS kurtosis FROM r JOIN m ON r.zone_id = m.zone_id GROUP BY 1")
def zonal_polygon_moments(spark, d):
    """Moments of the raster cells whose centres lie in polygons of any shape."""
    cells = L.raster(spark, 2020).select((F.col("col") * 100.0 + 50.5).alias("x"), (F.col("row") * 100.0 + 50.25).alias("y"), "value")
    met = polygons.cells_in(cells, half_zones(spark), 500.0)
    return met.groupBy("zone_id").agg(F.count(F.lit(1)).alias("cells"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("stdev"), F.round(F.skewness("value"), 6).alias("skewness"), F.round(F.kurtosis("value"), 6).alias("kurtosis"))


def _city(spark, d) -> C.City:
    people = L.population(spark, d).groupBy("row", "col").agg(F.sum("value").alias("value"))
    people = people.select((F.col("col") * 100.0 + 50.5).alias("x"), (F.col("row") * 100.0 + 50.25).alias("y"), "value")
    p = L.pois(spark, d)
    return C.City(L.intersections(spark, d), L.located_streets(spark, d), _rings(spark, d), None, p.select("poi_class", "x", "y"), people, p.select("x", "y", (F.col("poi_id") % 101).cast("double").alias("green")), half_zones(spark), L.POI_CLASSES, ("green",))


STATS = f"""WITH {LINES}, {BUILDINGS}, {POIS}, {POPULATION}, {CUT}, {BUILT_IN}, {WHOLE},
 z AS (SELECT CAST(range AS BIGINT) AS zone_id, CASE WHEN range % 2 = 0 THEN 1000 * ({RISE} + {SLOPE} * 500) ELSE 1000000 - 1000 * ({RISE} + {SLOPE} * 500) END / 1e6 AS area, (1000 + sqrt(1000000 + pow({SLOPE} * 1000, 2)) + CASE WHEN range % 2 = 0 THEN 2 * {RISE} + {SLOPE} * 1000 ELSE 2000 - 2 * {RISE} - {SLOPE} * 1000 END) / 1000 AS perimeter FROM range(50)),
 n AS (SELECT {_half()} AS zone_id, count(*) AS num_nodes FROM nodes GROUP BY 1),
 e AS (SELECT zone_id, count(*) AS num_edges, sum(length) AS s, avg(length) AS m, stddev_samp(length) AS sd FROM street_in GROUP BY 1),
 h AS (SELECT zone_id, count(*) AS num_buildings, sum(area) AS s, avg(area) AS m, stddev_samp(area) AS sd, sum(perimeter) AS p, avg(perimeter) AS pm FROM built_in JOIN b ON b.bid = built_in.bid GROUP BY 1),
 q AS (SELECT {_half()} AS zone_id, {_pivot_sql('pois', 'zone_id')}, avg(CAST(poi_id % 101 AS DOUBLE)) AS gm, stddev_samp(CAST(poi_id % 101 AS DOUBLE)) AS gs FROM pois GROUP BY 1),
 c AS (SELECT {_half()} AS zone_id, CAST(sum(value) AS BIGINT) AS population FROM (SELECT col * 100.0 + 50.5 AS x, row * 100.0 + 50.25 AS y, value FROM population) GROUP BY 1)
 SELECT z.zone_id, round(z.area, 6) AS area, round(z.perimeter, 6) AS perimeter, coalesce(num_nodes, 0) AS num_nodes, round(coalesce(num_nodes, 0) / z.area, 3) AS node_density, coalesce(num_edges, 0) AS num_edges, round(coalesce(e.s, 0), 3) AS total_edge_length, round(coalesce(e.m, 0), 3) AS mean_edge_length, round(coalesce(e.sd, 0), 3) AS std_edge_length, round(coalesce(num_edges, 0) / z.area, 3) AS edge_density, round(round(coalesce(e.s, 0), 3) / z.area, 3) AS edge_length_density, round(coalesce(2.0 * num_edges / num_nodes, 0), 3) AS mean_node_degree,
 coalesce(num_buildings, 0) AS num_buildings, round(coalesce(h.s, 0) / 1e6, 6) AS total_building_area, round(coalesce(h.m, 0), 3) AS mean_building_area, round(coalesce(h.sd, 0), 3) AS std_building_area, round(coalesce(h.p, 0), 3) AS total_building_perimeter, round(coalesce(h.pm, 0), 3) AS mean_building_perimeter, round(coalesce(h.s, 0) / 1e6 / z.area * 100, 3) AS footprint_percent, {", ".join(f"coalesce({k}, 0) AS {k}" for k in L.POI_CLASSES)}, coalesce(population, 0) AS population, round(coalesce(gm, 0), 3) AS green_mean, round(coalesce(gs, 0), 3) AS green_std
 FROM z LEFT JOIN n ON n.zone_id = z.zone_id LEFT JOIN e ON e.zone_id = z.zone_id LEFT JOIN h ON h.zone_id = z.zone_id LEFT JOIN q ON q.zone_id = z.zone_id LEFT JOIN c ON c.zone_id = z.zone_id"""


@query("aggregate_stats", STATS)
def aggregate_stats(spark, d):
    """Streets, buildings, points of interest, population and imagery of fifty zones that are no squares."""
    city = _city(spark, d)
    out = C.aggregate_stats(city.zones, "zone_id", city, 1000.0)
    return out.withColumns({"area": F.round("area", 6), "perimeter": F.round("perimeter", 6)})


@query("network_context", f"""WITH {LINES}, {POIS}, {POPULATION},
 p AS (SELECT n.id, {_pivot_sql('p', 'id')}, avg(CAST(poi_id % 101 AS DOUBLE)) AS gm, stddev_samp(CAST(poi_id % 101 AS DOUBLE)) AS gs FROM nodes n JOIN pois p ON abs(n.x - p.x) <= 100 AND (n.x - p.x) * (n.x - p.x) + (n.y - p.y) * (n.y - p.y) <= 10000 GROUP BY 1),
 q AS (SELECT n.id, CAST(sum(c.value) AS BIGINT) AS population FROM nodes n JOIN (SELECT col * 100.0 + 50.5 AS x, row * 100.0 + 50.25 AS y, value FROM population) c ON abs(n.x - c.x) <= 100 AND (n.x - c.x) * (n.x - c.x) + (n.y - c.y) * (n.y - c.y) <= 10000 GROUP BY 1),
 k AS (SELECT a.id, count(*) AS node_count FROM nodes a JOIN nodes b ON abs(a.x - b.x) <= 100 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 10000 GROUP BY 1),
 d AS (SELECT u, count(*) AS degree FROM streets GROUP BY 1)
 SELECT n.id AS intersection_id, coalesce(degree, 0) AS degree, node_count, round(node_count / (pi() * 0.01), 3) AS node_density, {", ".join(f"coalesce({k}, 0) AS {k}" for k in L.POI_CLASSES)}, coalesce(population, 0) AS population, round(coalesce(gm, (SELECT avg(gm) FROM p)), 3) AS green_mean, round(coalesce(gs, 0), 3) AS green_std
 FROM nodes n LEFT JOIN p ON p.id = n.id LEFT JOIN q ON q.id = n.id LEFT JOIN k ON k.id = n.id LEFT JOIN d ON d.u = n.id""")
def network_context(spark, d):
    """The street network's nodes with their degree and with all that lies within 100 m, but for streets and buildings."""
    city = _city(spark, d)
    city = C.City(intersections=city.intersections, pois=city.pois, population=city.population, images=city.images, classes=city.classes, indicators=city.indicators)
    nodes = graph.out_degree(L.intersections(spark, d), L.streets(spark, d), "intersection_id").join(L.intersections(spark, d).select("intersection_id", "x", "y"), "intersection_id")
    return C.point_context(nodes, "intersection_id", city, 100.0).drop("x", "y")


# The SQL of each attribute group with the roundings of the whole network.
GROUPS = f"""WITH c AS ({ORACLES["network_context"]}), t AS ({ORACLES["clustering"].replace(", 6) AS clustering", ", 3) AS clustering")}), r AS ({ORACLES["pagerank"].replace(", 7) AS pagerank", ", 6) AS pagerank")}), s AS ({ORACLES["street_catchment"].replace("round(sum(l), 3)", "sum(l)")}),
 f AS (WITH {DISCS} SELECT id AS intersection_id, count(*) AS n, sum(a) AS a, avg(area) AS m, stddev_samp(area) AS d, sum(perimeter) AS p, avg(perimeter) AS pm FROM held GROUP BY 1), v AS (WITH {NODES} SELECT id AS intersection_id, value, x, y FROM nodes)
 SELECT v.*, clustering, pagerank, c.* EXCLUDE (intersection_id), round(length, 3) AS street_length, round(length / (pi() * 0.01) / 1000, 3) AS street_density, coalesce(n, 0) AS building_count, round(coalesce(a, 0) / (pi() * 10000), 3) AS footprint_proportion, round(coalesce(m, 0), 3) AS footprint_mean,
  round(coalesce(d, 0), 3) AS footprint_std, round(coalesce(p, 0), 3) AS perimeter_total, round(coalesce(pm, 0), 3) AS perimeter_mean FROM v JOIN c USING (intersection_id) JOIN t USING (intersection_id) JOIN r USING (intersection_id) JOIN s USING (intersection_id) LEFT JOIN f USING (intersection_id)"""


@query("street_network", GROUPS)
def street_network(spark, d):
    """All attribute groups of the feature-rich street network."""
    return C.street_network(_city(spark, d))[0]


def _topology(spark, d, *groups: str):
    city = _city(spark, d)
    return C.street_network(C.City(intersections=city.intersections, streets=city.streets), attributes=("topology", *groups))[0].drop("x", "y", "value")


def street_centrality(spark, d):
    """All topology of the street network: degree, both clusterings, and five centralities."""
    return _topology(spark, d, "centrality")


@query("street_topology", f"""WITH d AS ({ORACLES["out_degree"]}), t AS ({ORACLES["clustering"].replace(", 6) AS clustering", ", 3) AS clustering")}), r AS ({ORACLES["pagerank"].replace(", 7) AS pagerank", ", 6) AS pagerank")}), k AS ({ORACLES["katz"].replace(", 7) AS katz", ", 6) AS katz")}), w AS ({ORACLES["weighted_clustering"]})
 SELECT * FROM d JOIN t USING (intersection_id) JOIN r USING (intersection_id) JOIN k USING (intersection_id) JOIN w USING (intersection_id)""")
def street_topology(spark, d):
    """The topology that SQL reaches in few rounds."""
    return _topology(spark, d, "katz", "weighted_clustering")


query("street_centrality")(street_centrality)


@query("dual_network", f"WITH {LINES} SELECT street_id AS node_id, round((ux + vx) / 2, 3) AS x, round((uy + vy) / 2, 3) AS y, round(length, 3) AS length FROM lines")
def dual_network(spark, d):
    nodes, _ = C.street_network(_city(spark, d), dual=True)
    return nodes.select("node_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round("length", 3).alias("length"))


NETWORK = f"""WITH RECURSIVE {LINES}, i AS (SELECT id FROM nodes WHERE x < 2500 AND y < 2500), border AS (SELECT id FROM i UNION SELECT u FROM streets JOIN i ON i.id = v UNION SELECT v FROM streets JOIN i ON i.id = u),
 town AS (SELECT * FROM lines WHERE u IN (SELECT id FROM border) AND v IN (SELECT id FROM border)), {CHAIN.format("town")},
 simple AS MATERIALIZED (SELECT * FROM (SELECT street_id, u, here AS v, round(length, 3) AS length, CAST(n AS BIGINT) AS n_parts FROM walk WHERE done UNION ALL SELECT street_id, u, v, round(length, 3), 1 FROM m WHERE fe AND te) WHERE u <> v),
 ends AS (SELECT u AS a, v AS b FROM simple UNION SELECT v, u FROM simple), r(n, m) AS (SELECT a, a FROM ends UNION SELECT ends.b, r.m FROM r JOIN ends ON ends.a = r.n WHERE r.m < ends.b), p AS (SELECT n, min(m) AS m FROM r GROUP BY 1),
 largest AS (SELECT n FROM p WHERE m = (SELECT m FROM p GROUP BY 1 ORDER BY count(*) DESC, m LIMIT 1))
 SELECT * FROM simple WHERE u IN (SELECT n FROM largest)"""


@query("network_layer", NETWORK)
def network_layer(spark, d):
    """Simplified, cut at a border, of the largest component, without loops."""
    return C.network_layer(_city(spark, d), (F.col("x") < 2500) & (F.col("y") < 2500))[1].select("street_id", "u", "v", F.round("length", 3).alias("length"), "n_parts")


@query("population_layer", f"WITH {POPULATION} SELECT CAST(col AS DOUBLE) AS x, CAST(row AS DOUBLE) AS y, coalesce(sum(value) FILTER (cell % 3 = 0), 0) AS men, coalesce(sum(value) FILTER (cell % 2 = 0), 0) AS women FROM population WHERE cell % 3 = 0 OR cell % 2 = 0 GROUP BY 1, 2")
def population_layer(spark, d):
    p = L.population(spark, d).select(F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), "value", "cell")
    return C.population_layer({"men": p.where("cell % 3 = 0"), "women": p.where("cell % 2 = 0")})


NEAR = f"WITH {BUILDINGS}, k AS (SELECT a.bid, b.area, row_number() OVER (PARTITION BY a.bid ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.bid) AS rank FROM buildings a, buildings b), r AS (SELECT a.bid, avg(b.area) AS m, stddev_samp(b.area) AS s FROM buildings a JOIN buildings b ON abs(a.x - b.x) <= 150 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 22500 AND a.bid <> b.bid GROUP BY 1), t AS (SELECT bid, avg(area) FILTER (rank <= 3) AS m3, stddev_samp(area) FILTER (rank <= 3) AS s3, avg(area) AS m8, stddev_samp(area) AS s8 FROM k WHERE rank <= 8 GROUP BY 1)"


@query("building_nodes", NEAR + ' SELECT t.bid, round(m3, 3) AS "3nn_area_mean", round(s3, 3) AS "3nn_area_std", round(m8, 3) AS "8nn_area_mean", round(s8, 3) AS "8nn_area_std", round(coalesce(m, 0), 3) AS "150m_area_mean", round(coalesce(s, 0), 3) AS "150m_area_std" FROM t LEFT JOIN r ON r.bid = t.bid')
def building_nodes(spark, d):
    """Means and deviations over the 3 and 8 nearest buildings and over those within 150 m."""
    out = C.building_nodes(L.buildings(spark, d).select("bid", "x", "y", "area"), ["area"], (3, 8), (150.0,), 200.0)
    return out.select("bid", *[F.round(c, 3).alias(c) for c in out.columns if c.endswith(("_mean", "_std"))])


def _grid_streets(spark):
    """Streets from edge to edge of the town along the zones' borders: 0 to 5 run east, 100 to 105 north."""
    k = spark.range(6).select("id", (F.col("id") * 1000.0).alias("at"))
    o, w = F.lit(0.0), F.lit(5000.0)
    east = k.select(F.col("id").alias("street_id"), (F.col("id") + 200).alias("u"), (F.col("id") + 300).alias("v"), o.alias("ux"), F.col("at").alias("uy"), w.alias("vx"), F.col("at").alias("vy"))
    north = k.select((F.col("id") + 100).alias("street_id"), (F.col("id") + 400).alias("u"), (F.col("id") + 500).alias("v"), F.col("at").alias("ux"), o.alias("uy"), F.col("at").alias("vx"), w.alias("vy"))
    return east.unionByName(north).withColumn("length", F.hypot(F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy")))


@query("plot_nodes", f"WITH {BUILDINGS}, {BUILT_IN}, {WHOLE}, g AS (SELECT zone_id, count(*) AS n, sum(area) AS t, avg(area) AS m, stddev_samp(area) AS sd FROM square_in JOIN b ON b.bid = square_in.bid GROUP BY 1) SELECT CAST(range % 5 AS DOUBLE) * 1000 AS x, CAST(range // 5 AS DOUBLE) * 1000 AS y, 1000000.0::DOUBLE AS area, 4000.0::DOUBLE AS perimeter, concat(range // 5, ',', range // 5 + 1, ',', range % 5 + 100, ',', range % 5 + 101) AS streets, coalesce(n, 0) AS building_count, round(coalesce(t, 0) / 1e6, 3) AS coverage, round(coalesce(m, 0), 3) AS building_area_mean, round(coalesce(sd, 0), 3) AS building_area_std FROM range(25) LEFT JOIN g ON g.zone_id = range")
def plot_nodes(spark, d):
    """Plots that streets enclose, with their lists of streets and figures of their buildings."""
    out = C.plot_nodes(_grid_streets(spark), _rings(spark, d), 1000.0)
    first = F.col("ring")[0]
    return out.select(first["x"].alias("x"), first["y"].alias("y"), F.round("area", 3).alias("area"), F.round("perimeter", 3).alias("perimeter"), F.array_join(F.transform("street_id", lambda k: k.cast("string")), ",").alias("streets"), "building_count", "coverage", "building_area_mean", "building_area_std")


SQUARE_STREETS = """w AS (SELECT *, unnest(generate_series(CAST(floor(least(uy, vy) / 1000) AS BIGINT), CAST(floor(greatest(uy, vy) / 1000) AS BIGINT))) AS row FROM (SELECT *, unnest(generate_series(CAST(floor(least(ux, vx) / 1000) AS BIGINT), CAST(floor(greatest(ux, vx) / 1000) AS BIGINT))) AS col FROM lines)),
 wt AS (SELECT *, CASE WHEN vx = ux THEN 0 ELSE least((col * 1000 - ux) / (vx - ux), (col * 1000 + 1000 - ux) / (vx - ux)) END AS x0, CASE WHEN vx = ux THEN 1 ELSE greatest((col * 1000 - ux) / (vx - ux), (col * 1000 + 1000 - ux) / (vx - ux)) END AS x1, CASE WHEN vy = uy THEN 0 ELSE least((row * 1000 - uy) / (vy - uy), (row * 1000 + 1000 - uy) / (vy - uy)) END AS y0, CASE WHEN vy = uy THEN 1 ELSE greatest((row * 1000 - uy) / (vy - uy), (row * 1000 + 1000 - uy) / (vy - uy)) END AS y1 FROM w),
 ws AS (SELECT DISTINCT street_id, row * 5 + col AS zone_id FROM wt WHERE (least(1, x1, y1) - greatest(0, x0, y0)) > 1e-9)"""


@query("urban_relations", f"""WITH {LINES}, {BUILDINGS}, {BUILT_IN}, {SQUARE_STREETS},
 near AS (SELECT bid, street_id FROM (SELECT *, row_number() OVER (PARTITION BY bid ORDER BY round(distance, 9), street_id) AS k FROM (SELECT bid, street_id, sqrt(pow(x - ux - t * dx, 2) + pow(y - uy - t * dy, 2)) AS distance FROM (SELECT bid, street_id, x, y, ux, uy, vx - ux AS dx, vy - uy AS dy, greatest(0, least(1, ((x - ux) * (vx - ux) + (y - uy) * (vy - uy)) / ((vx - ux) * (vx - ux) + (vy - uy) * (vy - uy)))) AS t FROM (SELECT bid, x, y FROM buildings), (SELECT street_id, ux, uy, vx, vy FROM lines))) WHERE distance <= 50) WHERE k = 1),
 knn AS (SELECT bid, neighbour FROM (SELECT a.bid, b.bid AS neighbour, row_number() OVER (PARTITION BY a.bid ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.bid) AS k FROM buildings a, buildings b) WHERE k <= 5),
 r AS (SELECT 'boundary_to_plot' AS relation, 0 AS src, n_nationkey AS dst FROM nation UNION ALL SELECT 'plot_to_boundary', n_nationkey, 0 FROM nation
  UNION ALL SELECT 'plot_to_plot', src, dst FROM (SELECT DISTINCT a.zone_id AS src, b.zone_id AS dst FROM ws a JOIN ws b ON a.street_id = b.street_id AND a.zone_id <> b.zone_id)
  UNION ALL SELECT 'building_to_building', neighbour, bid FROM knn
  UNION ALL SELECT 'building_to_street', bid, street_id FROM near UNION ALL SELECT 'street_to_building', street_id, bid FROM near
  UNION ALL SELECT 'intersection_to_street', u, street_id FROM streets UNION ALL SELECT 'intersection_to_street', v, street_id FROM streets
  UNION ALL SELECT 'street_to_intersection', street_id, u FROM streets UNION ALL SELECT 'street_to_intersection', street_id, v FROM streets
  UNION ALL SELECT 'building_to_plot', bid, zone_id FROM square_in UNION ALL SELECT 'plot_to_building', zone_id, bid FROM square_in
  UNION ALL SELECT 'street_to_plot', street_id, zone_id FROM ws UNION ALL SELECT 'plot_to_street', zone_id, street_id FROM ws)
 SELECT relation, CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM r""")
def urban_relations(spark, d):
    """All twelve relations, with zones for plots."""
    x, y = F.col("zone_id") % 5 * 1000.0, F.floor(F.col("zone_id") / 5) * 1000.0
    z = L.zones(spark, d).select(F.col("zone_id").alias("plot_id"), grids.square(x, y, x + 1000, y + 1000).alias("ring"))
    s = graph._held(L.located_streets(spark, d))
    on = polygons.segments_in(s.select("street_id", "ux", "uy", "vx", "vy"), z, 1000.0).groupBy("plot_id").agg(F.collect_set("street_id").alias("street_id"))
    b = polygons.overlaps(_rings(spark, d).withColumnRenamed("ring", "_b"), z, 1000.0, "_b", "ring").groupBy("plot_id").agg(F.collect_set("bid").alias("bid"))
    plot = z.join(on, "plot_id", "left").join(b, "plot_id", "left")
    g = relations.initialise({"boundary": z, "building": L.buildings(spark, d).select("bid", "x", "y"), "plot": plot, "street": s, "intersection": L.intersections(spark, d)}, "knn", 5, 200.0, 50.0)
    out = None
    for name, e in sorted(g.edges.items()):
        part = e.select(F.lit(name).alias("relation"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
        out = part if out is None else out.unionByName(part)
    return out


def _border_streets(spark):
    """(intersections, streets) of the zones' borders: 36 crossings and the 60 streets between neighbours."""
    at = spark.range(36).select(F.col("id").alias("intersection_id"), (F.col("id") % 6 * 1000.0).alias("x"), (F.floor(F.col("id") / 6) * 1000.0).alias("y"))
    u, v = at.toDF("u", "ux", "uy"), at.toDF("v", "vx", "vy")
    east = u.where("u % 6 < 5").select((F.floor(F.col("u") / 6) * 5 + F.col("u") % 6).alias("street_id"), "u", (F.col("u") + 1).alias("v"), "ux", "uy")
    north = u.where("u < 30").select((100 + F.col("u") % 6 * 5 + F.floor(F.col("u") / 6)).alias("street_id"), "u", (F.col("u") + 6).alias("v"), "ux", "uy")
    return at, east.unionByName(north).join(v, "v").withColumn("length", F.lit(1000.0))


@query("urban_graph", f"""WITH {BUILDINGS}, {BUILT_IN},
 crossings AS (SELECT CAST(range AS BIGINT) AS id, range % 6 AS c, range // 6 AS r FROM range(36)),
 blocks AS (SELECT r * 5 + c AS street_id, id AS u, id + 1 AS v, c * 1000 AS ux, r * 1000 AS uy, c * 1000 + 1000 AS vx, r * 1000 AS vy FROM crossings WHERE c < 5 UNION ALL SELECT 100 + c * 5 + r, id, id + 6, c * 1000, r * 1000, c * 1000, r * 1000 + 1000 FROM crossings WHERE r < 5),
 z AS (SELECT range AS zone_id, range % 5 AS c, range // 5 AS r FROM range(25)),
 sides AS (SELECT zone_id, unnest([r * 5 + c, r * 5 + 5 + c, 100 + c * 5 + r, 105 + c * 5 + r]) AS street_id FROM z),
 mid AS (SELECT bid, x + width * CASE WHEN bid % 2 = 0 THEN 0.5 ELSE 5.0 / 12 END AS x, y + depth * CASE WHEN bid % 2 = 0 THEN 0.5 ELSE 5.0 / 12 END AS y FROM buildings),
 knn AS (SELECT bid, neighbour FROM (SELECT a.bid, b.bid AS neighbour, row_number() OVER (PARTITION BY a.bid ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.bid) AS k FROM mid a, mid b) WHERE k <= 5),
 near AS (SELECT bid, street_id FROM (SELECT bid, street_id, row_number() OVER (PARTITION BY bid ORDER BY round(distance, 9), street_id) AS k FROM (SELECT bid, street_id, sqrt(pow(greatest(ux - x, 0, x - vx), 2) + pow(greatest(uy - y, 0, y - vy), 2)) AS distance FROM mid, blocks) WHERE distance <= 50) WHERE k = 1),
 r AS (SELECT 'boundary_to_plot' AS relation, 0 AS src, zone_id AS dst FROM z UNION ALL SELECT 'plot_to_boundary', zone_id, 0 FROM z
  UNION ALL SELECT 'plot_to_plot', a.zone_id, b.zone_id FROM sides a JOIN sides b ON a.street_id = b.street_id AND a.zone_id <> b.zone_id
  UNION ALL SELECT 'building_to_building', neighbour, bid FROM knn
  UNION ALL SELECT 'building_to_street', bid, street_id FROM near UNION ALL SELECT 'street_to_building', street_id, bid FROM near
  UNION ALL SELECT 'intersection_to_street', u, street_id FROM blocks UNION ALL SELECT 'intersection_to_street', v, street_id FROM blocks
  UNION ALL SELECT 'street_to_intersection', street_id, u FROM blocks UNION ALL SELECT 'street_to_intersection', street_id, v FROM blocks
  UNION ALL SELECT 'building_to_plot', bid, zone_id FROM square_in UNION ALL SELECT 'plot_to_building', zone_id, bid FROM square_in
  UNION ALL SELECT 'street_to_plot', street_id, zone_id FROM sides UNION ALL SELECT 'plot_to_street', zone_id, street_id FROM sides)
 SELECT relation, CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM r""")
def urban_graph(spark, d):
    """All twelve relations of the graph built from streets and buildings alone; plots are named by the zone they equal."""
    nodes, streets = _border_streets(spark)
    g = C.urban_graph(C.City(intersections=nodes, streets=streets, buildings=_rings(spark, d)), 1000.0)
    first = F.col("ring")[0]
    zones = g.nodes["plot"].select("plot_id", F.round(first["y"] / 1000 * 5 + first["x"] / 1000).cast("long").alias("zone_id"))
    out = None
    for name, e in sorted(g.edges.items()):
        for end, kind in zip(("src", "dst"), name.split("_to_"), strict=True):
            if kind == "plot":
                e = e.join(F.broadcast(zones), F.col(end) == F.col("plot_id")).withColumn(end, F.col("zone_id")).drop("plot_id", "zone_id")
        part = e.select(F.lit(name).alias("relation"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
        out = part if out is None else out.unionByName(part)
    return out


# Yearly graphs: nodes that are there in a year, and the streets between two of them.
YEARLY = f"WITH RECURSIVE {NODES}, {STREETS}, y AS (SELECT unnest([{', '.join(map(str, YEARS))}]) AS year), there AS (SELECT id, year FROM nodes, y WHERE (id * 13 + year) % 600 >= 300), e AS (SELECT DISTINCT s.u, s.v, a.year FROM streets s JOIN there a ON a.id = s.u JOIN there b ON b.id = s.v AND b.year = a.year)"


def _kept(spark, d):
    kept = L.intersections(spark, d).select("intersection_id").withColumn("year", F.explode(F.lit(list(YEARS))))
    return kept.where((F.col("intersection_id") * 13 + F.col("year")) % 600 >= 300)


@query("temporal_largest", YEARLY + ", ends AS (SELECT u, v, year FROM e UNION SELECT v, u, year FROM e), r(year, n, m) AS (SELECT DISTINCT year, u, u FROM ends UNION SELECT r.year, ends.v, r.m FROM r JOIN ends ON ends.u = r.n AND ends.year = r.year WHERE r.m < ends.v), c AS (SELECT year, n, min(m) AS m FROM r GROUP BY 1, 2), best AS (SELECT year, m FROM (SELECT year, m, row_number() OVER (PARTITION BY year ORDER BY count(*) DESC, m) AS k FROM c GROUP BY 1, 2) WHERE k = 1) SELECT CAST(c.year AS INTEGER) AS year, n AS intersection_id FROM c JOIN best ON best.year = c.year AND best.m = c.m")
def temporal_largest(spark, d):
    """The largest component of each year's graph."""
    nodes, _ = temporal.largest(_kept(spark, d), L.streets(spark, d), "intersection_id")
    return nodes.select("year", "intersection_id")


# Distances and numbers of shortest paths go out from every node, shares of paths come back from the farthest nodes;
# ranks are iterated far beyond the rounding. Eigenvectors converge too slowly for SQL here: once compared, equal.
METRICS = """, ends AS (SELECT u, v, year FROM e UNION SELECT v, u, year FROM e), r(year, n, m) AS (SELECT DISTINCT year, u, u FROM ends UNION SELECT r.year, ends.v, r.m FROM r JOIN ends ON ends.u = r.n AND ends.year = r.year WHERE r.m < ends.v),
 c AS (SELECT year, n, min(m) AS m FROM r GROUP BY 1, 2), best AS (SELECT year, m FROM (SELECT year, m, row_number() OVER (PARTITION BY year ORDER BY count(*) DESC, m) AS k FROM c GROUP BY 1, 2) WHERE k = 1),
 g AS MATERIALIZED (SELECT c.year, n AS id, count(*) OVER (PARTITION BY c.year) AS n FROM c JOIN best ON best.year = c.year AND best.m = c.m),
 f AS MATERIALIZED (SELECT e.year, e.u, e.v, count(*) OVER (PARTITION BY e.year, e.u) AS ways FROM e JOIN g ON g.year = e.year AND g.id = e.u WHERE e.u <> e.v),
 reach(year, s, v, d, p) USING KEY (year, s, v) AS (SELECT year, id, id, 0, 1.0::DOUBLE FROM g UNION SELECT w.* FROM (SELECT t.year, t.s, f.v, t.d + 1, sum(t.p) FROM reach t JOIN f ON f.year = t.year AND f.u = t.v GROUP BY 1, 2, 3, 4) w(year, s, v, d, p) ANTI JOIN recurring.reach k ON k.year = w.year AND k.s = w.s AND k.v = w.v),
 far AS MATERIALIZED (SELECT * FROM reach),
 back(year, s, v, d, p, share) AS (SELECT year, s, v, d, p, 0.0::DOUBLE FROM far WHERE d = (SELECT max(d) FROM far) UNION ALL SELECT far.year, far.s, far.v, far.d, far.p, far.p * coalesce(h.x, 0) FROM (SELECT max(d) - 1 AS k FROM back) l JOIN far ON far.d = l.k
  LEFT JOIN (SELECT b.year, b.s, f.u, sum((1 + b.share) / b.p) AS x FROM back b JOIN f ON f.year = b.year AND f.v = b.v GROUP BY 1, 2, 3) h ON h.year = far.year AND h.s = far.s AND h.u = far.v),
 near AS (SELECT year, s AS id, CASE WHEN sum(d) > 0 THEN (count(*) - 1) / CAST(sum(d) AS DOUBLE) ELSE 0.0 END AS closeness FROM far GROUP BY 1, 2),
 mid AS (SELECT year, v AS id, sum(share) AS t FROM back WHERE d > 0 GROUP BY 1, 2),
 ranks(year, id, n, i, p, k) AS (SELECT year, id, n, 0, 1.0::DOUBLE / n, 1.0::DOUBLE FROM g UNION ALL
  SELECT q.year, q.id, q.n, q.i + 1, 0.15 / q.n + 0.85 * coalesce(h.p, 0), 1.0 + 0.01 * coalesce(h.k, 0)
   FROM ranks q LEFT JOIN (SELECT f.year, f.v, sum(o.p / f.ways) AS p, sum(o.k) AS k FROM f JOIN ranks o ON o.year = f.year AND o.id = f.u GROUP BY 1, 2) h ON h.year = q.year AND h.v = q.id WHERE q.i < 150),
 last AS (SELECT * FROM ranks WHERE i = 150)
 SELECT CAST(g.year AS INTEGER) AS year, g.id AS intersection_id, coalesce(ways, 0) AS degree, round(closeness, 6) AS closeness, round(CASE WHEN n > 2 THEN coalesce(t, 0) / ((n - 1) * (n - 2)) ELSE 0.0 END, 6) AS betweenness, round(p, 6) AS pagerank, round(k, 6) AS katz
 FROM g JOIN near USING (year, id) LEFT JOIN mid USING (year, id) JOIN (SELECT year, id, p, k FROM last) USING (year, id) LEFT JOIN (SELECT DISTINCT year, u AS id, ways FROM f) USING (year, id)"""


@query("temporal_centrality", YEARLY + METRICS)
def temporal_centrality(spark, d):
    """The metrics of each year's largest component that SQL reaches in few rounds."""
    return temporal_metrics(spark, d).drop("eigenvector")


@query("temporal_metrics")
def temporal_metrics(spark, d):
    """Degree, closeness, betweenness, PageRank, Katz and eigenvector of each year's largest component."""
    return temporal.metrics(*temporal.largest(_kept(spark, d), L.streets(spark, d), "intersection_id"), "intersection_id")


# Map data: intersections as nodes, orders as ways of two nodes with tags.
def _extract(spark, d):
    none = F.create_map().cast("map<string,string>")
    nodes = L.intersections(spark, d).select(F.col("intersection_id").alias("id"), F.col("x").alias("lon"), F.col("y").alias("lat"), F.when(F.col("intersection_id") % 5 == 0, F.create_map(F.lit("amenity"), F.concat(F.lit("kind"), (F.col("intersection_id") % 3).cast("string")))).otherwise(none).alias("tags"))
    s = L.streets(spark, d)
    kind = F.get(F.array(*[F.lit(k) for k in ("primary", "footway", "residential", "motorway")]), (F.col("street_id") % 4).cast("int"))
    one = F.when(F.col("street_id") % 3 == 0, F.create_map(F.lit("oneway"), F.lit("yes"))).when(F.col("street_id") % 3 == 1, F.create_map(F.lit("oneway"), F.lit("-1"))).otherwise(none)
    return nodes, s.select(F.col("street_id").alias("id"), F.array("u", "v").alias("nodes"), F.map_concat(F.create_map(F.lit("highway"), kind), one).alias("tags"))


@query("mapdata_network", f"WITH {STREETS}, r AS (SELECT * FROM streets WHERE street_id % 4 <> 1) SELECT street_id AS way, u, v FROM r WHERE street_id % 3 = 0 OR (street_id % 3 = 2) UNION ALL SELECT street_id, v, u FROM r WHERE street_id % 3 = 1 OR (street_id % 3 = 2 AND street_id % 4 <> 3)")
def mapdata_network(spark, d):
    """Directed pieces of driving streets from nodes and ways; motorways run one way by themselves."""
    return mapdata.street_edges(*_extract(spark, d)).select("way", "u", "v")


@query("mapdata_extract", f"WITH {NODES}, {STREETS}, i AS (SELECT id FROM nodes WHERE x < 1500.5 AND y < 1500.5), k AS (SELECT * FROM streets WHERE u IN (SELECT id FROM i) OR v IN (SELECT id FROM i)) SELECT 'node' AS kind, id FROM (SELECT id FROM i UNION SELECT u FROM k UNION SELECT v FROM k) UNION ALL SELECT 'way', street_id FROM k")
def mapdata_extract(spark, d):
    at = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    box = F.array(at(-1.0, -1.0), at(1500.5, -1.0), at(1500.5, 1500.5), at(-1.0, 1500.5), at(-1.0, -1.0))
    nodes, ways = mapdata.extract(*_extract(spark, d), box)
    return nodes.select(F.lit("node").alias("kind"), "id").unionByName(ways.select(F.lit("way").alias("kind"), "id"))


@query("mapdata_pois", f"WITH {NODES} SELECT id, concat('kind', id % 3) AS amenity FROM nodes WHERE id % 5 = 0")
def mapdata_pois(spark, d):
    return mapdata.points_of_interest(_extract(spark, d)[0]).select("id", "amenity")


@query("line_project", f"WITH {LINES}, g AS (SELECT street_id, ux, uy, (ux + vx) / 2 + 10 AS mx, (uy + vy) / 2 - 20 AS my, vx, vy, (ux * 2 + vx) / 3 + 5 AS x, (uy * 2 + vy) / 3 + 7 AS y FROM lines), s AS (SELECT *, greatest(0, least(1, ((x - ux) * (mx - ux) + (y - uy) * (my - uy)) / ((mx - ux) * (mx - ux) + (my - uy) * (my - uy)))) AS t1, greatest(0, least(1, ((x - mx) * (vx - mx) + (y - my) * (vy - my)) / ((vx - mx) * (vx - mx) + (vy - my) * (vy - my)))) AS t2 FROM g), q AS (SELECT street_id, sqrt(pow(x - ux - t1 * (mx - ux), 2) + pow(y - uy - t1 * (my - uy), 2)) AS d1, t1 * sqrt(pow(mx - ux, 2) + pow(my - uy, 2)) AS a1, sqrt(pow(x - mx - t2 * (vx - mx), 2) + pow(y - my - t2 * (vy - my), 2)) AS d2, sqrt(pow(mx - ux, 2) + pow(my - uy, 2)) + t2 * sqrt(pow(vx - mx, 2) + pow(vy - my, 2)) AS a2 FROM s) SELECT street_id, round(least(d1, d2), 4) AS distance, round(CASE WHEN d1 <= d2 THEN a1 ELSE a2 END, 4) AS along FROM q WHERE abs(d1 - d2) > 1e-7")
def line_project(spark, d):
    """The place along a street of three vertices that is nearest to a point; equal distances on both sides left out."""
    s = L.located_streets(spark, d)
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    u, v = (F.col("ux"), F.col("uy")), (F.col("vx"), F.col("vy"))
    m = (u[0] + v[0]) / 2 + 10, (u[1] + v[1]) / 2 - 20
    x, y = (u[0] * 2 + v[0]) / 3 + 5, (u[1] * 2 + v[1]) / 3 + 7
    both = [shapes.project_on_line(F.array(at(*a), at(*b)), x, y) for a, b in ((u, m), (m, v))]
    got = s.select("street_id", shapes.project_on_line(F.array(at(*u), at(*m), at(*v)), x, y).alias("p"), (F.abs(both[0]["distance"] - both[1]["distance"]) > 1e-7).alias("apart"))
    return got.where("apart").select("street_id", F.round("p.distance", 4).alias("distance"), F.round("p.along", 4).alias("along"))


@query("colour_gradient", f"WITH {BUILDINGS}, s AS (SELECT bid, greatest(0, least(1, (size - 10) / 30.0)) * 2 AS k FROM buildings) SELECT bid, CAST(round(CASE WHEN k < 1 THEN 255 - 255 * k ELSE 0 END) AS INTEGER) AS r, CAST(round(CASE WHEN k < 1 THEN 255 * k ELSE 255 - 155 * (k - 1) END) AS INTEGER) AS g FROM s")
def colour_gradient(spark, d):
    c = shapes.gradient(F.col("size"), F.lit(10.0), F.lit(40.0), [(255, 0, 0), (0, 255, 0), (0, 100, 255)])
    return L.buildings(spark, d).select("bid", c.alias("c")).select("bid", "c.r", "c.g")


@query("tiles_of_box", "SELECT concat('12/', CAST(3228 + range % 4 AS VARCHAR), '/', CAST(2031 + range // 4 AS VARCHAR)) AS tile_id FROM range(8)")
def tiles_of_box(spark, d):
    n = 1 << 12
    lon = lambda x: x / n * 360 - 180
    lat = lambda y: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / n))))
    return shapes.tiles_of_box(spark, (lon(3228.5), lat(2032.5), lon(3231.5), lat(2031.5)), 12).select("tile_id")


@query("sample_by_length", f"WITH {LINES}, {POIS}, g AS (SELECT p.poi_id, l.street_id, CAST(floor(l.length / 500) AS BIGINT) AS most FROM pois p JOIN lines l ON l.street_id = p.poi_id % 500) SELECT poi_id, street_id FROM (SELECT *, row_number() OVER (PARTITION BY street_id ORDER BY md5(concat(CAST(poi_id AS VARCHAR), ':3')), poi_id) AS k FROM g) WHERE k <= most")
def sample_by_length(spark, d):
    """A sample of images for each street, one for each 500 m of its length."""
    s = L.located_streets(spark, d).select("street_id", F.floor(F.col("length") / 500).alias("most"))
    g = L.pois(spark, d).select("poi_id", (F.col("poi_id") % 500).alias("street_id")).join(s, "street_id")
    return clean.sample_by(g, "street_id", "poi_id", "most", 3).select("poi_id", "street_id")


@query("modal_without", f"WITH {POIS}, c AS (SELECT CAST(floor(y / 1000) * 5 + floor(x / 1000) AS BIGINT) AS zone_id, event_type, count(*) AS n FROM pois WHERE event_type <> 'view' GROUP BY 1, 2) SELECT zone_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY n DESC, event_type) AS k FROM c) WHERE k = 1")
def modal_without(spark, d):
    return clean.ranked_mode(L.pois(spark, d).select(L.zone_of().alias("zone_id"), "event_type"), ["zone_id"], "event_type", skip=("view",))


LABELS = [f"class_{k}" for k in range(66)]


@query("segment_shares", "WITH s AS (SELECT event_id % 500 AS image_id, event_id % 66 AS k, CAST(event_id % 97 + 1 AS DOUBLE) AS pixels FROM events), t AS (SELECT image_id, k, sum(pixels) AS p, count(*) AS n FROM s GROUP BY 1, 2), u AS (SELECT *, p / sum(p) OVER (PARTITION BY image_id) AS share FROM t) SELECT CAST(image_id AS BIGINT) AS image_id, " + ", ".join(f"round(coalesce(sum(share) FILTER (k = {k}), 0), 6) AS class_{k}, CAST(coalesce(sum(n) FILTER (k = {k}), 0) AS BIGINT) AS class_{k}_count" for k in range(66)) + ", round(-sum(share * ln(share)), 6) AS visual_complexity FROM u GROUP BY 1")
def segment_shares(spark, d):
    """Shares and counts of 66 classes in each image and their entropy, from a table of segments."""
    e = L.table(spark, d, "events")
    s = e.select((F.col("event_id") % 500).alias("image_id"), F.concat(F.lit("class_"), (F.col("event_id") % 66).cast("string")).alias("label"), (F.col("event_id") % 97 + 1).cast("double").alias("pixels"))
    out = clean.segment_shares(s, "image_id", "label", "pixels", LABELS)
    return out.select(F.col("image_id").cast("long").alias("image_id"), *[F.round(c, 6).alias(c) for c in LABELS], *[f"{c}_count" for c in LABELS], F.round("visual_complexity", 6).alias("visual_complexity"))


@query("complex_images", "WITH s AS (SELECT event_id % 500 AS image_id, event_id % 66 AS k, CAST(event_id % 97 + 1 AS DOUBLE) AS pixels FROM events), t AS (SELECT image_id, k, sum(pixels) AS p FROM s GROUP BY 1, 2), u AS (SELECT *, p / sum(p) OVER (PARTITION BY image_id) AS share FROM t) SELECT CAST(image_id AS BIGINT) AS image_id FROM u GROUP BY 1 HAVING -sum(share * ln(share)) >= 2.5")
def complex_images(spark, d):
    return segment_shares(spark, d).where("visual_complexity >= 2.5").select("image_id")


@query("years_side_by_side", "SELECT CAST(range // 50 AS BIGINT) AS row, CAST(range % 50 AS BIGINT) AS col, " + ", ".join(f"CAST((range // 50 * 31 + range % 50 * 17 + {y}) % 997 AS DOUBLE) AS built_{y}" for y in YEARS) + " FROM range(2500)")
def years_side_by_side(spark, d):
    return rasters.by_year({y: L.raster(spark, y) for y in YEARS}, "built_")


@query("raster_warp", "SELECT CAST(range // 60 AS BIGINT) AS row, CAST(range % 60 AS BIGINT) AS col, CAST((floor((range // 60 + 0.5) * 50 / 60) * 31 + floor((range % 60 + 0.5) * 50 / 60) * 17 + 2020) % 997 AS DOUBLE) AS value FROM range(3600)")
def raster_warp(spark, d):
    """A raster of 50 x 50 cells drawn anew on 60 x 60 by nearest cells."""
    source = rasters.Grid((0.0, 0.0, 5000.0, 5000.0), 50, 50)
    return rasters.warp(L.raster(spark, 2020), source, rasters.Grid((0.0, 0.0, 5000.0, 5000.0), 60, 60), lambda x, y: (x, y))


@query("raster_crop", "SELECT CAST(range // 50 AS BIGINT) AS row, CAST(range % 50 AS BIGINT) AS col, CASE WHEN range // 50 BETWEEN 10 AND 19 AND range % 50 BETWEEN 20 AND 34 THEN CAST((range // 50 * 31 + range % 50 * 17 + 2020) % 997 AS DOUBLE) ELSE -1.0 END AS value FROM range(2500)")
def raster_crop(spark, d):
    """Cells outside a polygon become the fill value."""
    at = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    ring = spark.range(1).select(F.array(at(2000.0, 3000.0), at(3500.0, 3000.0), at(3500.0, 4000.0), at(2000.0, 4000.0), at(2000.0, 3000.0)).alias("ring"))
    return rasters.mask(L.raster(spark, 2020), rasters.Grid((0.0, 0.0, 5000.0, 5000.0), 50, 50), ring, 500.0, -1.0)


@query("raster_concat", "SELECT CAST(range // 130 AS BIGINT) AS row, CAST(range % 130 AS BIGINT) AS col, CASE WHEN range % 130 < 50 THEN CASE WHEN range // 130 < 50 THEN CAST((range // 130 * 31 + range % 130 * 17 + 2000) % 997 AS DOUBLE) ELSE 0.0 END ELSE CAST((range // 130 * 31 + (range % 130 - 50) * 17 + 2010) % 997 AS DOUBLE) END AS value FROM range(7800)")
def raster_concat(spark, d):
    """Two rasters of unequal height side by side, the lower one padded."""
    return rasters.beside([(L.raster(spark, 2000), 50, 50), (L.raster(spark, 2010, 60, 80), 60, 80)], 0.0)


@query("table_functions", "SELECT CAST(range AS BIGINT) AS cell_id, CAST(range // 9 AS BIGINT) AS row, CAST(range % 9 AS BIGINT) AS col FROM range(81)")
def table_functions(spark, d):
    sql.register(spark)
    return spark.sql("SELECT cell_id, row, col FROM ug_grid(0D, 0D, 5000D, 5000D, 500D)")


@query("prefix_and_select", f"WITH {BUILDINGS} SELECT bid AS bid_bid, area AS bid_area FROM buildings")
def prefix_and_select(spark, d):
    return clean.prefixed(clean.by_position(L.buildings(spark, d).select("bid", "size", "area"), [0, 2]), "bid_")


@query("wkb_roundtrip", f"WITH {BUILDINGS} SELECT bid, 'Polygon' AS gtype, round(CASE WHEN bid % 2 = 0 THEN area ELSE area * 0.75 END, 3) AS area FROM buildings")
def wkb_roundtrip(spark, d):
    text = clean.to_wkb(_rings(spark, d), "ring", "wkb").drop("ring")
    back = clean.from_wkb(text, "wkb")
    return back.select("bid", "gtype", F.round(G.area(F.get(F.get("parts", F.lit(0)), F.lit(0))), 3).alias("area"))


@query("drop_covered", f"WITH {BUILDINGS} SELECT CASE WHEN k = 1 THEN bid ELSE bid + 1000000 END AS bid FROM buildings, (SELECT unnest([1, 2]) AS k) WHERE k = 1 OR bid % 3 = 0")
def drop_covered(spark, d):
    """Rectangles far apart from one another, each with a copy: smaller ones within go, those moved aside stay."""
    b = L.buildings(spark, d).withColumns({"x": F.col("bid") * 200.0, "y": F.lit(0.0)})
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "depth"))
    aside = F.when(F.col("bid") % 3 == 0, 0.9 * w).otherwise(0.0)
    # From a million buildings on a copy's number is also another building's, so rows have a key of their own.
    own, other = (F.col("bid") * 2).alias("item"), (F.col("bid") * 2 + 1).alias("item")
    copy = b.select(other, (F.col("bid") + 1_000_000).alias("bid"), grids.square(x + aside, y, x + aside + 0.8 * w, y + 0.8 * h).alias("ring"))
    return polygons.drop_covered(b.select(own, "bid", grids.square(x, y, x + w, y + h).alias("ring")).unionByName(copy), "item", 100.0, share=0.5).select("bid")
