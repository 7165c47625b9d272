"""Registered queries of paths, overlays, plots, grids, files and exports."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import grids, sql
from ..operators import clean, export, hetero, overlay, paths, plots, polygons, segments, spatial_join
from ..sources import files
from ..sources import layers as L
from ..storage import shared_path
from .queries import BUILDINGS, LANES, LINES, NODES, POIS, POPULATION, STREETS, ZONE, query

# Chains of streets and what passes through their nodes.
CHAIN = """e AS (SELECT street_id, u, v, length FROM {}),
 inc AS (SELECT u AS node, v AS other, 1 AS o FROM e UNION ALL SELECT v, u, 0 FROM e),
 kind AS (SELECT node, bool_or(node = other) OR sum(o) = 0 OR sum(o) = count(*) OR count(DISTINCT other) <> 2 OR count(*) NOT IN (2, 4) AS is_end FROM inc GROUP BY 1),
 m AS (SELECT e.*, a.is_end AS fe, b.is_end AS te FROM e JOIN kind a ON a.node = u JOIN kind b ON b.node = v),
 c AS (SELECT min(street_id) AS street_id, u, v, arg_min(length, street_id) AS length, bool_or(fe) AS fe, bool_or(te) AS te FROM m WHERE NOT (fe AND te) GROUP BY u, v),
 walk(street_id, u, came, here, done, length, n) AS (SELECT street_id, u, u, v, te, length, 1 FROM c WHERE fe UNION ALL SELECT w.street_id, w.u, c.u, c.v, c.te, w.length + c.length, w.n + 1 FROM walk w JOIN c ON c.u = w.here AND c.v <> w.came WHERE NOT w.done)"""


SIMPLE = CHAIN + " SELECT street_id, u, here AS v, round(length, 3) AS length, CAST(n AS BIGINT) AS n_parts FROM walk WHERE done UNION ALL SELECT street_id, u, v, round(length, 3), 1 FROM m WHERE fe AND te"


@query("simplify_lanes", "WITH RECURSIVE " + LANES + ", " + SIMPLE.format("lanes"))
def simplify_lanes(spark, d):
    out = paths.simplify(L.lanes(spark, d))
    return out.select("street_id", "u", "v", F.round("length", 3).alias("length"), "n_parts")


@query("simplify_streets", "WITH RECURSIVE " + LINES + ", " + SIMPLE.format("lines"))
def simplify_streets(spark, d):
    out = paths.simplify(L.located_streets(spark, d).select("street_id", "u", "v", "length"))
    return out.select("street_id", "u", "v", F.round("length", 3).alias("length"), "n_parts")


@query("weighted_clustering", f"WITH {LINES}, one AS (SELECT u, v, min(length) AS w FROM lines WHERE u <> v GROUP BY 1, 2), s AS (SELECT u, v, cbrt(w / (SELECT max(w) FROM one)) AS w FROM one), b AS (SELECT u, v, sum(w) AS w, count(*) AS n FROM (SELECT * FROM s UNION ALL SELECT v, u, w FROM s) GROUP BY 1, 2), t AS (SELECT x.u AS i, sum(x.w * y.w * z.w) AS t FROM b x JOIN b y ON x.v = y.u AND y.v <> x.u JOIN b z ON z.u = x.u AND z.v = y.v GROUP BY 1), g AS (SELECT u AS i, sum(n) AS d, sum(CASE WHEN n = 2 THEN 1 ELSE 0 END) AS r FROM b GROUP BY 1) SELECT n.id AS intersection_id, round(coalesce(CASE WHEN d * (d - 1) - 2 * r > 0 THEN coalesce(t, 0) / CAST(2 * (d * (d - 1) - 2 * r) AS DOUBLE) ELSE 0 END, 0), 6) AS weighted_clustering FROM nodes n LEFT JOIN g ON g.i = n.id LEFT JOIN t ON t.i = n.id")
def weighted_clustering(spark, d):
    return paths.weighted_clustering(L.located_streets(spark, d), L.intersections(spark, d), "intersection_id").withColumn("weighted_clustering", F.round("weighted_clustering", 6))


@query("truncate_by_edge", f"WITH {NODES}, {STREETS}, i AS (SELECT id FROM nodes WHERE x < 1500 AND y < 1500), b AS (SELECT u, v FROM streets UNION SELECT v, u FROM streets) SELECT id AS intersection_id FROM i UNION SELECT u FROM b JOIN i ON i.id = b.v")
def truncate_by_edge(spark, d):
    nodes = L.intersections(spark, d)
    return paths.truncate(nodes, L.streets(spark, d), "intersection_id", (F.col("x") < 1500) & (F.col("y") < 1500)).select("intersection_id")


def _street_lines(spark, d):
    at = lambda p: F.struct(F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y"))
    return L.located_streets(spark, d).select("street_id", "u", "v", F.array(at("u"), at("v")).alias("line"))


@query("half_streets", f"WITH {LINES} SELECT concat(street_id, '_0') AS half_id, CAST(u AS VARCHAR) AS u, concat(street_id, '_m') AS v, round(length / 2, 3) AS length FROM lines UNION ALL SELECT concat(street_id, '_1'), concat(street_id, '_m'), CAST(v AS VARCHAR), round(length / 2, 3) FROM lines")
def half_streets(spark, d):
    halves, _ = paths.half_streets(_street_lines(spark, d))
    return halves.select("half_id", "u", "v", F.round(G.length(F.col("line")), 3).alias("length"))


@query("line_segments", f"WITH {LINES} SELECT street_id, 0 AS part, ux, uy, vx, vy FROM lines")
def line_segments(spark, d):
    return grids.segments_of(_street_lines(spark, d), "street_id")


@query("zone_overlay", f"""WITH {BUILDINGS}, r AS (SELECT bid, x AS x0, y AS y0, x + width AS x1, y + CASE WHEN bid % 2 = 0 THEN depth ELSE depth / 2 END AS y1 FROM buildings UNION ALL SELECT bid, x, y + depth / 2, x + width / 2, y + depth FROM buildings WHERE bid % 2 = 1),
 c AS (SELECT *, unnest(generate_series(CAST(floor(x0 / 1000) AS BIGINT), CAST(floor(x1 / 1000) AS BIGINT))) AS col FROM r), k AS (SELECT *, unnest(generate_series(CAST(floor(y0 / 1000) AS BIGINT), CAST(floor(y1 / 1000) AS BIGINT))) AS row FROM c)
 SELECT bid, CAST(row * 5 + col AS BIGINT) AS zone_id, round(sum((least(x1, col * 1000 + 1000) - greatest(x0, col * 1000)) * (least(y1, row * 1000 + 1000) - greatest(y0, row * 1000))), 3) AS clipped_area FROM k WHERE row < 5 AND col < 5 GROUP BY 1, 2 HAVING sum((least(x1, col * 1000 + 1000) - greatest(x0, col * 1000)) * (least(y1, row * 1000 + 1000) - greatest(y0, row * 1000))) > 1e-9""")
def zone_overlay(spark, d):
    cut = overlay.with_squares(L.building_rings(spark, d).select("bid", "ring"), 1000.0)
    return cut.where("_cx BETWEEN 0 AND 4 AND _cy BETWEEN 0 AND 4").select("bid", (F.col("_cy") * 5 + F.col("_cx")).cast("long").alias("zone_id"), F.round("clipped_area", 3).alias("clipped_area"))


# The 64-sided disc in strips between its corners: the shared area is the integral of its upper border, clamped by the
# rectangle, less that of its lower one; each is two integrals of the positive part of a linear function.
DISCS = f"""{NODES}, {BUILDINGS}, rects AS (SELECT bid, x AS x0, y AS y0, x + width AS x1, y + CASE WHEN bid % 2 = 0 THEN depth ELSE depth / 2 END AS y1 FROM buildings UNION ALL SELECT bid, x, y + depth / 2, x + width / 2, y + depth FROM buildings WHERE bid % 2 = 1),
 strips AS (SELECT 100 * cos(pi() * k / 32) AS xa, 100 * sin(pi() * k / 32) AS ha, 100 * cos(pi() * (k - 1) / 32) AS xb, 100 * sin(pi() * (k - 1) / 32) AS hb FROM (SELECT unnest(generate_series(1, 32)) AS k)),
 near AS (SELECT id, bid, x0 - x AS x0, y0 - y AS y0, x1 - x AS x1, y1 - y AS y1 FROM nodes JOIN rects ON x0 < x + 100 AND x1 > x - 100 AND y0 < y + 100 AND y1 > y - 100),
 cut AS (SELECT *, ha + (hb - ha) * (greatest(x0, xa) - xa) / (xb - xa) AS p, ha + (hb - ha) * (least(x1, xb) - xa) / (xb - xa) AS q, least(x1, xb) - greatest(x0, xa) AS w FROM near JOIN strips ON x0 < xb AND x1 > xa),
 part AS (SELECT id, bid, w * s AS w, up * p - y AS p, up * q - y AS q FROM (SELECT id, bid, w, p, q, unnest([{{'up': 1, 'y': y0, 's': 1}}, {{'up': 1, 'y': y1, 's': -1}}, {{'up': -1, 'y': y0, 's': -1}}, {{'up': -1, 'y': y1, 's': 1}}], recursive := true) FROM cut)),
 clipped AS (SELECT id, bid, sum(w * CASE WHEN p >= 0 AND q >= 0 THEN (p + q) / 2 WHEN p <= 0 AND q <= 0 THEN 0 WHEN p > 0 THEN p * p / (2 * (p - q)) ELSE q * q / (2 * (q - p)) END) AS a FROM part GROUP BY 1, 2),
 held AS (SELECT id, clipped.a, CASE WHEN b.bid % 2 = 0 THEN area ELSE area * 0.75 END AS area, perimeter FROM clipped JOIN buildings b ON b.bid = clipped.bid WHERE clipped.a > 1e-9)"""


@query("footprint_context", f"""WITH {DISCS}, g AS (SELECT id, count(*) AS n, sum(a) AS s, avg(area) AS m, stddev_samp(area) AS d, sum(perimeter) AS p FROM held GROUP BY 1)
 SELECT nodes.id AS intersection_id, coalesce(n, 0) AS building_count, round(coalesce(s, 0) / (pi() * 10000), 3) AS footprint_proportion, round(coalesce(m, 0), 3) AS footprint_mean, round(coalesce(d, 0), 3) AS footprint_std, round(coalesce(p, 0), 3) AS perimeter_total FROM nodes LEFT JOIN g ON g.id = nodes.id""")
def footprint_context(spark, d):
    """Clipped footprint in the disc of 100 m of each intersection; mean, deviation and perimeter are those of whole buildings."""
    nodes = L.intersections(spark, d).select("intersection_id", "x", "y")
    rings = L.building_rings(spark, d).select("bid", "ring").withColumns({"area": G.area(F.col("ring")), "perimeter": G.length(F.col("ring"))})
    got = polygons.disc_footprints(nodes, rings, "intersection_id", 100.0, ["area", "perimeter"])
    got = got.select("intersection_id", "building_count", F.col("clipped_area").alias("s"), F.col("area_mean").alias("m"), F.col("area_std").alias("d"), F.col("perimeter_sum").alias("p"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return nodes.join(got, "intersection_id", "left").select("intersection_id", F.coalesce("building_count", F.lit(0)).alias("building_count"), F.round(z("s") / (math.pi * 10000), 3).alias("footprint_proportion"), F.round(z("m"), 3).alias("footprint_mean"), F.round(z("d"), 3).alias("footprint_std"), F.round(z("p"), 3).alias("perimeter_total"))


def _zone_rings(spark, d):
    z = L.zones(spark, d)
    x, y = (F.col("zone_id") % 5) * 1000.0, F.floor(F.col("zone_id") / 5) * 1000.0
    return z.withColumn("ring", grids.square(x, y, x + 1000, y + 1000))


@query("street_plots", "SELECT CAST(n_nationkey % 5 AS DOUBLE) * 1000 AS x, CAST(n_nationkey // 5 AS DOUBLE) * 1000 AS y, 1000000.0::DOUBLE AS area, 4000.0::DOUBLE AS perimeter FROM nation")
def street_plots(spark, d):
    """Plots between the borders of all zones, drawn as lines from edge to edge of the town."""
    line = F.explode(F.sequence(F.lit(0), F.lit(5)))
    k = _zone_rings(spark, d).agg(F.max("zone_id").alias("top")).select(line.alias("k"), (F.floor(F.col("top") / 5) * 1000 + 1000).cast("double").alias("high"))
    at, o, wide = F.col("k") * 1000.0, F.lit(0.0), F.lit(5000.0)
    across = k.where(at <= F.col("high")).select(F.col("k").alias("id"), o.alias("ux"), at.alias("uy"), wide.alias("vx"), at.alias("vy"))
    upward = k.select((F.col("k") + 100).alias("id"), at.alias("ux"), o.alias("uy"), at.alias("vx"), F.col("high").alias("vy"))
    out = plots.plots(plots.split_at_crossings(across.unionByName(upward), "id", 1000.0), 30.0)
    first = F.col("ring")[0]
    return out.select(first["x"].alias("x"), first["y"].alias("y"), F.round("area", 3).alias("area"), F.round("perimeter", 3).alias("perimeter"))


@query("merge_zones", "WITH z AS (SELECT n_nationkey AS k, CAST(n_regionkey AS BIGINT) AS r, n_nationkey % 5 AS c FROM nation), s AS (SELECT a.r, count(*) AS n FROM z a JOIN z b ON a.r = b.r AND (b.k = a.k + 5 OR (b.k = a.k + 1 AND a.c < 4)) GROUP BY 1) SELECT z.r AS region_id, count(*) AS n_zones, 4000.0::DOUBLE * count(*) - 2000.0::DOUBLE * coalesce(any_value(s.n), 0) AS perimeter FROM z LEFT JOIN s ON s.r = z.r GROUP BY 1")
def merge_zones(spark, d):
    return overlay.merge_zones(_zone_rings(spark, d), "region_id").select("region_id", "n_zones", "perimeter")


@query("height_fill", f"WITH {BUILDINGS}, k AS (SELECT bid, x, y, size FROM buildings WHERE bid % 4 > 0), r AS (SELECT a.bid, k.size, row_number() OVER (PARTITION BY a.bid ORDER BY (a.x - k.x) * (a.x - k.x) + (a.y - k.y) * (a.y - k.y), k.bid) AS n FROM buildings a JOIN k ON true WHERE a.bid % 4 = 0) SELECT bid, size AS height FROM k UNION ALL SELECT bid, size FROM r WHERE n = 1")
def height_fill(spark, d):
    """Buildings without a height take that of the nearest building that has one."""
    b = L.buildings(spark, d).select("bid", "x", "y", F.when(F.col("bid") % 4 > 0, F.col("size")).alias("height"))
    known = b.where("height IS NOT NULL").select(F.col("bid").alias("from"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("height").alias("near"))
    best = spatial_join.nearest_any(b.where("height IS NULL"), known, "bid", "from", 100.0)
    filled = best.select("bid", "from").join(known.select("from", "near"), "from").select("bid", "near")
    return b.join(filled, "bid", "left").select("bid", F.coalesce("height", "near").alias("height"))


@query("top_classes", f"WITH {POIS}, c AS (SELECT {ZONE} AS zone_id, poi_class, count(*) AS n FROM pois GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY n DESC, poi_class) AS rank, 100.0 * n / sum(n) OVER (PARTITION BY zone_id) AS percent FROM c) SELECT zone_id, poi_class, round(CAST(percent AS DOUBLE), 3) AS percent FROM r WHERE rank <= 3 AND percent >= 5")
def top_classes(spark, d):
    return clean.top_classes(L.pois(spark, d).select(L.zone_of().alias("zone_id"), "poi_class"), "zone_id", "poi_class", 3, 5.0).withColumn("percent", F.round("percent", 3))


@query("poi_class_rule", "SELECT CAST(event_id AS BIGINT) AS poi_id, CASE event_type WHEN 'view' THEN 'amenity' WHEN 'signup' THEN 'entertainment' WHEN 'click' THEN 'recreational' WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'shop' ELSE 'commercial' END ELSE 'commercial' END AS poi_class FROM events")
def poi_class_rule(spark, d):
    e = L.pois(spark, d)
    tag = lambda kind, v: F.when(F.col("event_type") == kind, v)
    shop = tag("purchase", F.when(F.col("poi_id") % 2 == 0, F.lit("bakery")).otherwise(F.lit("books")))
    tags = e.withColumns({"amenity": tag("view", F.lit("amenity")), "tourism": tag("signup", F.lit("museum")), "leisure": tag("click", F.lit("park")), "shop": shop})
    return tags.select("poi_id", clean.poi_class({"bakery"}).alias("poi_class"))


@query("delta_grid", "SELECT CAST(range AS BIGINT) AS cell_id, CAST(range // 9 AS BIGINT) AS row, CAST(range % 9 AS BIGINT) AS col, round((5000.0 / 9) * (5000.0 / 9), 3)::DOUBLE AS area FROM range(81)")
def delta_grid(spark, d):
    return grids.delta_grid(spark, (0.0, 0.0, 5000.0, 5000.0), 500.0).select("cell_id", "row", "col", F.round(G.area(F.col("ring")), 3).alias("area"))


@query("near_square_split", "SELECT CAST(range AS BIGINT) AS part, CAST(range // 4 AS BIGINT) AS row, CAST(range % 4 AS BIGINT) AS col FROM range(11)")
def near_square_split(spark, d):
    return grids.near_square_split(spark, 11)


@query("raster_blocks", "WITH r AS (SELECT range // 50 AS row, range % 50 AS col FROM range(2500)), v AS (SELECT row, col, CAST((row * 31 + col * 17 + 2020) % 997 AS DOUBLE) AS value FROM r) SELECT CAST(least(3, row // 12) * 4 + least(3, col // 12) AS BIGINT) AS block, count(*) AS cells, sum(value) AS total FROM v GROUP BY 1")
def raster_blocks(spark, d):
    return L.raster(spark, 2020).groupBy(grids.block_of(F.col("row"), F.col("col"), 50, 50).alias("block")).agg(F.count(F.lit(1)).alias("cells"), F.sum("value").alias("total"))


@query("tile_bounds", "WITH t AS (SELECT DISTINCT 12000 + event_id % 7 AS x, 8100 + event_id % 5 AS y FROM events) SELECT concat('14/', x, '/', y) AS tile_id, round(x / 16384.0 * 360 - 180, 6)::DOUBLE AS west, round(degrees(atan(sinh(pi() * (1 - 2 * y / 16384.0)))), 6) AS north FROM t")
def tile_bounds(spark, d):
    t = L.pois(spark, d).select(F.concat_ws("/", F.lit("14"), (F.col("poi_id") % 7 + 12000).cast("string"), (F.col("poi_id") % 5 + 8100).cast("string")).alias("tile_id")).distinct()
    b = t.withColumn("b", grids.tile_bounds(F.col("tile_id")))
    return b.select("tile_id", F.round("b.west", 6).alias("west"), F.round("b.north", 6).alias("north"))


@query("geojson_roundtrip", f"WITH {BUILDINGS} SELECT bid, round(CASE WHEN bid % 2 = 0 THEN area ELSE area * 0.75 END, 3) AS area FROM buildings")
def geojson_roundtrip(spark, d):
    path = shared_path(spark, "geojson")
    files.write_geojson(L.building_rings(spark, d).select("bid", "ring"), path)
    back = files.read_geojson(spark, path, lines=True)
    return back.select(F.col("properties")["bid"].cast("long").alias("bid"), F.round(G.area(F.col("parts")[0][0]), 3).alias("area"))


@query("csv_population", f"WITH {POPULATION} SELECT CAST(row AS DOUBLE) AS lat, CAST(col AS DOUBLE) AS lon, sum(value) AS value FROM population WHERE row BETWEEN 5 AND 20 AND col BETWEEN 10 AND 30 GROUP BY 1, 2")
def csv_population(spark, d):
    path = shared_path(spark, "csv")
    cells = L.population(spark, d).groupBy(F.col("row").alias("latitude"), F.col("col").alias("longitude")).agg(F.sum("value").alias("women"))
    cells.write.option("header", True).csv(path)
    return files.read_points_csv(spark, path, (10.0, 5.0, 30.0, 20.0))


@query("points_to_cells", f"WITH {POPULATION} SELECT DISTINCT cell, 10000.0::DOUBLE AS area FROM population")
def points_to_cells(spark, d):
    p = L.population(spark, d).select("cell", (F.col("col") * 100.0).alias("x"), (F.col("row") * 100.0).alias("y")).distinct()
    return files.points_to_cells(p).select("cell", F.round(G.area(F.col("ring")), 3).alias("area"))


@query("border_lines", "SELECT CAST(n_nationkey AS BIGINT) AS zone_id, CAST(9 AS BIGINT) AS n_lines FROM nation")
def border_lines(spark, d):
    return files.border_lines(_zone_rings(spark, d), "zone_id").groupBy("zone_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query("wkt_roundtrip", f"WITH {BUILDINGS} SELECT bid, round(CASE WHEN bid % 2 = 0 THEN area ELSE area * 0.75 END, 3) AS area FROM buildings")
def wkt_roundtrip(spark, d):
    text = L.building_rings(spark, d).select("bid", grids.wkt_polygon(F.col("ring")).alias("wkt"))
    return text.select("bid", F.round(G.area(grids.parse_wkt(F.col("wkt"))), 3).alias("area"))


@query("sql_functions", f"WITH {BUILDINGS} SELECT bid, round(CASE WHEN bid % 2 = 0 THEN area ELSE area * 0.75 END, 3) AS area, round(perimeter, 3) AS perimeter, true AS inside FROM buildings")
def sql_functions(spark, d):
    sql.register(spark)
    rings = L.building_rings(spark, d).select("bid", "ring", (F.col("x") + 1).alias("px"), (F.col("y") + 1).alias("py"))
    return rings.selectExpr("bid", "round(ug_area(ring), 3) AS area", "round(ug_length(ring), 3) AS perimeter", "ug_inside(px, py, ring) AS inside")


@query("feature_export", f"WITH {BUILDINGS} SELECT row_number() OVER (ORDER BY bid) - 1 AS ix, bid, round((area - avg(area) OVER ()) / stddev_pop(area) OVER (), 3) AS area, round((price - avg(price) OVER ()) / stddev_pop(price) OVER (), 3) AS price FROM buildings")
def feature_export(spark, d):
    f = export.features(L.buildings(spark, d).select("bid", "area", F.col("p_retailprice").alias("price")), "bid")
    part = lambda k: F.abs(F.round(F.col("features")[k].cast("double"), 3)) * F.signum(F.round(F.col("features")[k].cast("double"), 3))
    return f.select("ix", "bid", part(0).alias("area"), part(1).alias("price"))


@query("node_neighbours", f"WITH {STREETS} SELECT 'street_to_intersection' AS relation, street_id AS id FROM streets WHERE u = 7 UNION ALL SELECT 'street_to_intersection', u FROM streets WHERE street_id = 7 AND u <> 7 UNION ALL SELECT 'boundary_to_zone', 0 FROM nation WHERE n_nationkey = 7")
def node_neighbours(spark, d):
    s = L.streets(spark, d)
    g = hetero.UrbanGraph({}, {"street_to_intersection": s.select(F.col("street_id").alias("src"), F.col("u").alias("dst")), "boundary_to_zone": L.zones(spark, d).select(F.lit(0).cast("long").alias("src"), F.col("zone_id").alias("dst"))})
    return g.neighbours(7)


@query("largest_overlap", f"WITH {BUILDINGS} SELECT bid % 100 AS bid, max(area) AS area FROM buildings GROUP BY 1")
def largest_overlap(spark, d):
    b = L.buildings(spark, d).select((F.col("bid") % 100).alias("bid"), "area")
    return overlay.drop_overlapped(b, "bid", "area")


@query("street_length_by_zone", f"""WITH {LINES}, c AS (SELECT *, unnest(generate_series(CAST(floor(least(ux, vx) / 1000) AS BIGINT), CAST(floor(greatest(ux, vx) / 1000) AS BIGINT))) AS col FROM lines),
 k AS (SELECT *, unnest(generate_series(CAST(floor(least(uy, vy) / 1000) AS BIGINT), CAST(floor(greatest(uy, vy) / 1000) AS BIGINT))) AS row FROM c),
 t AS (SELECT *, CASE WHEN vx = ux THEN 0 ELSE least((col * 1000 - ux) / (vx - ux), (col * 1000 + 1000 - ux) / (vx - ux)) END AS x0, CASE WHEN vx = ux THEN 1 ELSE greatest((col * 1000 - ux) / (vx - ux), (col * 1000 + 1000 - ux) / (vx - ux)) END AS x1, CASE WHEN vy = uy THEN 0 ELSE least((row * 1000 - uy) / (vy - uy), (row * 1000 + 1000 - uy) / (vy - uy)) END AS y0, CASE WHEN vy = uy THEN 1 ELSE greatest((row * 1000 - uy) / (vy - uy), (row * 1000 + 1000 - uy) / (vy - uy)) END AS y1 FROM k),
 s AS (SELECT row * 5 + col AS zone_id, (least(1, x1, y1) - greatest(0, x0, y0)) * length AS part FROM t) SELECT zone_id, count(*) AS streets, round(sum(part), 3) AS length FROM s WHERE part > 1e-9 GROUP BY 1""")
def street_length_by_zone(spark, d):
    parts = segments.by_square(L.located_streets(spark, d), "street_id", 1000.0)
    return parts.groupBy((F.col("_cy") * 5 + F.col("_cx")).cast("long").alias("zone_id")).agg(F.count(F.lit(1)).alias("streets"), F.round(F.sum("length"), 3).alias("length"))
