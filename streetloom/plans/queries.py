"""Registered queries, each with the DuckDB SQL of the same result where SQL has one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import centrality, clean, graph, hetero, segments, spatial_join
from ..sources import layers as L
from ..storage import shared_path
from ..streaming import windows

QUERIES, ORACLES = {}, {}

# Layers in SQL, as in sources.layers.
NODES = "nodes AS (SELECT CAST(c_custkey AS BIGINT) AS id, CAST((c_custkey * 7919) % 4999 AS DOUBLE) AS x, CAST((c_custkey * 6007) % 4993 AS DOUBLE) AS y, c_acctbal AS value FROM customer)"
STREETS = "streets AS (SELECT CAST(o_orderkey AS BIGINT) AS street_id, CAST(o_custkey AS BIGINT) AS u, CAST((o_custkey + 1 + o_orderkey % 7) % (SELECT count(*) FROM customer) AS BIGINT) AS v FROM orders)"
LINES = NODES + ", " + STREETS + ", lines AS (SELECT s.*, a.x AS ux, a.y AS uy, b.x AS vx, b.y AS vy, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS length FROM streets s JOIN nodes a ON s.u = a.id JOIN nodes b ON s.v = b.id)"
LANES = "lanes AS (SELECT k AS street_id, k AS u, CASE WHEN k % 9 = 0 THEN k // 2 ELSE k + 1 END AS v, 10.0::DOUBLE + k % 13 AS length FROM (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders))"
BUILDINGS = "buildings AS (SELECT bid, x, y, size, brand, price, width, depth, width * depth AS area, 2 * (width + depth) AS perimeter FROM (SELECT CAST(p_partkey AS BIGINT) AS bid, CAST((p_partkey * 4649) % 4999 AS DOUBLE) AS x, CAST((p_partkey * 3571) % 4993 AS DOUBLE) AS y, CAST(p_size AS BIGINT) AS size, p_brand AS brand, p_retailprice AS price, CAST(p_size + 5 AS DOUBLE) AS width, CAST(p_partkey % 23 + 5 AS DOUBLE) AS depth FROM part))"
CLASS_LIST = "[" + ", ".join(f"'{c}'" for c in L.POI_CLASSES) + "]"
POIS = f"pois AS (SELECT CAST(event_id AS BIGINT) AS poi_id, event_type, value, ts, user_id, CAST((event_id * 7919) % 4999 AS DOUBLE) AS x, CAST((event_id * 6007) % 4993 AS DOUBLE) AS y, {CLASS_LIST}[CAST((event_id * 5 + floor(value)) AS BIGINT) % 8 + 1] AS poi_class FROM events)"
POPULATION = "population AS (SELECT cell, cell // 50 AS row, cell % 50 AS col, value FROM (SELECT CAST((l_orderkey * 4 + l_linenumber) % 2500 AS BIGINT) AS cell, CAST(l_quantity AS DOUBLE) AS value FROM lineitem))"
ZONE = "CAST(floor(y / 1000) * 5 + floor(x / 1000) AS BIGINT)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _pivot_sql(of: str, group: str, column: str = "poi_class") -> str:
    return ", ".join(f"CAST(count(*) FILTER ({column} = '{c}') AS BIGINT) AS {c}" for c in L.POI_CLASSES)


@query("zone_stats", f"""WITH {NODES}, {BUILDINGS}, {POIS}, {POPULATION},
 n AS (SELECT {ZONE} AS zone_id, CAST(count(*) AS BIGINT) AS num_nodes FROM nodes GROUP BY 1),
 b AS (SELECT {ZONE} AS zone_id, CAST(count(*) AS BIGINT) AS num_buildings, sum(area) AS total, avg(area) AS mean, stddev_samp(area) AS std FROM buildings GROUP BY 1),
 p AS (SELECT {ZONE} AS zone_id, {_pivot_sql('pois', 'zone_id')} FROM pois GROUP BY 1),
 q AS (SELECT (row // 10) * 5 + col // 10 AS zone_id, sum(value) AS pop FROM population GROUP BY 1)
 SELECT CAST(n_nationkey AS BIGINT) AS zone_id, coalesce(num_nodes, 0) AS num_nodes, coalesce(num_buildings, 0) AS num_buildings, round(coalesce(total, 0), 3) AS building_area, round(coalesce(mean, 0), 3) AS mean_building_area, round(coalesce(std, 0), 3) AS std_building_area, round(coalesce(total, 0) / 10000, 3) AS footprint_percent, {", ".join(f"coalesce({c}, 0) AS {c}" for c in L.POI_CLASSES)}, CAST(coalesce(pop, 0) AS BIGINT) AS population
 FROM nation LEFT JOIN n ON n.zone_id = n_nationkey LEFT JOIN b ON b.zone_id = n_nationkey LEFT JOIN p ON p.zone_id = n_nationkey LEFT JOIN q ON q.zone_id = n_nationkey""")
def zone_stats(spark, d):
    n = L.intersections(spark, d).groupBy(L.zone_of().alias("zone_id")).agg(F.count(F.lit(1)).alias("num_nodes"))
    b = L.buildings(spark, d).groupBy(L.zone_of().alias("zone_id")).agg(F.count(F.lit(1)).alias("num_buildings"), F.sum("area").alias("t"), F.avg("area").alias("m"), F.stddev_samp("area").alias("s"))
    p = clean.class_counts(L.pois(spark, d).withColumn("zone_id", L.zone_of()), "zone_id", "poi_class", L.POI_CLASSES)
    q = L.population(spark, d).groupBy((F.floor(F.col("row") / 10) * 5 + F.floor(F.col("col") / 10)).cast("long").alias("zone_id")).agg(F.sum("value").alias("pop"))
    out = L.zones(spark, d)
    for part in (n, b, p, q):
        out = out.join(part, "zone_id", "left")
    whole = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    r = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)), 3).alias(name)
    return out.select("zone_id", whole("num_nodes"), whole("num_buildings"), r("t", "building_area"), r("m", "mean_building_area"), r("s", "std_building_area"), F.round(F.coalesce("t", F.lit(0.0)) / 10000, 3).alias("footprint_percent"), *[whole(c) for c in L.POI_CLASSES], F.coalesce("pop", F.lit(0.0)).cast("long").alias("population"))


@query("point_context", f"""WITH {NODES}, {POIS} SELECT n.id AS intersection_id, {_pivot_sql('p', 'id')} FROM nodes n LEFT JOIN pois p ON abs(n.x - p.x) <= 100 AND (n.x - p.x) * (n.x - p.x) + (n.y - p.y) * (n.y - p.y) <= 10000 GROUP BY 1""")
def point_context(spark, d):
    nodes = L.intersections(spark, d).select("intersection_id", "x", "y")
    got = spatial_join.disc_sums(nodes, L.pois(spark, d), "intersection_id", 100.0, clean.class_marks("poi_class", L.POI_CLASSES))
    return nodes.select("intersection_id").join(got.drop("_n"), "intersection_id", "left").na.fill(0.0).withColumns({c: F.col(c).cast("long") for c in L.POI_CLASSES})


@query("building_context", f"""WITH {NODES}, {BUILDINGS} SELECT n.id AS intersection_id, CAST(count(b.bid) AS BIGINT) AS building_count, round(coalesce(sum(b.area), 0), 3) AS footprint_sum, round(coalesce(avg(b.area), 0), 3) AS footprint_mean, round(coalesce(stddev_samp(b.area), 0), 3) AS footprint_std, round(coalesce(sum(b.perimeter), 0), 3) AS perimeter_total, round(coalesce(sum(b.area), 0) / (pi() * 10000), 3) AS footprint_proportion FROM nodes n LEFT JOIN buildings b ON abs(n.x - b.x) <= 100 AND (n.x - b.x) * (n.x - b.x) + (n.y - b.y) * (n.y - b.y) <= 10000 GROUP BY 1""")
def building_context(spark, d):
    nodes = L.intersections(spark, d).select("intersection_id", "x", "y")
    near = spatial_join.within_distance(nodes, L.buildings(spark, d).select("bid", "area", "perimeter", F.col("x").alias("rx"), F.col("y").alias("ry")), 100.0)
    got = near.groupBy("intersection_id").agg(F.count("bid").alias("building_count"), F.sum("area").alias("s"), F.avg("area").alias("m"), F.stddev_samp("area").alias("d"), F.sum("perimeter").alias("p"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return nodes.join(got, "intersection_id", "left").select("intersection_id", F.coalesce("building_count", F.lit(0)).alias("building_count"), F.round(z("s"), 3).alias("footprint_sum"), F.round(z("m"), 3).alias("footprint_mean"), F.round(z("d"), 3).alias("footprint_std"), F.round(z("p"), 3).alias("perimeter_total"), F.round(z("s") / (F.pi() * 10000), 3).alias("footprint_proportion"))


@query("dist_neighbours", f"WITH {BUILDINGS} SELECT a.bid, b.bid AS neighbour, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance FROM buildings a JOIN buildings b ON abs(a.x - b.x) <= 150 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 22500 AND a.bid <> b.bid")
def dist_neighbours(spark, d):
    b = L.buildings(spark, d).select("bid", "x", "y")
    other = b.select(F.col("bid").alias("neighbour"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    return spatial_join.within_distance(b, other, 150.0).where("bid <> neighbour").select("bid", "neighbour", F.round("distance", 6).alias("distance"))


@query("nearest_intersection_50m", f"WITH {BUILDINGS}, {NODES}, p AS (SELECT b.bid, n.id AS intersection_id, (n.x - b.x) * (n.x - b.x) + (n.y - b.y) * (n.y - b.y) AS d2 FROM buildings b JOIN nodes n ON abs(n.x - b.x) <= 50 AND (n.x - b.x) * (n.x - b.x) + (n.y - b.y) * (n.y - b.y) <= 2500) SELECT bid, intersection_id, round(sqrt(d2), 6) AS distance FROM (SELECT *, rank() OVER (PARTITION BY bid ORDER BY d2) AS r FROM p) WHERE r = 1")
def nearest_intersection(spark, d):
    n = L.intersections(spark, d).select("intersection_id", F.col("x").alias("rx"), F.col("y").alias("ry"))
    return spatial_join.nearest_in_tiles(L.buildings(spark, d).select("bid", "x", "y"), n, "bid", "intersection_id", 50.0).select("bid", "intersection_id", F.round("distance", 6).alias("distance"))


KNN = f"WITH {BUILDINGS}, k AS (SELECT a.bid, b.bid AS neighbour, b.area, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance, row_number() OVER (PARTITION BY a.bid ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.bid) AS rank FROM buildings a, buildings b)"


@query("knn_neighbours", KNN + " SELECT bid, neighbour, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5")
def knn_neighbours(spark, d):
    return spatial_join.knn(L.buildings(spark, d).select("bid", "x", "y"), "bid", 5, 200.0).withColumn("distance", F.round("distance", 6))


@query("knn_aggregate", KNN + " SELECT bid, round(avg(area), 3) AS knn_area_mean, round(stddev_samp(area), 3) AS knn_area_std FROM k WHERE rank <= 5 GROUP BY bid")
def knn_aggregate(spark, d):
    b = L.buildings(spark, d)
    near = spatial_join.knn(b.select("bid", "x", "y"), "bid", 5, 200.0).join(b.select(F.col("bid").alias("neighbour"), "area").hint("merge"), "neighbour")
    return near.groupBy("bid").agg(F.round(F.avg("area"), 3).alias("knn_area_mean"), F.round(F.stddev_samp("area"), 3).alias("knn_area_std"))


@query("poi_pivot", f"WITH {POIS} SELECT {ZONE} AS zone_id, {_pivot_sql('pois', 'zone_id')} FROM pois GROUP BY 1")
def poi_pivot(spark, d):
    return clean.class_counts(L.pois(spark, d).withColumn("zone_id", L.zone_of()), "zone_id", "poi_class", L.POI_CLASSES)


@query("poi_relabel_trim", f"WITH {POIS}, r AS (SELECT poi_id, user_id, concat(CASE poi_class WHEN 'food' THEN 'commercial' ELSE poi_class END, '/', CAST(user_id % 997 AS VARCHAR)) AS poi_class FROM pois) SELECT poi_id, poi_class FROM r WHERE poi_class IN (SELECT poi_class FROM r GROUP BY 1 HAVING count(*) > 5)")
def poi_relabel_trim(spark, d):
    p = L.pois(spark, d).select("poi_id", "poi_class", "user_id")
    renamed = clean.relabel_and_trim(p, "poi_class", {"food": "commercial"}, 0).withColumn("poi_class", F.concat_ws("/", "poi_class", (F.col("user_id") % 997).cast("string")))
    return clean.relabel_and_trim(renamed, "poi_class", {}, 5).select("poi_id", "poi_class")


@query("id_suffix", "SELECT CASE WHEN count(*) OVER (PARTITION BY l_partkey) > 1 THEN concat(CAST(l_partkey AS VARCHAR), '_', CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 8 + l_linenumber) - 1 AS VARCHAR)) ELSE CAST(l_partkey AS VARCHAR) END AS bid, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS place FROM (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber FROM lineitem)")
def id_suffix(spark, d):
    x = L.table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber").distinct()
    return clean.id_suffix(x.select(F.col("l_partkey").alias("bid"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("place")), "bid", "place")


@query("line_dedup", f"WITH {STREETS} SELECT street_id, u, v FROM (SELECT *, row_number() OVER (PARTITION BY least(u, v), greatest(u, v) ORDER BY street_id) AS k FROM streets) WHERE k = 1")
def line_dedup(spark, d):
    return clean.line_dedup(L.streets(spark, d), "street_id", ("u", "v")).select("street_id", "u", "v")


@query("street_length", f"WITH {LINES} SELECT street_id, round(length, 3) AS length FROM lines")
def street_length(spark, d):
    return L.located_streets(spark, d).select("street_id", F.round("length", 3).alias("length"))


LONLAT = "103.8 + {0}x / 111320 AS lon{1}, 1.3 + {0}y / 110574 AS lat{1}"


def _lonlat(x, y):
    return F.lit(L.LON0) + F.col(x) / 111320, F.lit(L.LAT0) + F.col(y) / 110574


@query("haversine_length", f"WITH {LINES}, g AS (SELECT street_id, {LONLAT.format('u', 1)}, {LONLAT.format('v', 2)} FROM lines) SELECT street_id, round(2 * 6371009.0 * asin(sqrt(least(1.0, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))), 3) AS length FROM g")
def haversine_length(spark, d):
    return L.located_streets(spark, d).select("street_id", F.round(G.haversine(*_lonlat("ux", "uy"), *_lonlat("vx", "vy")), 3).alias("length"))


@query("bearing", f"WITH {LINES}, g AS (SELECT street_id, {LONLAT.format('u', 1)}, {LONLAT.format('v', 2)} FROM lines), a AS (SELECT street_id, degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) AS t FROM g) SELECT street_id, round(CASE WHEN t < 0 THEN t + 360 ELSE t END, 1) AS bearing FROM a")
def bearing(spark, d):
    return L.located_streets(spark, d).select("street_id", F.round(G.bearing(*_lonlat("ux", "uy"), *_lonlat("vx", "vy")), 1).alias("bearing"))


TILE = "concat('14/', CAST(CAST(floor((lon + 180) / 360 * 16384.0) AS BIGINT) AS VARCHAR), '/', CAST(CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384.0) AS BIGINT) AS VARCHAR))"
TILED = f"{POIS}, tiled AS (SELECT poi_id, value, {TILE} AS tile_id, {ZONE} AS zone_id FROM (SELECT *, {LONLAT.format('', '')} FROM pois))"


def _tiled(spark, d):
    p = L.pois(spark, d)
    return p.withColumns({"tile_id": G.tile_id(*_lonlat("x", "y"), 14), "zone_id": L.zone_of()})


@query("tile_assign", f"WITH {TILED} SELECT poi_id, tile_id FROM tiled")
def tile_assign(spark, d):
    return _tiled(spark, d).select("poi_id", "tile_id")


HOLES = f"{TILED}, holes AS (SELECT poi_id, tile_id, zone_id, CASE WHEN poi_id % 3 = 0 THEN NULL ELSE value END AS v FROM tiled)"


def _holes(spark, d):
    return _tiled(spark, d).select("poi_id", "tile_id", "zone_id", F.when(F.col("poi_id") % 3 != 0, F.col("value")).alias("v"))


@query("mean_impute", f"WITH {HOLES} SELECT poi_id, round(coalesce(v, (SELECT avg(v) FROM holes)), 3) AS v FROM holes")
def mean_impute(spark, d):
    return clean.fill_mean(_holes(spark, d), ["v"]).select("poi_id", F.round("v", 3).alias("v"))


@query("tile_impute", f"WITH {HOLES} SELECT poi_id, round(coalesce(v, avg(v) OVER (PARTITION BY tile_id), 0), 3) AS v FROM holes")
def tile_impute(spark, d):
    return clean.fill_by_group(_holes(spark, d), "v", ["tile_id"], F.lit(0.0)).select("poi_id", F.round("v", 3).alias("v"))


@query("hier_impute", f"WITH {HOLES}, s AS (SELECT poi_id, tile_id, zone_id, CASE WHEN poi_id % 50 < 40 THEN NULL ELSE v END AS v, poi_id // 3 AS street FROM holes) SELECT poi_id, round(coalesce(v, avg(v) OVER (PARTITION BY street), avg(v) OVER (PARTITION BY tile_id), (SELECT avg(v) FROM s)), 6) AS v FROM s")
def hier_impute(spark, d):
    s = _holes(spark, d).withColumns({"v": F.when(F.col("poi_id") % 50 >= 40, F.col("v")), "street": F.floor(F.col("poi_id") / 3), })
    return clean.fill_mean(clean.fill_by_group(s, "v", ["street", "tile_id"]), ["v"], s).select("poi_id", F.round("v", 6).alias("v"))


@query("standardise", f"WITH {BUILDINGS} SELECT bid, round((area - avg(area) OVER ()) / stddev_pop(area) OVER (), 6) AS area, round((price - avg(price) OVER ()) / stddev_pop(price) OVER (), 6) AS price FROM buildings")
def standardise(spark, d):
    return clean.standardise(L.buildings(spark, d).select("bid", "area", F.col("p_retailprice").alias("price")), ["area", "price"]).select("bid", F.round("area", 6).alias("area"), F.round("price", 6).alias("price"))


@query("one_hot", f"WITH {POIS} SELECT poi_id, " + ", ".join(f"CAST(poi_class = '{c}' AS BIGINT) AS poi_class_{c}" for c in L.POI_CLASSES) + " FROM pois")
def one_hot(spark, d):
    return clean.one_hot(L.pois(spark, d).select("poi_id", "poi_class"), "poi_class", list(L.POI_CLASSES))


@query("split_masks", "WITH r AS (SELECT CAST(c_custkey AS BIGINT) AS id, row_number() OVER (ORDER BY md5(concat(CAST(c_custkey AS VARCHAR), ':7')), c_custkey) AS k, (SELECT count(*) FROM customer) AS n FROM customer) SELECT id, k <= CAST(floor(n * 0.6) AS BIGINT) AS train, k > CAST(floor(n * 0.6) AS BIGINT) AND k <= CAST(floor(n * 0.6) AS BIGINT) + CAST(floor(n * 0.2) AS BIGINT) AS val, k > CAST(floor(n * 0.6) AS BIGINT) + CAST(floor(n * 0.2) AS BIGINT) AS test FROM r")
def split_masks(spark, d):
    return clean.split_masks(L.intersections(spark, d).select(F.col("intersection_id").alias("id")), "id", 0.6, 0.2, 7)


@query("out_degree", f"WITH {NODES}, {STREETS} SELECT n.id AS intersection_id, CAST(count(s.street_id) AS BIGINT) AS degree FROM nodes n LEFT JOIN streets s ON s.u = n.id GROUP BY 1")
def out_degree(spark, d):
    return graph.out_degree(L.intersections(spark, d), L.streets(spark, d), "intersection_id")


@query("clustering", f"WITH {NODES}, {STREETS}, one AS (SELECT DISTINCT u, v FROM streets WHERE u <> v), b AS (SELECT u, v, count(*) AS w FROM (SELECT u, v FROM one UNION ALL SELECT v, u FROM one) GROUP BY 1, 2), t AS (SELECT x.u AS i, sum(x.w * y.w * z.w) AS t FROM b x JOIN b y ON x.v = y.u AND y.v <> x.u JOIN b z ON z.u = x.u AND z.v = y.v GROUP BY 1), g AS (SELECT u AS i, sum(w) AS d, sum(CASE WHEN w = 2 THEN 1 ELSE 0 END) AS r FROM b GROUP BY 1) SELECT n.id AS intersection_id, round(coalesce(CASE WHEN d * (d - 1) - 2 * r > 0 THEN CAST(coalesce(t, 0) AS DOUBLE) / CAST(2 * (d * (d - 1) - 2 * r) AS DOUBLE) ELSE 0 END, 0), 6) AS clustering FROM nodes n LEFT JOIN g ON g.i = n.id LEFT JOIN t ON t.i = n.id")
def clustering(spark, d):
    return graph.clustering(L.streets(spark, d), L.intersections(spark, d), "intersection_id").withColumn("clustering", F.round("clustering", 6))


@query("wcc", f"WITH RECURSIVE {STREETS}, e AS (SELECT u AS a, v AS b FROM streets UNION SELECT v, u FROM streets), r(n, m) AS (SELECT a, a FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.n WHERE r.m < e.b) SELECT n AS node, min(m) AS component FROM r GROUP BY 1")
def wcc(spark, d):
    return graph.components(L.streets(spark, d))


@query("wcc_lanes", f"WITH RECURSIVE {LANES}, e AS (SELECT u AS a, v AS b FROM lanes WHERE street_id % 3 > 0 AND u <> v UNION SELECT v, u FROM lanes WHERE street_id % 3 > 0 AND u <> v), r(n, m) AS (SELECT a, a FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.n WHERE r.m < e.b) SELECT n AS node, min(m) AS component FROM r GROUP BY 1")
def wcc_lanes(spark, d):
    """Many components: chains between the gaps that every third lane leaves."""
    return graph.components(L.lanes(spark, d).where("street_id % 3 > 0"))


@query("wcc_largest", ORACLES["wcc"].replace("SELECT n AS node, min(m) AS component FROM r GROUP BY 1", ", c AS (SELECT n AS node, min(m) AS component FROM r GROUP BY 1) SELECT node, component FROM c WHERE component = (SELECT component FROM c GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)").replace("r.m < e.b) ,", "r.m < e.b),"))
def wcc_largest(spark, d):
    c = graph.components(L.streets(spark, d))
    best = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    return c.join(F.broadcast(best), "component", "left_semi")


@query("dual_graph", f"WITH {STREETS}, s AS (SELECT * FROM streets) SELECT DISTINCT least(a.street_id, b.street_id) AS src, greatest(a.street_id, b.street_id) AS dst FROM s a JOIN s b ON a.v = b.u AND a.street_id <> b.street_id")
def dual_graph(spark, d):
    return graph.dual(L.streets(spark, d))


def _rounds(n: int, step: str) -> str:
    return ", ".join(f"r{k} AS MATERIALIZED ({step.format(p=f'r{k - 1}')})" for k in range(1, n + 1))


LINKS = f"{NODES}, {STREETS}, links AS MATERIALIZED (SELECT u, v, CAST(count(*) AS DOUBLE) AS w FROM streets GROUP BY 1, 2)"


@query("pagerank", f"WITH {LINKS}, o AS (SELECT u, count(*) AS k FROM streets GROUP BY 1), r0 AS (SELECT id, 1.0 / (SELECT count(*) FROM nodes) AS p FROM nodes), " + _rounds(80, "SELECT n.id, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * coalesce(g.s, 0) AS p FROM nodes n LEFT JOIN (SELECT v, sum(w * CAST(p AS DOUBLE) / k) AS s FROM links JOIN o USING (u) JOIN {p} ON {p}.id = links.u GROUP BY v) g ON g.v = n.id") + " SELECT id AS intersection_id, round(p, 7) AS pagerank FROM r80")
def pagerank(spark, d):
    return graph.pagerank(L.intersections(spark, d), L.streets(spark, d), "intersection_id").withColumn("pagerank", F.round("pagerank", 7))


@query("katz", f"WITH {LINKS}, r0 AS (SELECT id, CAST(1.0 AS DOUBLE) AS p FROM nodes), " + _rounds(24, "SELECT n.id, 1.0 + 0.01 * coalesce(g.s, 0) AS p FROM nodes n LEFT JOIN (SELECT v, sum(w * p) AS s FROM links JOIN {p} ON {p}.id = links.u GROUP BY v) g ON g.v = n.id") + " SELECT id AS intersection_id, round(p, 7) AS katz FROM r24")
def katz(spark, d):
    return graph.katz(L.intersections(spark, d), L.streets(spark, d), "intersection_id").withColumn("katz", F.round("katz", 7))


@query("assortativity", f"WITH {LINES}, a AS (SELECT CAST(floor(l.uy / 1000) * 5 + floor(l.ux / 1000) AS BIGINT) AS zone_id, p.value AS pu, q.value AS pv FROM lines l JOIN nodes p ON p.id = l.u JOIN nodes q ON q.id = l.v) SELECT zone_id, CAST(count(*) AS BIGINT) AS edges, CASE WHEN count(*) >= 30 THEN round(corr(pu, pv), 6) END AS assortativity FROM a GROUP BY 1")
def assortativity(spark, d):
    n = L.intersections(spark, d)
    e = L.located_streets(spark, d).join(n.select(F.col("intersection_id").alias("u"), F.col("value").alias("pu")), "u").join(n.select(F.col("intersection_id").alias("v"), F.col("value").alias("pv")), "v")
    return e.groupBy(L.zone_of("ux", "uy").alias("zone_id")).agg(F.count(F.lit(1)).alias("edges"), F.when(F.count(F.lit(1)) >= 30, F.round(F.corr("pu", "pv"), 6)).alias("assortativity"))


YEARS = (1990, 2000, 2010, 2020)


@query("temporal_network", f"WITH {NODES}, {STREETS}, y AS (SELECT unnest([1990, 2000, 2010, 2020]) AS year), k AS (SELECT id, year FROM nodes, y WHERE (id * 13 + year) % 600 >= 300) SELECT CAST(a.year AS INTEGER) AS year, a.id AS intersection_id, CAST(count(b.id) AS BIGINT) AS degree FROM k a LEFT JOIN streets s ON s.u = a.id LEFT JOIN k b ON b.id = s.v AND b.year = a.year GROUP BY 1, 2")
def temporal_network(spark, d):
    kept = L.intersections(spark, d).select("intersection_id").withColumn("year", F.explode(F.lit(list(YEARS)))).where((F.col("intersection_id") * 13 + F.col("year")) % 600 >= 300)
    e = L.streets(spark, d).select("u", "v")
    there = kept.select(F.col("intersection_id").alias("v"), "year")
    degree = e.join(there, "v").groupBy(F.col("u").alias("intersection_id"), "year").agg(F.count(F.lit(1)).alias("degree"))
    return kept.join(degree, ["intersection_id", "year"], "left").na.fill(0, ["degree"]).select("year", "intersection_id", "degree")


@query("zonal_moments", "WITH r AS (SELECT (row // 10) * 5 + col // 10 AS zone_id, CAST((row * 31 + col * 17 + 2020) % 997 AS DOUBLE) AS v FROM (SELECT CAST(range // 50 AS BIGINT) AS row, CAST(range % 50 AS BIGINT) AS col FROM range(2500))), m AS (SELECT zone_id, avg(v) AS mu FROM r GROUP BY 1) SELECT r.zone_id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS stdev, round(avg(pow(v - mu, 3)) / pow(avg(pow(v - mu, 2)), 1.5), 6) AS skewness, round(avg(pow(v - mu, 4)) / pow(avg(pow(v - mu, 2)), 2) - 3, 6) AS kurtosis FROM r JOIN m ON r.zone_id = m.zone_id GROUP BY 1")
def zonal_moments(spark, d):
    z = (F.floor(F.col("row") / 10) * 5 + F.floor(F.col("col") / 10)).cast("long")
    return L.raster(spark, 2020).groupBy(z.alias("zone_id")).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("stdev"), F.round(F.skewness("value"), 6).alias("skewness"), F.round(F.kurtosis("value"), 6).alias("kurtosis"))


@query("class_proportion", "WITH r AS (SELECT (row // 10) * 5 + col // 10 AS zone_id, ((row * 31 + col * 17 + 2020) % 997) % 6 AS c FROM (SELECT CAST(range // 50 AS BIGINT) AS row, CAST(range % 50 AS BIGINT) AS col FROM range(2500))) SELECT zone_id, " + ", ".join(f"round(100.0 * count(*) FILTER (c = {k}) / count(*), 3) AS lcz_{k}" for k in range(6)) + " FROM r GROUP BY 1")
def class_proportion(spark, d):
    z = (F.floor(F.col("row") / 10) * 5 + F.floor(F.col("col") / 10)).cast("long").alias("zone_id")
    c = (F.col("value") % 6).cast("int")
    return L.raster(spark, 2020).groupBy(z).agg(*[F.round(100.0 * F.count(F.when(c == k, 1)) / F.count(F.lit(1)), 3).alias(f"lcz_{k}") for k in range(6)])


@query("mosaic", "SELECT row, col, min_by(value, source) AS value FROM (SELECT 0 AS source, CAST(range // 50 AS BIGINT) AS row, CAST(range % 50 AS BIGINT) AS col, CAST((range // 50 * 31 + range % 50 * 17 + 2000) % 997 AS DOUBLE) AS value FROM range(2500) UNION ALL SELECT 1, CAST(range // 80 AS BIGINT), CAST(range % 80 AS BIGINT), CAST((range // 80 * 31 + range % 80 * 17 + 2010) % 997 AS DOUBLE) FROM range(4800)) GROUP BY 1, 2")
def mosaic(spark, d):
    both = L.raster(spark, 2000).withColumn("source", F.lit(0)).unionByName(L.raster(spark, 2010, 60, 80).withColumn("source", F.lit(1)))
    return both.groupBy("row", "col").agg(F.min_by("value", "source").alias("value"))


@query("shape_simple", f"WITH {BUILDINGS}, s AS (SELECT bid, CASE WHEN bid % 2 = 0 THEN area ELSE area * 0.75 END AS area, perimeter FROM buildings) SELECT bid, round(area, 3) AS area, round(perimeter, 3) AS perimeter, round(perimeter / sqrt(sqrt(area)), 6) AS complexity, round(2 * ln(perimeter / 4) / ln(area), 6) AS fractal_dimension, round(pow(4 * sqrt(area) / perimeter, 2), 6) AS square_compactness, CAST(CASE WHEN bid % 2 = 0 THEN 4 ELSE 6 END AS BIGINT) AS corners FROM s")
def shape_simple(spark, d):
    b = L.building_rings(spark, d).select("bid", G.area(F.col("ring")).alias("a"), G.length(F.col("ring")).alias("p"), G.corners(F.col("ring")).alias("corners"))
    a, p = F.col("a"), F.col("p")
    return b.select("bid", F.round(a, 3).alias("area"), F.round(p, 3).alias("perimeter"), F.round(G.complexity(a, p), 6).alias("complexity"), F.round(G.fractal_dimension(a, p), 6).alias("fractal_dimension"), F.round(G.square_compactness(a, p), 6).alias("square_compactness"), "corners")


SHAPES = f"WITH {BUILDINGS}, s AS (SELECT bid, width AS w, depth AS d, CASE WHEN bid % 2 = 0 THEN area ELSE area * 0.75 END AS a, CASE WHEN bid % 2 = 0 THEN 1.0::DOUBLE ELSE 0.75::DOUBLE / 0.875 END AS convexity, sqrt(width * width + depth * depth) AS diag FROM buildings)"


@query("mbr_metrics", SHAPES + " SELECT bid, round(convexity, 6) AS convexity, round(a / (w * d), 6) AS rectangularity, round(least(w, d) / greatest(w, d), 6) AS elongation FROM s")
def mbr_metrics(spark, d):
    return G.morphology(L.building_rings(spark, d).select("bid", "ring")).select("bid", *[F.round(c, 6).alias(c) for c in ("convexity", "rectangularity", "elongation")])


@query("morphology", SHAPES + " SELECT bid, round(convexity, 5) AS convexity, round(a / (w * d), 5) AS rectangularity, round(sqrt(a / (w * d)), 5) AS eri, round(least(w, d) / greatest(w, d), 5) AS elongation, 0.0::DOUBLE AS orientation, round(diag, 5) AS longest_axis, round(a / (pi() * diag * diag / 4), 5) AS circular_compactness, round(sqrt(a / pi()) / (diag / 2), 5) AS shape_index FROM s")
def morphology(spark, d):
    out = G.morphology(L.building_rings(spark, d).select("bid", "ring")).drop("ring")
    return out.select("bid", *[F.round(c, 5).alias(c) for c in out.columns if c != "bid"])


@query("squareness", f"WITH {BUILDINGS} SELECT bid, round(0.0, 6) AS squareness FROM buildings")
def squareness(spark, d):
    return L.building_rings(spark, d).select("bid", F.abs(F.round(G.squareness(F.col("ring")), 6)).alias("squareness"))


SHARES = ("green", "sky", "building", "road")


@query("entropy_complexity", "WITH s AS (SELECT CAST(event_id AS BIGINT) AS image_id, CAST(event_id % 101 + 1 AS DOUBLE) AS a, CAST(event_id % 37 + 1 AS DOUBLE) AS b, CAST(event_id % 53 + 1 AS DOUBLE) AS c, CAST(event_id % 11 + 1 AS DOUBLE) AS d FROM events), t AS (SELECT *, a + b + c + d AS n FROM s) SELECT image_id, round(-(a / n * ln(a / n) + b / n * ln(b / n) + c / n * ln(c / n) + d / n * ln(d / n)) / ln(2), 6) AS visual_complexity FROM t")
def entropy_complexity(spark, d):
    e = L.table(spark, d, "events").select(F.col("event_id").cast("long").alias("image_id"))
    parts = F.array(*[(F.col("image_id") % m + 1).cast("double") for m in (101, 37, 53, 11)])
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return e.select("image_id", F.round(-F.aggregate(F.transform(parts, lambda x: x / total * F.log(x / total)), F.lit(0.0), lambda s, x: s + x) / F.log(F.lit(2.0)), 6).alias("visual_complexity"))


@query("time_of_day", "SELECT CAST(event_id AS BIGINT) AS image_id FROM events WHERE hour(ts) * 60 + minute(ts) BETWEEN 600 AND 960")
def time_of_day(spark, d):
    p = L.pois(spark, d)
    minute = F.hour("ts") * 60 + F.minute("ts")
    return p.where(minute.between(600, 960)).select(F.col("poi_id").alias("image_id"))


@query("completeness", f"WITH {BUILDINGS} SELECT {ZONE} AS zone_id, CAST(count(*) AS BIGINT) AS buildings, CAST(count(CASE WHEN bid % 4 > 0 THEN size END) AS BIGINT) AS with_height, round(100.0 * count(CASE WHEN bid % 4 > 0 THEN size END) / count(*), 2) AS percent FROM buildings GROUP BY 1")
def completeness(spark, d):
    height = F.when(F.col("bid") % 4 > 0, F.col("size"))
    return L.buildings(spark, d).groupBy(L.zone_of().alias("zone_id")).agg(F.count(F.lit(1)).alias("buildings"), F.count(height).alias("with_height"), F.round(100.0 * F.count(height) / F.count(F.lit(1)), 2).alias("percent"))


@query("population_check", f"WITH {POPULATION}, c AS (SELECT cell, sum(value) AS a, sum(value * (1 + (cell % 7 - 3) / 10.0)) AS b FROM population GROUP BY 1) SELECT round(avg(CASE WHEN a > 0 AND b > 0 THEN 100.0 ELSE 0.0 END), 3) AS hit_percent, round(corr(a, b), 6) AS correlation, round(avg(abs(a - b)), 3) AS mae, round(sum(a), 3) AS total_a, round(sum(b), 3) AS total_b FROM c")
def population_check(spark, d):
    c = L.population(spark, d).groupBy("cell").agg(F.sum("value").alias("a"), F.sum(F.col("value") * (1 + (F.col("cell") % 7 - 3) / 10.0)).alias("b"))
    return c.agg(F.round(F.avg(F.when((F.col("a") > 0) & (F.col("b") > 0), 100.0).otherwise(0.0)), 3).alias("hit_percent"), F.round(F.corr("a", "b"), 6).alias("correlation"), F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 3).alias("mae"), F.round(F.sum("a"), 3).alias("total_a"), F.round(F.sum("b"), 3).alias("total_b"))


@query("modal_class", f"WITH {POIS}, c AS (SELECT {ZONE} AS zone_id, poi_class, count(*) AS n FROM pois GROUP BY 1, 2) SELECT zone_id, poi_class FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY n DESC, poi_class) AS k FROM c) WHERE k = 1")
def modal_class(spark, d):
    return clean.ranked_mode(L.pois(spark, d).withColumn("zone_id", L.zone_of()), ["zone_id"], "poi_class")


@query("bbox_timeseries", f"WITH {POIS} SELECT poi_id, row_number() OVER (ORDER BY poi_id) - 1 AS oid FROM pois WHERE x > 1000 AND x < 3000 AND y > 500 AND y < 2500")
def bbox_timeseries(spark, d):
    p = L.pois(spark, d).where("x > 1000 AND x < 3000 AND y > 500 AND y < 2500")
    return clean.numbered(p.select("poi_id"), "poi_id", "oid")


@query("incidence_relation", f"WITH {STREETS} SELECT u AS src, street_id AS dst FROM streets UNION ALL SELECT v, street_id FROM streets")
def incidence_relation(spark, d):
    s = L.streets(spark, d)
    return s.select(F.explode(F.array("u", "v")).alias("src"), F.col("street_id").alias("dst"))


@query("boundary_relation", "SELECT CAST(0 AS BIGINT) AS src, CAST(n_nationkey AS BIGINT) AS dst FROM nation")
def boundary_relation(spark, d):
    return L.zones(spark, d).select(F.lit(0).cast("long").alias("src"), F.col("zone_id").alias("dst"))


@query("plot_adjacency", f"WITH {LINES}, z AS (SELECT DISTINCT street_id, CAST(floor(uy / 1000) * 5 + floor(ux / 1000) AS BIGINT) AS zone_id FROM lines UNION SELECT street_id, CAST(floor(vy / 1000) * 5 + floor(vx / 1000) AS BIGINT) FROM lines) SELECT DISTINCT a.zone_id AS src, b.zone_id AS dst FROM z a JOIN z b ON a.street_id = b.street_id AND a.zone_id <> b.zone_id")
def plot_adjacency(spark, d):
    z = L.located_streets(spark, d).select("street_id", F.explode(F.array(L.zone_of("ux", "uy"), L.zone_of("vx", "vy"))).alias("zone_id")).distinct()
    other = z.select("street_id", F.col("zone_id").alias("dst"))
    return z.join(other, "street_id").where("zone_id <> dst").select(F.col("zone_id").alias("src"), "dst").distinct()


@query("event_windows", f"WITH {POIS} SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, {ZONE} AS zone_id, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean FROM pois GROUP BY 1, 2")
def event_windows(spark, d):
    w = L.pois(spark, d).groupBy(F.window("ts", "6 hours"), L.zone_of().alias("zone_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "zone_id", "n", "mean")


@query("edge_sample", f"WITH {POIS}, g AS (SELECT poi_id, {ZONE} AS zone_id FROM pois) SELECT poi_id, zone_id FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY md5(concat(CAST(poi_id AS VARCHAR), ':3')), poi_id) AS k FROM g) WHERE k <= 20")
def edge_sample(spark, d):
    g = L.pois(spark, d).select("poi_id", L.zone_of().alias("zone_id"))
    k = F.row_number().over(Window.partitionBy("zone_id").orderBy(F.md5(F.concat_ws(":", F.col("poi_id").cast("string"), F.lit("3")).cast("binary")), "poi_id"))
    return g.withColumn("k", k).where("k <= 20").drop("k")


WAYS = LINES + ", ways AS MATERIALIZED (SELECT *, vx - ux AS dx, vy - uy AS dy FROM lines)"


@query("nearest_street_50m", f"WITH {WAYS}, {BUILDINGS}, f AS (SELECT bid, street_id, x, y, ux, uy, dx, dy, greatest(0, least(1, ((x - ux) * dx + (y - uy) * dy) / (dx * dx + dy * dy))) AS t FROM (SELECT bid, x, y FROM buildings), (SELECT street_id, ux, uy, dx, dy FROM ways)), g AS (SELECT bid, street_id, sqrt(pow(x - ux - t * dx, 2) + pow(y - uy - t * dy, 2)) AS distance FROM f) SELECT bid, street_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY bid ORDER BY round(distance, 9), street_id) AS k FROM g WHERE distance <= 50) WHERE k = 1")
def nearest_street(spark, d):
    got = segments.nearest_segment(L.buildings(spark, d).select("bid", "x", "y"), L.located_streets(spark, d), "bid", "street_id", 50.0)
    return got.select("bid", "street_id", F.round("distance", 6).alias("distance"))


@query("street_catchment", f"WITH {WAYS}, f AS (SELECT n.id, dx * dx + dy * dy AS a, 2 * ((ux - x) * dx + (uy - y) * dy) AS b, (ux - x) * (ux - x) + (uy - y) * (uy - y) - 10000 AS c FROM (SELECT id, x, y FROM nodes) n, (SELECT ux, uy, dx, dy FROM ways)), g AS (SELECT id, CASE WHEN b * b - 4 * a * c > 0 THEN greatest(0, least(1, (-b + sqrt(greatest(0, b * b - 4 * a * c))) / (2 * a)) - greatest(0, (-b - sqrt(greatest(0, b * b - 4 * a * c))) / (2 * a))) * sqrt(a) ELSE 0 END AS l FROM f) SELECT id AS intersection_id, round(sum(l), 3) AS length FROM g GROUP BY 1")
def street_catchment(spark, d):
    got = segments.clipped_length(L.intersections(spark, d).select("intersection_id", "x", "y"), L.located_streets(spark, d), "intersection_id", "street_id", 100.0)
    return got.withColumn("length", F.round("length", 3))


@query("centralities")
def centralities(spark, d):
    return centrality.centralities(L.streets(spark, d))


@query("save_load_roundtrip", f"WITH {STREETS} SELECT 'street_to_intersection' AS relation, street_id AS src, u AS dst FROM streets UNION ALL SELECT 'boundary_to_zone', CAST(0 AS BIGINT), CAST(n_nationkey AS BIGINT) FROM nation")
def save_load_roundtrip(spark, d):
    path = shared_path(spark, "graph")
    s = L.streets(spark, d)
    hetero.UrbanGraph({"zone": L.zones(spark, d)}, {"street_to_intersection": s.select(F.col("street_id").alias("src"), F.col("u").alias("dst")), "boundary_to_zone": boundary_relation(spark, d)}).save(path)
    back = hetero.UrbanGraph.load(spark, path, ["zone"])
    parts = [e.select(F.lit(r).alias("relation"), "src", "dst") for r, e in sorted(back.edges.items())]
    return parts[0].union(parts[1])


@query("stream_event_windows", ORACLES["event_windows"])
def stream_event_windows(spark, d):
    schema = L.table(spark, d, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    key = F.col("event_id").cast("long")
    e = e.select(F.col("ts").cast("timestamp").alias("ts"), "value", (key * 7919 % L.WIDE).cast("double").alias("x"), (key * 6007 % L.HIGH).cast("double").alias("y"))
    out = windows.finished(windows.windowed(e, L.zone_of(), "zone_id", "6 hours"), shared_path(spark, "windows"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "zone_id", "n", F.round("mean", 6).alias("mean"))


@query("eigenvector")
def eigenvector(spark, d):
    return graph.eigenvector(L.intersections(spark, d), L.streets(spark, d), "intersection_id").withColumn("eigenvector", F.round("eigenvector", 6))


FILL = f"WITH RECURSIVE {NODES}, {STREETS}, e AS (SELECT u, v FROM streets UNION SELECT v, u FROM streets), seeds AS (SELECT id, value FROM nodes WHERE id % 20 = 0), r(id, source, hops) AS (SELECT id, id, 0 FROM seeds UNION SELECT e.v, r.source, r.hops + 1 FROM r JOIN e ON e.u = r.id WHERE r.hops < 12), best AS (SELECT id, source FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hops, source) AS k FROM r) WHERE k = 1) SELECT nodes.id, seeds.value FROM nodes LEFT JOIN best ON best.id = nodes.id LEFT JOIN seeds ON seeds.id = best.source"


@query("graph_fill", FILL)
def graph_fill(spark, d):
    n = L.intersections(spark, d).select(F.col("intersection_id").alias("id"), F.when(F.col("intersection_id") % 20 == 0, F.col("value")).alias("value"))
    return graph.fill_along(n, L.streets(spark, d))


IMAGES = f"WITH {WAYS}, {POIS}, f AS (SELECT poi_id, street_id, length, x, y, ux, uy, dx, dy, greatest(0, least(1, ((x - ux) * dx + (y - uy) * dy) / (dx * dx + dy * dy))) AS t FROM (SELECT poi_id, x, y FROM pois), (SELECT street_id, length, ux, uy, dx, dy FROM ways)), g AS (SELECT *, sqrt(pow(x - ux - t * dx, 2) + pow(y - uy - t * dy, 2)) AS distance FROM f), near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY poi_id ORDER BY round(distance, 9), street_id) AS k FROM g WHERE distance <= 10) WHERE k = 1)"


def _on_streets(spark, d):
    p = L.pois(spark, d).select("poi_id", "x", "y")
    return segments.nearest_segment(p, L.located_streets(spark, d), "poi_id", "street_id", 10.0)


@query("bin_thinning", IMAGES + " SELECT poi_id AS image_id, street_id, bin FROM (SELECT *, row_number() OVER (PARTITION BY street_id, bin ORDER BY round(distance, 9), poi_id) AS b FROM (SELECT *, CAST(floor(round(t * length, 6) / 20) AS BIGINT) AS bin FROM near)) WHERE b = 1")
def bin_thinning(spark, d):
    length = F.hypot(F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy"))
    b = _on_streets(spark, d).withColumn("bin", F.floor(F.round(F.col("t") * length, 6) / 20).cast("long"))
    best = b.groupBy("street_id", "bin").agg(F.min(F.struct(F.round("distance", 9), "poi_id")).alias("m"))
    return best.select(F.col("m.poi_id").alias("image_id"), "street_id", "bin")


@query("align_filter", IMAGES + ", a AS (SELECT poi_id AS image_id, CAST(poi_id * 37 % 360 AS DOUBLE) AS angle, degrees(atan2(dx, dy)) AS t FROM near), b AS (SELECT image_id, angle, round(CASE WHEN t < 0 THEN t + 360 ELSE t END, 1) AS bearing FROM a) SELECT image_id, bearing FROM b WHERE abs(angle - bearing) < 30 OR abs(angle - CASE WHEN bearing >= 180 THEN bearing - 180 ELSE bearing + 180 END) < 30")
def align_filter(spark, d):
    a = _on_streets(spark, d).select(F.col("poi_id").alias("image_id"), (F.col("poi_id") * 37 % 360).cast("double").alias("angle"), F.round(F.pmod(F.degrees(F.atan2(F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy"))), F.lit(360.0)), 1).alias("bearing"))
    back = F.pmod(F.col("bearing") + 180, F.lit(360.0))
    return a.where((F.abs(F.col("angle") - F.col("bearing")) < 30) | (F.abs(F.col("angle") - back) < 30)).select("image_id", "bearing")


from . import area_queries, city_queries, more  # noqa: E402,F401  register the rest
