"""The high-level methods: whole layers, statistics and graphs of a city, as functions of its DataFrames.

A City holds the raw layers. Every method builds one lazy plan: one grid join and one aggregation a layer, all of the
layer's figures at once, joined back to the targets by id. Layers that a caller does not give are left out of the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import shapes
from ..operators import centrality, clean, crossings, graph, paths, plots, polygons, relations, rings, segments, spatial_join
from ..operators.hetero import UrbanGraph
from ..operators.overlay import bounds

SHAPE = ("complexity", "circular_compactness", "convexity", "corners", "elongation", "orientation", "longest_axis", "eri", "fractal_dimension", "rectangularity", "square_compactness", "shape_index", "squareness")


@dataclass
class City:
    """intersections (intersection_id, x, y), streets (street_id, u, v, ux, uy, vx, vy, length), buildings (bid, ring),
    heights (ring, height), pois (x, y, poi_class), population (x, y, value), images (x, y, tile_id, indicators), zones
    (zone_id, ring); all in metres of one plane."""

    intersections: DataFrame | None = None
    streets: DataFrame | None = None
    buildings: DataFrame | None = None
    heights: DataFrame | None = None
    pois: DataFrame | None = None
    population: DataFrame | None = None
    images: DataFrame | None = None
    zones: DataFrame | None = None
    classes: tuple[str, ...] = ()
    indicators: tuple[str, ...] = ()


def _z(name: str, digits: int | None = 3) -> Column:
    value = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return (value if digits is None else F.round(value, digits)).alias(name)


def network_layer(city: City, inside: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): streets simplified, cut by the border where one is given, of the largest component, without loops."""
    streets = city.streets
    if inside is not None:
        kept = paths.truncate(city.intersections, streets, "intersection_id", inside).select(F.col("intersection_id").alias("_k"))
        streets = streets.join(kept, F.col("u") == F.col("_k"), "left_semi").join(kept, F.col("v") == F.col("_k"), "left_semi")
    edges = paths.simplify(streets.select("street_id", "u", "v", "length")).where("u <> v")
    parts = graph.components(edges)
    best = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    nodes = parts.join(F.broadcast(best), "component", "left_semi").select(F.col("node").alias("intersection_id"))
    edges = edges.join(nodes, F.col("u") == F.col("intersection_id"), "left_semi")
    return city.intersections.join(nodes, "intersection_id", "left_semi"), edges


def population_layer(points: dict[str, DataFrame]) -> DataFrame:
    """Population points of several groups (men, women, ...) or years side by side: (x, y, group...), 0 where one has none."""
    long = None
    for name, df in points.items():
        part = df.select("x", "y", "value", F.lit(name).alias("_g"))
        long = part if long is None else long.unionByName(part)
    return long.groupBy("x", "y").pivot("_g", list(points)).agg(F.sum("value")).na.fill(0.0)


def building_layer(buildings: DataFrame, heights: DataFrame | None = None, least: float = 30.0, cell: float = 200.0) -> DataFrame:
    """Buildings with valid rings of more than `least` square metres, their area, perimeter, centroid and thirteen metrics.

    With height polygons: the mean height of those that a building overlaps, else the height of the nearest building that
    has one.
    """
    b = shapes.valid_polygons(buildings, least=least)
    b = b.withColumns({"bid_area": G.area(F.col("ring")), "bid_perimeter": G.length(F.col("ring")), "bid_centroid": shapes.centroid(F.col("ring"))})
    b = G.morphology(b)
    a, p, ring = F.col("bid_area"), F.col("bid_perimeter"), F.col("ring")
    b = b.withColumns({"complexity": G.complexity(a, p), "fractal_dimension": G.fractal_dimension(a, p), "square_compactness": G.square_compactness(a, p), "corners": G.corners(ring), "squareness": G.squareness(ring)})
    return b if heights is None else with_heights(b, heights, cell)


def with_heights(buildings: DataFrame, heights: DataFrame, cell: float) -> DataFrame:
    met = polygons.overlaps(buildings.select("bid", F.col("ring").alias("_b")), heights.select("height", F.col("ring").alias("_h")), cell, "_b", "_h")
    own = met.groupBy("bid").agg(F.avg("height").alias("height"))
    at = graph._held(buildings.select("bid", shapes.centroid(F.col("ring")).alias("c")).select("bid", F.col("c.x").alias("x"), F.col("c.y").alias("y")).join(own, "bid", "left"))
    known = at.where("height IS NOT NULL").select(F.col("bid").alias("_from"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("height").alias("_near"))
    best = spatial_join.nearest_any(at.where("height IS NULL"), known.select("_from", "rx", "ry"), "bid", "_from", cell).select("bid", "_from")
    filled = best.join(known.select("_from", "_near"), "_from").select("bid", "_near")
    return buildings.join(at.select("bid", "height"), "bid", "left").join(filled, "bid", "left").withColumn("height", F.coalesce("height", "_near")).drop("_near")


def _moments(images: DataFrame, indicators: tuple[str, ...]) -> tuple[dict[str, Column], dict[str, Column]]:
    """Columns whose sums give the indicators' means and deviations, and these of the sums.

    Sums are of what lies above the layer's mean in whole numbers, so that squares do not cancel.
    """
    base = images.agg(*[F.round(F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))) for c in indicators]).first()
    sums, figures = {}, {}
    for c, m in zip(indicators, base, strict=True):
        m = m if math.isfinite(m) else 0.0
        v = F.col(c).cast("double") - m
        sums |= {f"_n_{c}": F.col(c).isNotNull().cast("long"), f"_s_{c}": F.coalesce(v, F.lit(0.0)), f"_q_{c}": F.coalesce(v * v, F.lit(0.0))}
        n, s, q = F.col(f"_n_{c}"), F.col(f"_s_{c}"), F.col(f"_q_{c}")
        figures |= {f"{c}_mean": F.try_divide(s + n * m, n), f"{c}_std": F.sqrt(F.greatest(F.lit(0.0), F.try_divide(q - F.try_divide(s * s, n), n - 1)))}
    return sums, figures


def point_context(targets: DataFrame, key: str, city: City, radius: float = 100.0) -> DataFrame:
    """targets with what lies within the radius: streets, buildings, points of interest, population, imagery."""
    disc = math.pi * radius * radius
    out = targets
    if city.intersections is not None:
        n = spatial_join.disc_sums(targets, city.intersections, key, radius, {}).select(key, F.col("_n").cast("long").alias("node_count"))
        out = out.join(n, key, "left").withColumns({"node_count": F.coalesce("node_count", F.lit(0)), "node_density": F.round(F.coalesce("node_count", F.lit(0)) / (disc / 1e6), 3)})
    if city.streets is not None:
        length = segments.clipped_length(targets.select(key, "x", "y"), city.streets, key, "street_id", radius).withColumnRenamed("length", "street_length")
        out = out.join(length, key, "left").withColumns({"street_length": F.round("street_length", 3), "street_density": F.round(F.col("street_length") / (disc / 1e6) / 1000, 3)})
    if city.buildings is not None:
        rings = city.buildings.select("bid", "ring", *[c for c in SHAPE if c in city.buildings.columns]).withColumns({"area": G.area(F.col("ring")), "perimeter": G.length(F.col("ring"))})
        held = [c for c in SHAPE if c in rings.columns]
        got = polygons.disc_footprints(targets, rings, key, radius, ["area", "perimeter", *held])
        got = got.select(key, "building_count", F.col("clipped_area").alias("_c"), F.col("area_mean").alias("footprint_mean"), F.col("area_std").alias("footprint_std"), F.col("perimeter_sum").alias("perimeter_total"), "perimeter_mean", *[f"{c}_{n}" for c in held for n in ("mean", "std")])
        figures = ["footprint_mean", "footprint_std", "perimeter_total", "perimeter_mean", *[f"{c}_{n}" for c in held for n in ("mean", "std")]]
        out = out.join(got, key, "left").withColumns({"building_count": F.coalesce("building_count", F.lit(0)), "footprint_proportion": F.round(F.coalesce("_c", F.lit(0.0)) / disc, 3), **{c: _z(c) for c in figures}}).drop("_c")
    if city.pois is not None:
        n = spatial_join.disc_sums(targets, city.pois, key, radius, clean.class_marks("poi_class", city.classes))
        out = out.join(n.select(key, *[F.col(c).cast("long").alias(c) for c in city.classes]), key, "left").na.fill(0, list(city.classes))
    if city.population is not None:
        n = spatial_join.disc_sums(targets, city.population, key, radius, {"population": F.coalesce("value", F.lit(0.0))})
        out = out.join(n.select(key, F.col("population").cast("long").alias("population")), key, "left").na.fill(0, ["population"])
    if city.images is not None:
        sums, made = _moments(city.images, city.indicators)
        got = graph._held(spatial_join.disc_sums(targets, city.images, key, radius, sums).select(key, *[c.alias(n) for n, c in made.items()]))
        figures = [f"{c}_{n}" for c in city.indicators for n in ("mean", "std")]
        out = clean.fill_mean(out.join(got, key, "left"), [f"{c}_mean" for c in city.indicators], got).withColumns({c: _z(c) for c in figures})
    return out


def aggregate_stats(zones: DataFrame, key: str, city: City, cell: float) -> DataFrame:
    """zones (key, ring) with area and perimeter in kilometres, and what each zone holds or meets.

    Points count in the zones that hold them, streets and buildings in all zones that they share a length or an area with,
    each by its whole length and area.
    """
    z = zones.select(key, "ring")
    out = zones.withColumns({"area": G.area(F.col("ring")) / 1e6, "perimeter": G.length(F.col("ring")) / 1000}).drop("ring")
    if city.intersections is not None:
        n = polygons.points_in(city.intersections.select("intersection_id", "x", "y"), z, cell).groupBy(key).agg(F.count(F.lit(1)).alias("num_nodes"))
        out = out.join(n, key, "left").withColumn("num_nodes", F.coalesce("num_nodes", F.lit(0))).withColumn("node_density", F.round(F.col("num_nodes") / F.col("area"), 3))
    if city.streets is not None:
        met = polygons.segments_in(city.streets.select("street_id", "ux", "uy", "vx", "vy", "length"), z, cell)
        e = met.groupBy(key).agg(F.count(F.lit(1)).alias("num_edges"), F.sum("length").alias("total_edge_length"), F.avg("length").alias("mean_edge_length"), F.stddev_samp("length").alias("std_edge_length"))
        out = out.join(e, key, "left").withColumns({"num_edges": F.coalesce("num_edges", F.lit(0)), **{c: _z(c) for c in ("total_edge_length", "mean_edge_length", "std_edge_length")}})
        out = out.withColumns({"edge_density": F.round(F.col("num_edges") / F.col("area"), 3), "edge_length_density": F.round(F.col("total_edge_length") / F.col("area"), 3)})
        if city.intersections is not None:
            out = out.withColumn("mean_node_degree", F.round(F.coalesce(F.try_divide(2.0 * F.col("num_edges"), F.col("num_nodes")), F.lit(0.0)), 3))
    if city.buildings is not None:
        held = [c for c in SHAPE if c in city.buildings.columns]
        b = city.buildings.select("bid", F.col("ring").alias("_b"), *held).withColumns({"_a": G.area(F.col("_b")), "_p": G.length(F.col("_b"))})
        met = polygons.overlaps(b, z, cell, "_b", "ring")
        got = met.groupBy(key).agg(F.count("bid").alias("num_buildings"), F.sum("_a").alias("total_building_area"), F.avg("_a").alias("mean_building_area"), F.stddev_samp("_a").alias("std_building_area"), F.sum("_p").alias("total_building_perimeter"), F.avg("_p").alias("mean_building_perimeter"), *[f(c).alias(f"{n}_building_{c}") for c in held for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
        figures = ["mean_building_area", "std_building_area", "total_building_perimeter", "mean_building_perimeter", *[f"{n}_building_{c}" for c in held for n in ("mean", "std")]]
        total = F.coalesce("total_building_area", F.lit(0.0)) / 1e6
        out = out.join(got, key, "left").withColumns({"num_buildings": F.coalesce("num_buildings", F.lit(0)), "footprint_percent": F.round(total / F.col("area") * 100, 3), "total_building_area": F.round(total, 6), **{c: _z(c) for c in figures}})
    if city.pois is not None:
        near = polygons.points_in(city.pois.select("poi_class", "x", "y"), z, cell)
        out = out.join(clean.class_counts(near, key, "poi_class", city.classes), key, "left").na.fill(0, list(city.classes))
    if city.population is not None:
        near = polygons.points_in(city.population.select("value", "x", "y"), z, cell)
        out = out.join(near.groupBy(key).agg(F.sum("value").cast("long").alias("population")), key, "left").na.fill(0, ["population"])
    if city.images is not None:
        near = polygons.points_in(city.images.select("x", "y", *city.indicators), z, cell)
        got = near.groupBy(key).agg(*[f(c).alias(f"{c}_{n}") for c in city.indicators for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
        out = out.join(got, key, "left").withColumns({f"{c}_{n}": _z(f"{c}_{n}") for c in city.indicators for n in ("mean", "std")})
    return out


def street_network(city: City, radius: float = 100.0, attributes: tuple[str, ...] = ("catchment", "topology", "buildings", "population", "pois", "images"), dual: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with the attribute groups named; dual: streets become nodes, consecutive streets edges.

    A group that is not among the default ones, `centrality`: closeness, betweenness, eigenvector and Katz centrality and
    the clustering by street length; 0 for nodes without streets. Its parts can be named alone: `paths` (closeness and
    betweenness), `eigenvector`, `katz`, `weighted_clustering`.
    """
    nodes, edges = city.intersections, city.streets
    if dual:
        at = edges.select(F.col("street_id").alias("node_id"), ((F.col("ux") + F.col("vx")) / 2).alias("x"), ((F.col("uy") + F.col("vy")) / 2).alias("y"), "length", F.array("u", "v").alias("osmids"))
        return at, graph.dual(edges)
    if "topology" in attributes:
        nodes = nodes.join(graph.out_degree(nodes, edges, "intersection_id"), "intersection_id")
        nodes = nodes.join(graph.clustering(edges, nodes, "intersection_id"), "intersection_id")
        nodes = nodes.join(graph.pagerank(nodes, edges, "intersection_id"), "intersection_id")
        nodes = nodes.withColumns({"clustering": F.round("clustering", 3), "pagerank": F.round("pagerank", 6)})
    key, given = "intersection_id", city.intersections.select("intersection_id")
    parts = {
        "paths": lambda: centrality.centralities(edges).withColumnRenamed("id", key),
        "eigenvector": lambda: graph.eigenvector(given, edges, key),
        "katz": lambda: graph.katz(given, edges, key),
        "weighted_clustering": lambda: paths.weighted_clustering(edges, given, key),
    }
    for name, made in parts.items():
        if name in attributes or "centrality" in attributes:
            more = made()
            nodes = nodes.join(more, key, "left").withColumns({c: _z(c, 6) for c in more.columns if c != key})
    part = lambda name, layer: layer if name in attributes else None
    held = City(intersections=part("catchment", city.intersections), streets=part("catchment", city.streets), buildings=part("buildings", city.buildings), pois=part("pois", city.pois), population=part("population", city.population), images=part("images", city.images), classes=city.classes, indicators=city.indicators)
    return point_context(nodes, "intersection_id", held, radius), edges


def building_nodes(buildings: DataFrame, attributes: list[str], knn: tuple[int, ...] = (), distances: tuple[float, ...] = (), start: float = 100.0) -> DataFrame:
    """(bid, <k>nn_<attribute>_mean and _std, ...): neighbours' means and deviations, the nearest k (itself included) or those within a distance (itself not)."""
    b = buildings.select("bid", "x", "y")
    values = buildings.select(F.col("bid").alias("neighbour"), *attributes)
    out = buildings.select("bid", "x", "y", *attributes)
    figures = lambda tag, rows: rows.groupBy("bid").agg(*[f(a).alias(f"{tag}_{a}_{n}") for a in attributes for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
    if knn:
        # One search for the largest k serves all of them.
        near = graph._held(spatial_join.knn(b, "bid", max(knn), start).join(values.hint("merge"), "neighbour"))
        for k in knn:
            out = out.join(figures(f"{k}nn", near.where(F.col("rank") <= k)), "bid", "left")
    for d in distances:
        # Attributes come with the pairs: joined afterwards they would shuffle all pairs.
        other = buildings.select(F.col("bid").alias("neighbour"), F.col("x").alias("rx"), F.col("y").alias("ry"), *[F.col(a) for a in attributes])
        pairs = spatial_join.within_distance(b, other, d).where("bid <> neighbour")
        out = out.join(figures(f"{d:g}m", pairs), "bid", "left")
    return out.na.fill(0.0, [c for c in out.columns if c.endswith(("_mean", "_std")) and c not in attributes])


def plot_nodes(streets: DataFrame, buildings: DataFrame | None, cell: float, least: float = 30.0, snap: float = 1.0) -> DataFrame:
    """Plots that streets enclose: plot_id, area, perimeter, ring, holes, street_id and bid lists, building figures.

    A street belongs to the plots along whose border a part of it runs, a building to those it overlaps.
    """
    # Pieces keep their street, so a plot's streets are those of the pieces along its border: an equi-join.
    pieces = graph._held(crossings.undirected(crossings.cut_at_crossings(streets.select("street_id", "ux", "uy", "vx", "vy"), "street_id", cell, snap)))
    found = graph._held(plots.plots(pieces.select("a", "b").distinct(), least).select("plot_id", "area", "perimeter", "ring", "holes"))
    border = found.select("plot_id", F.explode(F.concat(F.array("ring"), "holes")).alias("ring"))
    along = crossings.undirected(polygons.edges_of(border, ["plot_id"])).join(pieces, ["a", "b"]).groupBy("plot_id").agg(F.array_sort(F.collect_set("street_id")).alias("street_id"))
    out = found.join(along, "plot_id", "left").withColumn("street_id", F.coalesce("street_id", F.array().cast("array<bigint>")))
    if buildings is not None:
        b = buildings.select("bid", F.col("ring").alias("_b")).withColumn("_a", G.area(F.col("_b")))
        met = polygons.overlaps(b, found.select("plot_id", rings.keyhole(F.concat(F.array("ring"), "holes")).alias("ring")), cell, "_b", "ring").groupBy("plot_id").agg(F.array_sort(F.collect_set("bid")).alias("bid"), F.count(F.lit(1)).alias("building_count"), F.sum("_a").alias("_t"), F.avg("_a").alias("building_area_mean"), F.stddev_samp("_a").alias("building_area_std"))
        out = out.join(met, "plot_id", "left").withColumns({"bid": F.coalesce("bid", F.array().cast("array<bigint>")), "building_count": F.coalesce("building_count", F.lit(0)), "coverage": F.round(F.coalesce("_t", F.lit(0.0)) / F.col("area"), 3), "building_area_mean": _z("building_area_mean"), "building_area_std": _z("building_area_std")}).drop("_t")
    return out


def urban_graph(city: City, cell: float, radius: float = 100.0, knn: int = 5, reach: float = 50.0) -> UrbanGraph:
    """Node tables of all five types and their twelve relations."""
    nodes, edges = street_network(city, radius, ("catchment",))
    # Held: otherwise every join below would repeat the whole expression of the centroid.
    at = graph._held(city.buildings.withColumn("_c", shapes.centroid(F.col("ring"))).withColumns({"x": F.col("_c.x"), "y": F.col("_c.y")}).drop("_c"))
    plot = graph._held(plot_nodes(edges, city.buildings, cell))
    border = city.zones.select(F.lit(0).cast("long").alias("boundary_id"), "ring") if city.zones is not None else plot.select(F.lit(0).cast("long").alias("boundary_id"), "ring")
    b = bounds("ring")
    box = border.groupBy("boundary_id").agg(F.min(b["_x0"]).alias("minx"), F.min(b["_y0"]).alias("miny"), F.max(b["_x1"]).alias("maxx"), F.max(b["_y1"]).alias("maxy"))
    tables = {"boundary": box, "building": at, "plot": plot, "street": edges, "intersection": nodes}
    return relations.initialise(tables, "knn", knn, radius, reach)
