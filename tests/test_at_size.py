"""What only shows on tables larger than the test data: ids that meet, sizes that are misjudged, dense layers."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from streetloom.functions import geometry as G
from streetloom.operators import centrality, graph, polygons
from streetloom.sources import layers as L


def test_drop_covered_from_a_million_buildings_on(spark, tmp_path):
    """The number of a copy is another building's own: neither goes because of the other."""
    bids = [0, 1, 3, 5, 1_000_000, 1_000_001, 1_000_003, 1_000_005]
    rows = [(b, "n", "b", "t", 7, 1.0) for b in bids]
    part = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    part.write.parquet(str(tmp_path / "part.parquet"))
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = sorted(r[0] for r in duckdb.sql(entry.oracle_sql()["drop_covered"]).fetchall())
    assert sorted(r.bid for r in entry.queries()["drop_covered"](spark, str(tmp_path)).collect()) == want


def test_overlaps_of_a_tenth_of_a_millimetre(spark):
    """The least overlap that buildings on whole and half metres have with zones cut by a slanting line, and two that only touch."""
    square = lambda x, y: [(x, y), (x + 10.0, y), (x + 10.0, y + 10.0), (x, y + 10.0), (x, y)]
    rise, slope = 13.37, 0.7310585
    low = [(0.0, 0.0), (1000.0, 0.0), (1000.0, rise + slope * 1000), (0.0, rise), (0.0, 0.0)]
    # The line passes x = 382.5 within 0.12 mm of a whole or half metre, and x = 250.5 within 0.15 mm.
    corners = [(x, round(2 * (rise + slope * x)) / 2) for x in (382.5, 250.5)]
    boxes = [square(x - 10.0, y) for x, y in corners] + [square(x, y - 10.0) for x, y in corners] + [square(-10.0, 0.0), square(100.0, -10.0)]
    kind = "array<struct<x:double,y:double>>"
    left, right = spark.createDataFrame(list(enumerate(boxes)), f"bid long, a {kind}"), spark.createDataFrame([(7, low)], f"zone_id long, b {kind}")
    got = {r.bid: r.overlap for r in polygons.overlaps(left, right, 1000.0, "a", "b").collect()}
    want = {k for k, (x, y) in enumerate(corners) if rise + slope * x > y}
    assert want and want <= set(got) <= want | {2, 3} and all(1e-9 < got[k] < 1e-7 for k in want)


def test_pagerank_and_katz_in_blocks(spark, monkeypatch):
    """Graphs too large for the driver's numpy: blocks of nodes give what it gives, ids with gaps and a node without links too."""
    edges = spark.range(900).select((F.col("id") * 7 % 300 * 1000).alias("u"), (F.col("id") * F.col("id") * 11 % 290 * 1000).alias("v"))
    nodes = spark.range(301).select((F.col("id") * 1000).alias("k"))
    want = [{r.k: r[1] for r in f(nodes, edges, "k").collect()} for f in (graph.pagerank, graph.katz)]
    monkeypatch.setattr(graph, "SMALL", 10)
    monkeypatch.setattr(graph, "BLOCK_LINKS", 100)
    for f, w in zip((graph.pagerank, graph.katz), want, strict=True):
        shuffled = f(nodes, edges, "k")
        assert {r.k: r[1] for r in shuffled.collect()} == pytest.approx(w, abs=1e-8) and len(w) == 301


def test_parts_of_the_centrality_group(spark, tmp_path, monkeypatch):
    """street_topology does not search paths or iterate eigenvectors only to drop them."""
    def never(*a, **b):
        raise AssertionError("not asked for")

    monkeypatch.setattr(centrality, "centralities", never)
    monkeypatch.setattr(graph, "eigenvector", never)
    got = entry.queries()["street_topology"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["intersection_id", "degree", "clustering", "pagerank", "katz", "weighted_clustering"] and got.count() == 150


def test_squareness_makes_its_ring_once(spark):
    ring = "transform(sequence(0, 4), k -> named_struct('x', double(k % 4), 'y', double(k)))"
    plan = spark.range(1).select(G.squareness(F.expr(ring)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sequence(0, 4") == 1


def test_buildings_of_one_file_are_dealt_over_the_cores(spark):
    assert L.buildings(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
