"""What lies within discs of 100 m, without pairs."""

from pyspark.sql import functions as F

from streetloom.operators import spatial_join
from streetloom.plans import city as C


def test_context_makes_no_pairs(spark, monkeypatch):
    """Counts and moments of a disc come without its pairs, and equal Spark's own."""
    def never(*a, **b):
        raise AssertionError("pairs")

    p = spark.range(3000).select((F.col("id") * 37 % 400).cast("double").alias("x"), (F.col("id") * 91 % 300).cast("double").alias("y"), F.when(F.col("id") % 5 > 0, 1e6 + F.col("id") % 11).alias("green"), (F.col("id") % 7).cast("double").alias("value"), F.when(F.col("id") % 3 > 0, F.lit("food")).alias("poi_class"))
    t = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 11).cast("double").alias("x"), (F.col("id") * 8).cast("double").alias("y"))
    pairs = spatial_join.within_distance(t, p.withColumnsRenamed({"x": "rx", "y": "ry"}), 100.0).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"), F.count_if(F.col("poi_class") == "food").alias("f"), F.round(F.avg("green"), 3).alias("m"), F.round(F.stddev_samp("green"), 3).alias("s"))
    want = {r.k: (r.n, r.f, r.v, r.m, r.s) for r in pairs.collect()}
    monkeypatch.setattr(spatial_join, "within_distance", never)
    out = C.point_context(t, "k", C.City(intersections=p, pois=p, population=p, images=p, classes=("food",), indicators=("green",)), 100.0)
    got = {r.k: (r.node_count, r.food, r.population, r.green_mean, r.green_std) for r in out.collect()}
    assert set(got) == set(range(40)) and all(got[k] == want[k] for k in want)


def test_targets_among_the_layer_itself(spark):
    """Targets joined from the layer that is counted: their columns are not taken for each other's."""
    p = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 60).cast("double").alias("x"), F.lit(0.0).alias("y"))
    t = p.join(p.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k")
    assert sorted(r.node_count for r in C.point_context(t, "k", C.City(intersections=p), 100.0).collect()) == [2] * 2 + [3] * 28
